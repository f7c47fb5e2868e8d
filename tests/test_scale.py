"""Steps whose cost must not fall on one task, or be paid again for each row or branch."""

import base64
import hashlib
import time

from pyspark.sql import functions as F

from arborlake.functions.text import derived_id
from arborlake.model import Space
from arborlake.operators import cut, delta, forest
from arborlake.plans import scratch, tables
from arborlake.sources import control_flow as cf

SOURCE = "def f():\n  try:\n    return 1\n  finally:\n    c()\n  d()\ndef g(x):\n  while x:\n    return\n    a()\n  b()\n"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_without_detail_graph_are_not_joined(spark, monkeypatch):
    nodes = [("root", "a", "k", "a", "g")] + [("g", f"x{i}", "k", "x", None) for i in range(50)] + [("g", "e", "k", "e", "nowhere")]
    space = Space.of(spark, [("root", "r"), ("g", "g")], nodes, [])
    kind, nulls = type(space.nodes), []
    join = kind.join

    def spy(self, other, on=None, how=None):
        if isinstance(on, str) and on == "detail_graph":
            nulls.append(self.where("detail_graph is null").count())
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", spy)
    found = {r["id"]: (r["depth"], r["children"], r["leaves"], r["size"]) for r in forest.forest(space).collect()}
    assert nulls == [0]  # all null keys would be one task's
    assert found["a"] == (0, 51, 51, 52) and found["e"] == found["x7"] == (1, 0, 1, 1) and len(found) == 52


def _largest_keys(monkeypatch, df) -> list[int]:
    """From now on, the most rows of one key in either side of each join by a named column."""
    kind, most = type(df), []
    join = kind.join

    def spy(self, other, on=None, how=None):
        if isinstance(on, str):
            most.extend(side.groupBy(on).count().agg({"count": "max"}).first()[0] or 0 for side in (self, other))
        return join(self, other, on, how)

    monkeypatch.setattr(kind, "join", spy)
    return most


def test_coverage_does_not_join_all_leaves_by_their_root(spark, monkeypatch):
    nodes = [("root", "top", "k", "t", "g")] + [("g", x, "k", x, f"g{x}") for x in "abc"] + [(f"g{x}", f"{x}{i}", "k", x, None) for x in "abc" for i in range(40)]
    space = Space.of(spark, [("root", "r"), ("g", "g"), *((f"g{x}", x) for x in "abc")], nodes, [])
    tree = forest.forest(space)
    most = _largest_keys(monkeypatch, space.nodes)
    members = spark.createDataFrame([("a",), ("a3",), ("b7",), ("b8",), ("b8",)], "id string")
    found = cut.coverage(tree, members).first()
    assert tuple(found) == (120, 40, 78, 2)  # a and one leaf of b once; a3 and b8 twice
    assert most and max(most) == 40  # 120 leaves have the same root
    assert tuple(cut.coverage(tree, cut.build_cut(tree, 2)).first()) == (120, 120, 0, 0)


def test_holders_are_found_once_for_all_levels(spark, monkeypatch):
    nodes = [("root", "top", "k", "t", "g"), ("g", "a", "k", "a", "ga"), ("g", "b", "k", "b", "ga"), ("ga", "x", "k", "x", None)]
    space = Space.of(spark, [("root", "r"), ("g", "g"), ("ga", "a")], nodes, [])
    plans, add = [], forest.Levels.add
    monkeypatch.setattr(forest.Levels, "add", lambda self, df: plans.append(_plan(df)) or add(self, df))
    found = {(r["id"], r["parent"], r["depth"], r["size"]) for r in forest.forest(space).collect()}
    assert found == {("top", None, 0, 4), ("a", "top", 1, 2), ("b", "top", 1, 1), ("x", "a", 2, 1)}
    assert plans and not any("SortAggregate" in p for p in plans)  # claims are sorted before the levels, not for each


def test_line_items_are_joined_by_their_order_only(spark, monkeypatch):
    d, joined = "/root/testdata/sf0.001", []
    kind = type(spark.range(0))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: joined.append((set(self.columns), set(other.columns))) or join(self, other, on, how))
    links = tables.supplies(spark, d)
    assert links.columns == ["id", "src", "dst", "kind", "weight"] and links.count() == tables.table(spark, d, "lineitem").count()
    assert not any("c_custkey" in b and "l_orderkey" in a for a, b in joined)  # customers are joined by orders, before


def test_bodies_are_parsed_once_for_all_operations(spark):
    found = cf.functions(spark.createDataFrame([("a", SOURCE)], "path string, text string"))
    assert _plan(cf.body_operations(found)).count("MapInPandas") == 1


def test_unreached_blocks_shuffle_nothing(spark):
    lone = "def h():\n  return\n  a()\n"
    found = cf.functions(spark.createDataFrame([("a", SOURCE), ("b", lone), ("c", "def k():\n  pass\n")], "path string, text string"))
    left = cf.unreached(found)
    assert "Exchange" not in _plan(left)
    assert sorted(tuple(r) for r in left.collect()) == [("a", "f", 0, "0"), ("a", "g", 0, "3"), ("b", "h", 0, "0")]


def test_a_derived_id_takes_few_conversions(spark):
    rows = spark.range(200).select("id", derived_id("n", F.lit("a"), F.col("id").cast("string"), F.lit("é")).alias("x"))
    assert _plan(rows).count("conv(") == 3  # one for 60 bits, not one for each letter
    text = lambda i: base64.b32encode(hashlib.sha256(f"a\x1f{i}\x1fé".encode()).digest()[:16]).decode().lower()[:26]
    assert all(r["x"] == "n" + text(r["id"]) for r in rows.collect())


def _versions(spark) -> tuple[Space, Space]:
    nodes = [("g", f"n{i}", "k", "x", None) for i in range(6)]
    edges = [("g", f"e{i}", f"n{i}", f"n{(i + 1) % 6}", "r", 1.0) for i in range(6)]
    a = Space.of(spark, [("g", "g")], nodes, edges)
    other = [("g", "n0", "k", "y", None), ("g", "n1", "k", "x", "g"), *nodes[2:5], ("g", "n7", "k", "x", None)]
    return a, Space.of(spark, [("g", "h")], other, edges[:4])


def test_a_diff_pairs_each_table_once(spark):
    ops = delta.diff(*_versions(spark))
    plan = _plan(ops)
    assert [plan.count(x) for x in ("FullOuter", "LeftOuter", "RightOuter")] == [3, 1, 0]  # not once more for each kind of operation
    found = sorted((r["phase"], r["id"]) for r in ops.collect())
    assert found == [(1, "e0"), (1, "e4"), (1, "e5"), (2, "n0"), (2, "n5"), (5, "g"), (6, "n0"), (6, "n7"), (7, "n1"), (9, "e0")]


def test_parts_of_a_diff_are_kept_one_after_the_other(spark):
    plans = {}
    keep = lambda df, name: plans.update({name: _plan(df)}) or scratch.written(df, name)
    a, b = _versions(spark)
    ops = delta.diff(a, b, keep)
    assert list(plans) == ["graph_ops", "node_ops", "touched", "edge_ops"]
    assert [plans[p].count("FullOuter") for p in plans] == [1, 1, 0, 1]  # what is kept isn't paired again
    assert "Join" not in _plan(ops) and sorted(map(tuple, ops.collect()), key=str) == sorted(map(tuple, delta.diff(a, b).collect()), key=str)


def test_changes_are_applied_without_another_shuffle_of_all_nodes(spark):
    a, b = _versions(spark)
    ops = scratch.written(delta.diff(a, b), "ops")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after = delta.apply(a, ops).nodes
        lines = _plan(after).splitlines()
        assert not any("Exchange" in x and "Union" in y for x, y in zip(lines, lines[1:], strict=False))
        found = {r["id"]: (r["label"], r["detail_graph"]) for r in after.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {"n0": ("y", None), "n1": ("x", "g"), "n7": ("x", None), **{x: ("x", None) for x in ("n2", "n3", "n4")}}


def test_written_leaves_no_shuffle_files(spark):
    files = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if x.endswith(".data")}
    was, setting = files(), spark.conf.get(scratch.CLEANUP, None)
    kept = scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.monotonic() + 10
    while files() - was and time.monotonic() < until:
        time.sleep(0.1)
    assert not files() - was  # else they stay until the driver collects its garbage
    assert kept.count() == 7 and spark.conf.get(scratch.CLEANUP, None) == setting
