import json

from pyspark.sql import functions as F

from arborlake.operators import layout
from arborlake.sources import files, organization

BUNDLE = {
    "schema_version": 1,
    "definition": {"org_id": "o", "teams": [{"id": "t1", "name": "One", "roles": [{"id": "a"}, {"id": "b"}]}, {"id": "t2", "roles": [{"id": "c"}]}], "workflow": [{"from": "a", "to": "b"}, {"from": "a", "to": "c", "kind": "feeds"}, {"from": "b", "to": "c", "kind": "feeds"}, {"from": "a", "to": "zz"}], "gates": [{"from": "b", "by": "c"}]},
    "runs": [{"job_id": "j1", "role": "a", "events": [{"ts": "2", "kind": "note"}, {"ts": "1", "kind": "promotion"}]}, {"job_id": "j2", "role": "nobody", "events": []}],
}


def test_organization(spark):
    good, bad = organization.bundles(spark.createDataFrame([("d", json.dumps(BUNDLE)), ("x", "{"), ("y", "{}")], "doc string, text string"))
    assert {r["doc"]: r["code"] for r in bad.collect()} == {"x": "malformed-json", "y": "structural"}
    nodes, edges = organization.document(good)
    got = {r["id"]: (r["kind"], r["label"], r["graph_id"]) for r in nodes.collect()}
    assert got["d/o"] == ("org:organization", "o", "organizations")
    assert got["d/o/t1"] == ("org:team", "One", "in:d/o") and got["d/o/t2/c"][0] == "org:role"
    assert got["d/o/t1/a/j1"] == ("org:assignment", "j1 promoted", "in:d/o/t1/a")
    assert got["d/o/_direct/_direct/j2"][1] == "j2 in_progress" and "d/o/t1/a/j1/1" in got
    links = sorted((r["kind"], r["src"], r["dst"], r["graph_id"]) for r in edges.collect())
    assert links == [("org:feeds", "d/o/t1", "d/o/t2", "in:d/o")] * 2 + [("org:reviewed-by", "d/o/t1", "d/o/t2", "in:d/o"), ("org:then", "d/o/t1/a", "d/o/t1/b", "in:d/o/t1")]
    assert edges.select("id").distinct().count() == 4


def test_globs_and_trees(spark, tmp_path):
    for name, content in (("a.py", b"x = 1\n"), ("sub/b.py", "é".encode()), ("sub/c.txt", b"t"), ("sub/d.py", b"a\x00b"), ("node/e.py", b"\xff\xfe")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(content)
    got = {r["path"]: (r["text"], r["code"]) for r in files.read_tree(spark, str(tmp_path), ["**/*.py"], ["*/a?.py"]).collect()}
    assert got == {"a.py": ("x = 1\n", None), "sub/b.py": ("é", None), "sub/d.py": (None, "binary"), "node/e.py": (None, "invalid-utf8")}
    rows = spark.createDataFrame([("a/b.py",), ("b.py",), ("a/x/b.txt",)], "p string")
    assert [r[0] for r in rows.select(files.selected(F.col("p"), ["a/*.py", "**/*.txt"])).collect()] == [True, False, True]
    many = files.chunked(spark.range(1030).withColumn("k", F.lit(1)), ["k"], ["id"])
    assert {r["delta"]: r["count"] for r in many.groupBy("delta").count().collect()} == {0: 512, 1: 512, 2: 6}


def test_layouts(spark):
    rows = spark.createDataFrame([("g", "r", None), ("g", "a", "r"), ("g", "b", "r"), ("g", "c", "b"), ("g", "d", "b"), ("h", "z", "gone")], "graph_id string, id string, parent string")
    got = {r["id"]: (r["x"], r["y"]) for r in layout.tree_layout(rows, 10.0).collect()}
    assert got == {"r": (7.5, 0.0), "a": (0.0, 10.0), "b": (15.0, 10.0), "c": (10.0, 20.0), "d": (20.0, 20.0), "z": (0.0, 0.0)}
    boxes = spark.createDataFrame([("p", 30.0, 20.0), ("q", 30.0, 10.0), ("s", 30.0, 10.0)], "component string, w double, h double")
    at = {r["component"]: (r["x"], r["y"]) for r in layout.packed(boxes, 5.0).collect()}
    assert at["p"] == (0.0, 0.0) and len(set(at.values())) == 3
    a = spark.createDataFrame([("p", 0.0, 0.0), ("q", 1.0, 1.0), ("s", 2.0, 2.0)], "id string, x double, y double")
    b = spark.createDataFrame([("p", 0.0, 0.0), ("q", 1.0, 2.0), ("t", 2.0, 2.0)], "id string, x double, y double")
    assert {r["id"]: r["change"] for r in layout.layout_changes(a, b).collect()} == {"q": "moved", "s": "removed", "t": "added"}
    assert tuple(layout.bounds(a.withColumns({"w": F.lit(1.0), "h": F.lit(2.0)})).first()) == (0.0, 0.0, 3.0, 4.0)
