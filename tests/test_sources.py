"""Documents, store, streams and adapters."""

import json
import re

import pytest
from pyspark.sql import functions as F

from arborlake.functions import text
from arborlake.model import Space
from arborlake.operators import delta
from arborlake.sources import adapters, codec, store
from arborlake.streaming import deltas

NODE = {"kind": "core:k", "label": "L", "provenance": {"origin": "source"}}


def doc(**changes):
    base = {
        "formatVersion": 1,
        "roots": ["g"],
        "graphs": [
            {"id": "g", "meta": {"label": "G", "domain": "core", "provenance": {"origin": "source"}}, "nodes": [{"id": "a", "detail": {"graph": "h"}, "attrs": {"x:n": 1, "x:s": "t", "x:l": [1, 2]}, **NODE}, {"id": "b", **NODE}, {"id": "b", **NODE}], "edges": [{"id": "e", "src": "a", "dst": "b", "kind": "rel:r", "weight": 2.5, "provenance": {"origin": "derived"}}]},
            {"id": "h", "meta": {"label": "H", "domain": "core", "provenance": {"origin": "source"}}, "nodes": [], "edges": []},
        ],
    }
    return json.dumps(base | changes)


def test_decode_tables_and_rejects(spark):
    texts = [(1, doc()), (2, "{"), (3, "{}"), (4, doc(formatVersion=9)), (5, doc(formatVersion="x")), (6, '{"formatVersion":1}')]
    space, bad = codec.decode(spark.createDataFrame(texts, "doc int, text string"))
    assert {r["doc"]: r["code"] for r in bad.collect()} == {2: "malformed-json", 3: "missing-format-version", 4: "unsupported-version", 5: "invalid-format-version", 6: "structural"}
    nodes = {r["id"]: r for r in space.nodes.collect()}
    assert set(nodes) == {"a", "b"} and nodes["a"]["detail_graph"] == "h"
    assert nodes["a"]["attrs"] == {"x:n": "1", "x:s": '"t"', "x:l": "[1,2]"}
    assert [tuple(r) for r in space.edges.select("graph_id", "id", "src", "dst", "kind", "weight", "origin").collect()] == [("g", "e", "a", "b", "rel:r", 2.5, "derived")]


def test_encode_is_sorted_json(spark):
    space, _ = codec.decode(spark.createDataFrame([(1, doc())], "doc int, text string"))
    plain = space.with_(nodes=space.nodes.withColumn("attrs", F.lit(None).cast("map<string,string>")))
    out = json.loads(codec.document(plain))
    assert out["roots"] == ["g"] and [g["id"] for g in out["graphs"]] == ["g", "h"]
    assert [n["id"] for n in out["graphs"][0]["nodes"]] == ["a", "b"]
    again, bad = codec.decode(spark.createDataFrame([(1, codec.document(plain))], "doc int, text string"))
    assert bad.count() == 0 and delta.diff(plain, again).count() == 0


def small(spark, labels):
    return Space.of(spark, [("g", "x")], [("g", f"n{k}", "core:k", label, None) for k, label in enumerate(labels)], [])


def test_store_keeps_versions_and_replays_the_log(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    a, b, c = small(spark, "abc"), small(spark, "abcd"), small(spark, "xbcd")
    assert s.checkpoint(a) == 0
    s.append(delta.diff(a, b), 1)
    s.append(delta.diff(b, c), 2)
    with pytest.raises(ValueError, match="stale"):
        s.append(delta.diff(b, c), 2)
    assert delta.diff(s.open(), c).count() == 0
    assert s.compact() == 2 and delta.diff(s.open(), c).count() == 0
    with pytest.raises(FileExistsError):
        s.checkpoint(a, 2)


def test_salvage(spark):
    s = Space.of(spark, [("g", "x"), ("h", "x")], [("g", "a", "core:k", "x", "h"), ("g", "b", "core:k", "x", "h"), ("lost", "c", "core:k", "x", None), ("g", "d", "core:k", "x", "gone")], [("g", "e", "a", "b", "r:r", None), ("g", "f", "a", "c", "r:r", None)])
    out = store.salvaged(s)
    assert {r["id"]: r["detail_graph"] for r in out.nodes.collect()} == {"a": "h", "b": None, "d": None}
    assert [r["id"] for r in out.edges.collect()] == ["e"]


def test_staged_stream_publishes_all_or_nothing(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/s")
    a, b = small(spark, "abc"), small(spark, "abcd")
    s.checkpoint(a)
    s.append(delta.diff(a, b), 1)
    s.append(delta.diff(b, small(spark, "abcde")), 2)
    source = store.Store(spark, f"file://{tmp_path}/t")
    source.checkpoint(a)
    stream = deltas.read_log(spark, f"{s.root}/log")
    with pytest.raises(ValueError, match="nothing was published"):
        deltas.stage(stream, source, f"{tmp_path}/c1", lambda space: space.nodes.where("label = 'e'"))
    assert source.version() == 0
    assert deltas.stage(deltas.read_log(spark, f"{s.root}/log"), source, f"{tmp_path}/c2") == 2
    assert delta.diff(source.open(), small(spark, "abcde")).count() == 0


def test_what_one_run_refused_another_does_not_publish(spark, tmp_path):
    a = small(spark, "a")
    bad, good, far = (store.Store(spark, f"file://{tmp_path}/{k}") for k in ("bad", "good", "far"))
    for s, names in ((bad, ["ax", "axy"]), (good, ["ag"]), (far, ["af"])):
        s.checkpoint(a)
        before = a
        for k, labels in enumerate(names, 1):
            after = small(spark, labels)
            s.append(delta.diff(before, after), k)
            before = after
    source = store.Store(spark, f"file://{tmp_path}/t")
    source.checkpoint(a)
    with pytest.raises(ValueError, match="nothing was published"):
        deltas.stage(deltas.read_log(spark, f"{bad.root}/log", 1), source, f"{tmp_path}/c1", lambda space: space.nodes.where("label = 'y'"))
    assert deltas.stage(deltas.read_log(spark, f"{bad.root}/log", 1), source, f"{tmp_path}/c1") == 0  # nothing is left of it
    assert deltas.stage(deltas.read_log(spark, f"{good.root}/log"), source, f"{tmp_path}/c2") == 1
    assert sorted(r["label"] for r in source.open().nodes.collect()) == sorted(r["label"] for r in small(spark, "ag").nodes.collect())
    with pytest.raises(ValueError, match="don't follow"):
        deltas.stage(deltas.read_log(spark, f"{far.root}/log"), source, f"{tmp_path}/c3")
    assert source.version() == 1


def test_guard_accepts_the_next_number_only(spark, tmp_path):
    spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1)], "site string, counter long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("site string, counter long").parquet(f"{tmp_path}/in")
    q = deltas.guarded(stream).writeStream.format("memory").queryName("guarded").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["site"], r["counter"]): r["accepted"] for r in spark.table("guarded").collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 3): False, ("b", 1): False}


def test_markdown_headings(spark):
    md = "# Top\ntext\n## A b!\n```\n# not\n```\n### Deep ##\n## A b\n# End"
    got = [tuple(r) for r in adapters.headings(spark.createDataFrame([(1, md)], "doc_id int, text string")).orderBy("line").collect()]
    assert got == [(1, 0, 1, "Top", "top", None), (1, 2, 2, "A b!", "a-b", 0), (1, 6, 3, "Deep", "deep", 2), (1, 7, 2, "A b", "a-b-1", 0), (1, 8, 1, "End", "end", None)]


def test_essay_spans_are_the_text(spark):
    docs = [(1, "One. Two!  Three?\nfour 3.5 five"), (2, ""), (3, None), (4, "é. ")]
    got = adapters.essay(spark.createDataFrame(docs, "doc_id int, text string")).collect()
    texts = dict(docs)
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] == r["sentence"] for r in got)
    assert [r["sentence"] for r in got if r["doc_id"] == 1] == ["One.", "Two!", "Three?", "four 3.5 five"]


def test_python_symbols_and_calls(spark):
    code = "class A:\n  def f(self):\n    g()\n    h()\ndef g():\n  A()\n"
    symbols = adapters.python_code(spark.createDataFrame([("m.py", code), ("bad.py", "def")], "path string, text string"))
    assert {(r["qualified"], r["kind"], r["line"]) for r in symbols.collect()} == {("A", "class", 1), ("A.f", "function", 2), ("g", "function", 5)}
    assert {(r["src"], r["dst"]) for r in adapters.call_edges(symbols).collect()} == {("A.f", "g"), ("A", "g"), ("g", "A")}


def test_text_functions(spark):
    row = spark.createDataFrame([("Café Ça VA-va 12", "ab", "2024-01-01T00:00:00Z", "1704067200")], "a string, b string, t string, s string")
    got = row.select(text.tokens(F.col("a")).alias("tokens"), text.fnv1a(F.col("b")).alias("fnv"), text.namespace_of(F.lit("x:y")).alias("ns"), text.timestamp_ms(F.col("t")).alias("t"), text.timestamp_ms(F.col("s")).alias("s"), text.nfc(F.lit("e\u0301")).alias("nfc"), text.excerpt(F.lit("a  b\nc"), 4).alias("x")).first()
    assert got["tokens"] == ["café", "ça", "va", "12"] and got["fnv"] == "4d2505ca" and got["ns"] == "x"
    assert got["t"] == got["s"] == 1704067200000 and got["nfc"] == "\u00e9" and got["x"] == "a b…"


def test_one_graph_and_the_spine_are_read_by_bucket(spark, tmp_path):
    from arborlake.model import Space

    graphs = [("root", "r")] + [(f"g{k}", f"g{k}") for k in range(20)]
    nodes = [("root", f"n{k}", "core:a", f"n{k}", f"g{k}") for k in range(20)] + [(f"g{k}", f"m{k}", "core:a", f"m{k}", None) for k in range(20)]
    edges = [("root", "e", "n0", "n1", "core:x", 1.0)] + [(f"g{k}", f"e{k}", f"m{k}", f"m{k}", "core:x", None) for k in range(20)]
    space, s = Space.of(spark, graphs, nodes, edges), store.Store(spark, f"file://{tmp_path}/s")
    s.checkpoint(space)
    one = s.graph("g3")
    assert [r["id"] for r in one.nodes.collect()] == ["m3"] and [r["id"] for r in one.edges.collect()] == ["e3"] and [r["id"] for r in one.graphs.collect()] == ["g3"]
    plan = one.nodes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)
    spine, shells = s.spine()
    assert {r["id"] for r in spine.nodes.collect()} == {f"n{k}" for k in range(20)} and shells.count() == 20 and [r["id"] for r in spine.edges.collect()] == ["e"]
    assert spine.graphs.count() == 21 and "bucket" in re.search(r"PartitionFilters: \[[^\]]*\]", spine.nodes._jdf.queryExecution().executedPlan().toString())[0]
    changed = space.with_(nodes=space.nodes.where("id <> 'm3'"), edges=space.edges.where("id <> 'e3'"))
    s.append(delta.diff(s.open(), changed), 1)
    assert s.graph("g3").nodes.isEmpty() and s.graph("g4").nodes.count() == 1 and s.spine()[0].nodes.count() == 20
