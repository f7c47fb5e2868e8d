"""Exports, proposals, labels and arithmetic against literals."""

import json

from pyspark.sql import functions as F

from arborlake.functions import geometry as g
from arborlake.model import Space
from arborlake.operators import assist, delta, proposals, views
from arborlake.sources import exports


def test_chat_exports(spark):
    flat = json.dumps([{"uuid": "c1", "chat_messages": [{"uuid": "m1", "sender": "human", "text": "hi"}, {"uuid": "m2", "sender": "assistant", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "x"}, {"type": "text", "text": "b"}]}]}])
    message = lambda role, text: {"author": {"role": role}, "content": {"parts": [text]}}
    tree = json.dumps({"conversation_id": "c2", "mapping": {"r": {"id": "r", "children": ["u"]}, "u": {"id": "u", "parent": "r", "children": ["b", "a"], "message": message("user", "q")}, "a": {"id": "a", "parent": "u", "children": [], "message": message("assistant", "second")}, "b": {"id": "b", "parent": "u", "children": ["c"], "message": message("assistant", "first")}, "c": {"id": "c", "parent": "b", "children": [], "message": message("user", "more")}}})
    got = exports.chat_messages(spark.createDataFrame([("1", flat), ("2", tree)], "doc string, text string")).orderBy("doc", "place").collect()
    assert [(r["id"], r["role"], r["text"]) for r in got if r["doc"] == "1"] == [("m1", "user", "hi"), ("m2", "assistant", "a\nb")]
    assert [r["id"] for r in got if r["doc"] == "2"] == ["u", "b", "c", "a"]


def test_imports_resolve_to_the_first_candidate(spark):
    files = spark.createDataFrame([("pkg/a.py",), ("pkg/sub/__init__.py",), ("top.py",), ("pkg/sub/b.py",)], "path string")
    asked = spark.createDataFrame([("pkg/sub/b.py", "top", 0), ("pkg/sub/b.py", "a", 2), ("pkg/a.py", "sub", 1), ("pkg/a.py", "none", 0)], "path string, module string, level int")
    got = {(r["path"], r["module"]): r["target"] for r in exports.resolved_imports(asked, files).collect()}
    assert got == {("pkg/sub/b.py", "top"): "top.py", ("pkg/sub/b.py", "a"): "pkg/a.py", ("pkg/a.py", "sub"): "pkg/sub/__init__.py", ("pkg/a.py", "none"): None}


def test_media_types(spark):
    rows = spark.createDataFrame([("a.MD", "x"), ("b.py", "x"), ("c.bin", "x\x00"), ("d", "x")], "path string, head string")
    assert [r[0] for r in rows.select(exports.media_type(F.col("path"), F.col("head"))).collect()] == ["markdown", "python", "binary", "text"]


def test_proposals_are_refused_or_applied(spark):
    s = Space.of(spark, [("g", "x")], [("g", i, "core:k", i, None) for i in "abcdef"], [("g", "e1", "a", "b", "r:r", 1.0), ("g", "e2", "c", "d", "r:r", 1.0), ("g", "e3", "c", "f", "r:r", 1.0)])
    p = spark.createDataFrame([("n1", "one", "a", 0.9), ("n1", "one", "b", 0.9), ("n2", "two", "c", 0.9), ("n2", "two", "d", 0.9), ("n3", "few", "e", 0.9), ("n4", "lost", "zz", 0.9), ("n4", "lost", "f", 0.9)], "group string, label string, member string, confidence double")
    codes = {(r["group"], r["code"]) for r in proposals.refusals(s, p).collect()}
    assert {("n2", "crosses-boundary"), ("n3", "too-small"), ("n4", "unknown-member")} <= codes and not any(x == "n1" for x, _ in codes)
    after = delta.apply(s, proposals.operations(s, p))
    assert {(r["graph_id"], r["id"]) for r in after.nodes.collect()} == {("g", "n1"), ("g1", "a"), ("g1", "b"), *(("g", i) for i in "cdef")}
    assert {r["graph_id"] for r in after.edges.where("id = 'e1'").collect()} == {"g1"}
    assert proposals.operations(s, p, least=0.95).count() == 0


def test_providers(spark):
    s = Space.of(spark, [("g", "x")], [("g", i, "core:k", i, None) for i in "abcde"], [("g", f"e{k}", a, b, "r:r", None) for k, (a, b) in enumerate([("a", "b"), ("a", "c"), ("d", "e")])])
    groups = {}
    for r in proposals.by_components(s, "g").collect():
        groups.setdefault(r["group"], set()).add(r["member"])
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["d", "e"]]
    assert {r["member"] for r in proposals.by_hubs(s, "g").collect()} == {"a", "b", "c"}


def test_greedy_match_labels_and_back_edges(spark):
    scores = spark.createDataFrame([("r", "a", "x", 0.9), ("r", "a", "y", 0.8), ("r", "b", "x", 0.7), ("r", "b", "y", 0.3)], "request string, a string, b string, score double")
    assert [(r["a"], r["b"]) for r in assist.greedy_match(scores).collect()] == [("a", "x")]
    items = spark.createDataFrame([("v", "a", 1, 1, 1, 0.0, 0.0, 20.0, 5.0), ("v", "b", 0, 1, 1, 10.0, 0.0, 20.0, 5.0), ("v", "c", 2, 1, 1, 100.0, 0.0, 20.0, 5.0)], "view string, id string, rank int, leaves int, degree int, x double, y double, w double, h double")
    assert {r["id"] for r in assist.label_plan(items).collect()} == {"b", "c"}
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("g", "c", "a"), ("g", "a", "c")], "graph_id string, src string, dst string")
    assert assist.back_edge_ratio(edges).first()["ratio"] == 0.25
    loops = spark.createDataFrame([("g", "a", "a"), ("g", "a", "b"), ("h", "c", "c"), ("k", "a", "b"), ("k", "b", "a"), ("k", "b", "a"), ("k", "b", "b")], "graph_id string, src string, dst string")
    assert {r["graph_id"]: r["ratio"] for r in assist.back_edge_ratio(loops).collect()} == {"g": 0.0, "h": 0.0, "k": 2 / 3}
    shape = spark.createDataFrame([("a", 5, 0, 5, 0.0, 0.0), ("b", 5, 3, 2, 0.5, 1.2), ("c", 5, 4, 2, 0.0, 1.6), ("d", 5, 8, 1, 0.5, 3.2), ("e", 9000, 8999, 1, 0.0, 2.0), ("f", 1, 1, 1, 0.0, 2.0)], "graph_id string, nodes int, edges int, components int, back double, degree double")
    assert {r["graph_id"]: r["provider"] for r in assist.layout_choice(shape).collect()} == {"a": "grid", "b": "tree", "c": "layered", "d": "force", "e": "tree", "f": "grid"}


def test_arithmetic(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert abs(value(g.screen_to_world(g.world_to_screen(F.lit(7.0), 2.0, 3.0, 100.0), 2.0, 3.0, 100.0)) - 7) < 1e-9
    assert abs(value(g.zoom_for_scale(g.scale_for_zoom(F.lit(0.3), 0.1, 8.0), 0.1, 8.0)) - 0.3) < 1e-9
    assert [value(g.ease_in_out_cubic(F.lit(t))) for t in (0.0, 0.5, 1.0)] == [0.0, 0.5, 1.0]
    assert value(g.backoff(F.lit(3), 100.0, 2.0, 500.0)) == 500.0 and value(g.cost(F.lit(1000), F.lit(500), 2.0, 4.0)) == 0.004
    state = {"a b": "é&=", "z": "1"}
    assert g.decode_state("#" + g.encode_state(state)) == state
    assert g.satisfies("1.4.0", "^1.2.3") and not g.satisfies("2.0.0", "^1.2.3") and g.satisfies("0.2.9", "~0.2.3") and not g.satisfies("0.3.0", "^0.2.3")


def test_detached_messages_are_kept(spark):
    node = lambda parent, *children: {"id": "", "parent": parent, "children": list(children), "message": {"author": {"role": "user"}, "content": {"parts": ["t"]}}}
    mapping = {"a": node(None, "b"), "b": node("a"), "c": node("lost"), "x": node("y", "y"), "y": node("x", "x")}
    rows = exports.chat_messages(spark.createDataFrame([("d", json.dumps({"conversation_id": "k", "mapping": mapping}))], "doc string, text string")).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["place"])] == ["a", "b", "c", "x", "y"]


def test_matrix_clusters(spark):
    edges = spark.createDataFrame([("a", "b", "k", 2.0), ("b", "c", "k", 1.0), ("d", "e", "k", 9.0), ("a", "z", "k", 99.0)], "src string, dst string, kind string, weight double")
    members = lambda parents: spark.createDataFrame(list(parents.items()), "id string, parent string")
    got = lambda df: {r["id"]: (r["cluster"], r["place"]) for r in df.collect()}
    flat = views.matrix_order(members(dict.fromkeys("abcdef", "p")), edges)
    assert got(flat) == {"a": ("a", 1), "b": ("a", 0), "c": ("a", 2), "d": ("d", 0), "e": ("d", 1), "f": ("~", 0)}
    nested = views.matrix_order(members({"a": "p", "b": "p", "f": "p", "c": None}), edges)
    assert got(nested) == {"b": ("p", 0), "a": ("p", 1), "f": ("p", 2), "c": ("", 0)}
