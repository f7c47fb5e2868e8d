import json
import random

import pytest

from arborlake.model import Space
from arborlake.operators import ordered

KINDS = ["demo:a", "demo:b"]


class Refused(Exception):
    pass


class Plain:
    """One operation after the other."""

    def __init__(self, graphs, nodes, edges):
        self.graphs = {g: dict(label=l, domain="core", origin="source") for g, l in graphs}
        self.nodes = {i: dict(graph=g, kind=k, label=l, detail=d, attrs={}, origin="source") for g, i, k, l, d in nodes}
        self.edges = {i: dict(graph=g, src=s, dst=d, kind=k, weight=w, attrs={}, origin="source") for g, i, s, d, k, w in edges}

    def holder(self, graph):
        return next(((n["graph"], i) for i, n in self.nodes.items() if n["detail"] == graph), None)

    def claim(self, host, target):
        if target not in self.graphs:
            raise Refused("unknown-detail-graph")
        if self.holder(target):
            raise Refused("detail-not-root")
        at = host
        while at is not None:
            if at == target:
                raise Refused("containment-cycle")
            at = (self.holder(at) or (None,))[0]

    def fresh(self, i):
        if i in self.graphs or i in self.nodes or i in self.edges:
            raise Refused("duplicate-id")

    def run(self, t, graph_id, id_, key, prev, next_):
        x = json.loads(next_) if next_ is not None and t not in ("node:attr", "node:detail") else None
        said = json.loads(prev) if prev is not None and t not in ("node:attr", "node:detail") else None
        if t == "graph:add":
            self.fresh(graph_id)
            self.graphs[graph_id] = x
            return
        if graph_id not in self.graphs:
            raise Refused("unknown-graph")
        if t == "graph:remove":
            if any(e["graph"] == graph_id for e in [*self.nodes.values(), *self.edges.values()]):
                raise Refused("graph-not-empty")
            if self.holder(graph_id):
                raise Refused("graph-contained")
            if said is not None and said != self.graphs[graph_id]:
                raise Refused("op-conflict")
            del self.graphs[graph_id]
        elif t == "graph:meta":
            if said is not None and said != self.graphs[graph_id]:
                raise Refused("op-conflict")
            self.graphs[graph_id] = x
        elif t == "node:add":
            self.fresh(id_)
            if x.get("detail_graph"):
                self.claim(graph_id, x["detail_graph"])
            self.nodes[id_] = dict(graph=graph_id, kind=x["kind"], label=x["label"], detail=x.get("detail_graph"), attrs=dict(x.get("attrs") or {}), origin=x["origin"])
        elif t == "edge:add":
            self.fresh(id_)
            for end in (x["src"], x["dst"]):
                if end not in self.nodes:
                    raise Refused("unknown-node")
                if self.nodes[end]["graph"] != graph_id:
                    raise Refused("cross-graph-edge")
            self.edges[id_] = dict(graph=graph_id, src=x["src"], dst=x["dst"], kind=x["kind"], weight=x.get("weight"), attrs={}, origin=x["origin"])
        elif t == "edge:remove":
            if id_ not in self.edges or self.edges[id_]["graph"] != graph_id:
                raise Refused("unknown-edge")
            e = self.edges[id_]
            if said is not None and (said["kind"], said["src"], said["dst"], said.get("weight"), said["origin"]) != (e["kind"], e["src"], e["dst"], e["weight"], e["origin"]):
                raise Refused("op-conflict")
            del self.edges[id_]
        else:
            n = self.nodes.get(id_)
            if n is None or n["graph"] != graph_id:
                raise Refused("unknown-node")
            if t == "node:remove":
                if any(id_ in (e["src"], e["dst"]) for e in self.edges.values()):
                    raise Refused("node-has-edges")
                if said is not None and (said["kind"], said["label"], said["origin"], said.get("detail_graph"), said.get("attrs") or {}) != (n["kind"], n["label"], n["origin"], n["detail"], n["attrs"]):
                    raise Refused("op-conflict")
                del self.nodes[id_]
            elif t == "node:attr":
                if prev is not None and prev != n["attrs"].get(key):
                    raise Refused("op-conflict")
                n["attrs"].pop(key, None)
                if next_ is not None:
                    n["attrs"][key] = next_
            else:
                if prev is not None and prev != n["detail"]:
                    raise Refused("op-conflict")
                if next_ != n["detail"]:
                    old, n["detail"] = n["detail"], None
                    try:
                        if next_ is not None:
                            self.claim(graph_id, next_)
                    except Refused:
                        n["detail"] = old
                        raise
                    n["detail"] = next_


GRAPHS = [("root", "r"), ("g1", "one"), ("g2", "two"), ("g3", "three")]
NODES = [("root", "a", "demo:a", "A", "g1"), ("root", "b", "demo:a", "B", None), ("g1", "c", "demo:b", "C", "g2"), ("g2", "d", "demo:b", "D", None), ("g2", "e", "demo:b", "E", None)]
EDGES = [("root", "ab", "a", "b", "demo:x", 1.0), ("g2", "de", "d", "e", "demo:x", None)]


def guess(rng, plain):
    """An operation that fits more often than not."""
    graphs, nodes, edges = ([*x, y] for x, y in ((plain.graphs, "g9"), (plain.nodes, "z9"), (plain.edges, "e9")))
    some, t = rng.choice, rng.choice(ordered.TYPES)
    node, edge = some(nodes), some(edges)
    graph = plain.nodes.get(node, {"graph": "root"})["graph"]
    detail = rng.choice([None, None, some(graphs)])
    name = some([f"i{rng.randrange(40)}", node, edge])
    if rng.random() < 0.05:
        graph = some(graphs)
    meta = dict(label=some("xyz"), domain="core", origin="source")
    if t.startswith("graph:"):
        graph = some([*graphs, f"g{rng.randrange(12)}"])
        prev = json.dumps(plain.graphs.get(graph, meta)) if rng.random() < 0.4 else json.dumps(meta) if rng.random() < 0.1 else None
        return (t, graph, graph, None, None if t == "graph:add" else prev, None if t == "graph:remove" else json.dumps(meta))
    if t == "node:add":
        x = dict(id=name, kind=some(KINDS), label="n", origin="derived", attrs={"demo:k": "1"} if rng.random() < 0.5 else None, detail_graph=detail)
        return (t, graph, name, None, None, json.dumps({k: v for k, v in x.items() if v is not None}))
    if t == "edge:add":
        here = [n for n, x in plain.nodes.items() if x["graph"] == graph] or ["z9"]
        x = dict(id=name, src=some(here), dst=some(here) if rng.random() < 0.9 else some(nodes), kind="demo:x", origin="ai")
        return (t, graph, name, None, None, json.dumps(x))
    if t == "edge:remove":
        e = plain.edges.get(edge)
        prev = json.dumps({k: v for k, v in (e | {"weight": e["weight"] if rng.random() < 0.8 else 7.5}).items() if k not in ("graph", "attrs") and v is not None}) if e and rng.random() < 0.4 else None
        return (t, e["graph"] if e and rng.random() < 0.95 else graph, edge, None, prev, None)
    n = plain.nodes.get(node)
    if t == "node:remove":
        prev = None
        if n and rng.random() < 0.5:
            x = dict(kind=n["kind"], label=n["label"], origin=n["origin"], detail_graph=n["detail"], attrs=n["attrs"] if rng.random() < 0.8 else {"demo:q": "2"})
            prev = json.dumps({k: v for k, v in x.items() if v})
        return (t, graph, node, None, prev, None)
    if t == "node:attr":
        key = some(["demo:k", "demo:q"])
        prev = (n or {"attrs": {}})["attrs"].get(key) if rng.random() < 0.5 else some([None, "5"])
        return (t, graph, node, key, prev, some([None, "1", '"t"', "[1,2]"]))
    prev = (n or {"detail": None})["detail"] if rng.random() < 0.5 else some([None, None, "g2"])
    return (t, graph, node, None, prev, detail)


def deltas(n=320, length=12):
    """Random deltas, and for each what plain application says: (delta, i, code), and the space of those that fit."""
    rng, rows, want, after = random.Random(11), [], {}, {}
    for k in range(n):
        plain, i = Plain(GRAPHS, NODES, EDGES), 0
        while i < length:
            op = guess(rng, plain)
            try:
                plain.run(*op)
            except Refused as e:
                if k not in want and rng.random() < (1, 0.3, 0.7, 0.9)[k % 4]:  # most wrong guesses are left out, so that deltas get somewhere
                    continue
                want.setdefault(k, (i, str(e)))
            rows.append((k, i, *op))
            i += 1
        if k not in want:
            after[k] = plain
    return rows, want, after


@pytest.fixture(scope="module")
def space(spark):
    return Space.of(spark, GRAPHS, NODES, EDGES)


def frame(spark, rows):
    return spark.createDataFrame(rows, ordered.OPERATIONS).repartition(3)


def test_equals_one_operation_after_the_other(spark, space):
    rows, want, after = deltas()
    got = {r["delta"]: (r["i"], r["code"]) for r in ordered.rejections(space, frame(spark, rows)).collect()}
    assert {k: (want.get(k), got.get(k)) for k in set(want) | set(got) if want.get(k) != got.get(k)} == {}
    assert len({c for _, c in want.values()}) >= 11 and len(after) > 10 and len(want) > 60
    for k in list(after)[:2]:
        out, refused = ordered.apply(space, frame(spark, [r for r in rows if r[0] == k]))
        plain = after[k]
        assert refused.isEmpty()
        assert {(r["id"], r["label"]) for r in out.graphs.collect()} == {(g, x["label"]) for g, x in plain.graphs.items()}
        assert {(r["graph_id"], r["id"], r["detail_graph"], tuple(sorted((r["attrs"] or {}).items()))) for r in out.nodes.collect()} == {(n["graph"], i, n["detail"], tuple(sorted(n["attrs"].items()))) for i, n in plain.nodes.items()}
        assert {(r["graph_id"], r["id"], r["src"], r["dst"]) for r in out.edges.collect()} == {(e["graph"], i, e["src"], e["dst"]) for i, e in plain.edges.items()}


def test_codes_of_payloads(spark, space):
    node = lambda **x: json.dumps({"id": "n", "kind": "demo:a", "label": "l", "origin": "source"} | x)
    edge = lambda **x: json.dumps({"id": "n", "kind": "demo:a", "src": "a", "dst": "b", "origin": "source"} | x)
    meta = lambda **x: json.dumps({"label": "l", "domain": "d", "origin": "source"} | x)
    cases = [
        (("node:add", "root", "n", None, None, node()), None),
        (("node:add", "root", "", None, None, node(id="")), "invalid-id"),
        (("node:add", "root", "n\x1f", None, None, node(id="n\x1f")), "invalid-id"),
        (("node:add", "root", "n", None, None, node(kind="Demo")), "invalid-kind"),
        (("node:add", "root", "n", None, None, node(attrs={"x": "1"})), "invalid-attr-key"),
        (("node:add", "root", "n", None, None, node(attrs={"core:x": "1"})), "reserved-core-key"),
        (("node:add", "root", "n", None, None, node(attrs={"demo:x": '[1,"a"]'})), "invalid-attr-value"),
        (("node:add", "root", "n", None, None, node(origin="unknown")), "invalid-provenance"),
        (("node:add", "root", "n", None, None, node(detail_graph="")), "invalid-id"),
        (("node:add", "root", "n", None, None, "{"), "invalid-op"),
        (("node:grow", "root", "n", None, None, None), "invalid-op"),
        ((None, "root", "n", None, None, None), "invalid-op"),
        (("node:add", None, "n", None, None, node()), "unknown-graph"),
        (("edge:add", "root", "n", None, None, '{"id":"n","kind":"demo:a","src":"a","dst":"b","origin":"ai","weight":NaN}'), "invalid-weight"),
        (("edge:add", "root", "n", None, None, edge(src="")), "invalid-id"),
        (("edge:add", "root", "n", None, None, edge(dst="d")), "cross-graph-edge"),
        (("edge:add", "root", "n", None, None, edge(dst="q")), "unknown-node"),
        (("edge:add", "root", "ab", None, None, edge(dst="q", id="ab")), "duplicate-id"),
        (("graph:add", "h", "h", None, None, meta(domain="")), "invalid-domain"),
        (("graph:add", "h", "h", None, None, meta(origin="?")), "invalid-provenance"),
        (("graph:add", "h", "h", None, None, meta()), None),
        (("graph:meta", "g3", "g3", None, meta(), meta()), "op-conflict"),
        (("node:attr", "root", "a", "demo:x", None, "{}"), "invalid-attr-value"),
        (("node:attr", "root", "a", "core:x", None, "1"), "reserved-core-key"),
        (("node:attr", "root", "a", None, None, "1"), "invalid-attr-key"),
        (("node:attr", "root", "a", "demo:x", None, '["a\\"b","c"]'), None),
        (("node:detail", "g2", "d", None, None, "root"), "containment-cycle"),
        (("node:detail", "root", "b", None, None, "root"), "containment-cycle"),
        (("node:detail", "root", "b", None, None, "g2"), "detail-not-root"),
        (("node:detail", "root", "a", None, "g1", "g1"), None),
    ]
    got = {r["delta"]: r["code"] for r in ordered.rejections(space, frame(spark, [(k, 0, *op) for k, (op, _) in enumerate(cases)])).collect()}
    assert [got.get(k) for k in range(len(cases))] == [c for _, c in cases]


def test_envelopes_and_composition(spark, space):
    ops = frame(spark, [(k, 0, "node:attr", "root", "a" if k != 4 else "ghost", "demo:x", None, "1") for k in (0, 1, 2, 4)])
    envelopes = spark.createDataFrame([(0, 7, "s", "me"), (1, 6, "s", "me"), (2, None, None, ""), (3, None, None, "me"), (4, None, None, "me")], "delta long, base_counter long, base_site string, actor string")
    got = {(r["delta"], r["i"], r["code"]) for r in ordered.rejections(space, ops, envelopes, (7, "s")).collect()}
    assert got == {(1, None, "stale-delta"), (2, None, "invalid-delta"), (3, None, "empty-delta"), (4, 0, "unknown-node")}
    log = spark.createDataFrame([("s", 3, i, "node:attr", "root", "a", "demo:x", None, str(i)) for i in range(3)] + [("s", 4, 5, "node:attr", "root", "b", "demo:x", None, "9")], "site string, counter long, i long, t string, graph_id string, id string, key string, prev string, next string")
    one, gaps = ordered.composed(log)
    assert gaps.isEmpty() and sorted((r["i"], r["next"]) for r in one.collect()) == [(0, "0"), (1, "1"), (2, "2"), (3, "9")]
    after, refused = ordered.apply(space, one.select("delta", "i", "t", "graph_id", "id", "key", "prev", "next"))
    assert refused.isEmpty() and {r["id"]: r["attrs"] for r in after.nodes.where("id in ('a', 'b')").collect()} == {"a": {"demo:x": "2"}, "b": {"demo:x": "9"}}
    none, gaps = ordered.composed(log.where("counter = 4").unionByName(log.where("counter = 3").withColumn("counter", log["counter"] - 1)))
    assert none.isEmpty() and [tuple(r) for r in gaps.collect()] == [("s", 4, "non-consecutive-deltas")]


def test_nothing_to_apply(spark, space):
    assert ordered.rejections(space, spark.createDataFrame([], ordered.OPERATIONS)).collect() == []
