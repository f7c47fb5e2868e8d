"""Random forests against plain recursive versions, and the engine's parts against small literals."""

import random

import pytest
from pyspark.sql import functions as F

from arborlake.model import Space
from arborlake.operators import cut, delta, forest, induced, query, shape, validate


def made(spark, seed):
    """A ragged random forest with edges, and the same as plain dicts."""
    rng = random.Random(seed)
    graphs, nodes, edges = [("g0", "root")], [], []
    work = [("g0", 0)]
    while work:
        graph, depth = work.pop()
        for _ in range(rng.randrange(1, 4)):
            i = f"n{len(nodes)}"
            detail = None
            if depth < 3 and rng.random() < 0.6:
                detail = f"g{len(graphs)}"
                graphs.append((detail, detail))
                if rng.random() < 0.9:
                    work.append((detail, depth + 1))
            nodes.append((graph, i, rng.choice(["core:a", "core:b"]), f"Label {i} é", detail))
    for k in range(40):
        a, b = rng.choice(nodes), rng.choice(nodes)
        edges.append((a[0], f"e{k}", a[1], b[1], rng.choice(["rel:a", "rel:b"]), rng.choice([None, 1.0, 3.0])))
    return Space.of(spark, graphs, nodes, edges), graphs, nodes, edges


def paths(nodes):
    held = {n[4]: n for n in nodes if n[4]}
    out = {}
    for n in nodes:
        p, at = [n[1]], n
        while at[0] in held:
            at = held[at[0]]
            p.insert(0, at[1])
        out[n[1]] = p
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_cut_and_induced_edges(spark, seed):
    space, _, nodes, edges = made(spark, seed)
    p = paths(nodes)
    inside = {n[0] for n in nodes}
    leaf = {n[1] for n in nodes if n[4] not in inside}
    tree = forest.forest(space)
    got = {r["id"]: r for r in tree.collect()}
    assert set(got) == set(p)
    for i, r in got.items():
        assert r["path"] == p[i] and r["depth"] == len(p[i]) - 1 and r["is_leaf"] == (i in leaf)
        assert r["leaves"] == sum(i in p[x] for x in leaf) and r["size"] == sum(i in p[x] for x in p)
    for level in (0, 1, 2):
        members = cut.build_cut(tree, level)
        want = {i for i in p if len(p[i]) - 1 == level or (i in leaf and len(p[i]) - 1 < level)}
        assert {r["id"] for r in members.collect()} == want
        proof = cut.coverage(tree, members).first()
        assert proof["covered_once"] == proof["total_leaves"] == len(leaf)
        cover = {i: next((x for x in reversed(p[i]) if x in want), None) for i in p}
        plain = {}
        for _, e, a, b, kind, w in edges:
            if cover[a] and cover[b] and cover[a] != cover[b]:
                row = plain.setdefault((cover[a], cover[b], kind), [0.0, 0, []])
                row[0] += 1.0 if w is None else w
                row[1] += 1
                row[2].append(e)
        found = {(r["src"], r["dst"], r["kind"]): [r["weight"], r["multiplicity"], r["samples"]] for r in induced.induced_edges(space.edges, induced.node_cover(tree, members)).collect()}
        assert found == {k: [v[0], v[1], sorted(v[2])[:3]] for k, v in plain.items()}


@pytest.mark.parametrize("seed", [4, 5])
def test_override_cut_covers_every_leaf_once(spark, seed):
    space, _, nodes, _ = made(spark, seed)
    rng = random.Random(seed)
    marks = [(rng.choice(nodes)[1], rng.choice(["pin", "expand", "collapse"])) for _ in range(5)]
    tree = forest.forest(space)
    members = cut.override_cut(tree, 1, spark.createDataFrame(marks, "id string, kind string"))
    proof = cut.coverage(tree, members).first()
    assert proof["covered_once"] == proof["total_leaves"] and proof["covered_twice"] == 0


def test_budget_cut_equals_a_plain_greedy(spark):
    space, _, nodes, _ = made(spark, 6)
    tree = forest.forest(space)
    p = paths(nodes)
    score = {i: (int(i[1:]) * 7 % 11) / 11 for i in p}
    scores = spark.createDataFrame(list(score.items()), "id string, salience double")
    start = cut.build_cut(tree, 2)
    want = {r["id"] for r in start.collect()}
    kids = {}
    for i, path in p.items():
        if len(path) > 1:
            kids.setdefault(path[-2], []).append(i)
    limit = max(2, len(want) // 2)
    while len(want) > limit:
        ready = [(min(score[c] for c in cs), q) for q, cs in kids.items() if all(c in want for c in cs)]
        if not ready:
            break
        q = min(ready)[1]
        want = want - set(kids[q]) | {q}
    assert {r["id"] for r in cut.budget_cut(tree, start, scores, limit).collect()} == want


@pytest.mark.parametrize(("a", "b"), [(1, 2), (2, 3)])
def test_diff_replays_and_inverts(spark, a, b):
    x, y = made(spark, a)[0], made(spark, b)[0]
    ops = delta.diff(x, y)
    assert delta.diff(delta.apply(x, ops), y).count() == 0
    assert delta.diff(delta.apply(y, delta.invert(ops)), x).count() == 0
    assert delta.diff(x, x).count() == 0


def test_attribute_changes(spark):
    x = made(spark, 1)[0]
    first = x.nodes.agg(F.min("id")).first()[0]
    y = x.with_(nodes=x.nodes.withColumn("attrs", F.when(F.col("id") == first, F.create_map(F.lit("a:b"), F.lit("1")))))
    ops = delta.diff(x, y).collect()
    assert [(o["t"], o["id"], o["key"], o["prev"], o["next"]) for o in ops] == [("node:attr", first, "a:b", None, "1")]
    assert delta.prev_conflicts(y, delta.diff(x, y)).first()["actual"] == "1"


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"v{rng.randrange(200)}", f"v{rng.randrange(200)}") for _ in range(130)] + [(f"c{k}", f"c{k + 1}") for k in range(60)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for u, v in edges:
        if u != v:
            parent[find(u)] = find(v)
    groups = {}
    for v in parent:
        groups.setdefault(find(v), []).append(v)
    want = {v: min(g) for g in groups.values() for v in g}
    got = shape.components(spark.createDataFrame(edges, "src string, dst string"))
    assert {r["id"]: r["component"] for r in got.collect()} == want


def test_kmeans_finds_separate_groups(spark):
    rng = random.Random(5)
    rows = [(i, [float(i % 3 == k) * 5 + rng.random() * 0.2 for k in range(3)]) for i in range(90)]
    got = {r["id"]: r["cluster"] for r in shape.kmeans(spark.createDataFrame(rows, "id long, v array<double>"), 3).collect()}
    assert len({(i % 3, c) for i, c in got.items()}) == 3


def test_query_and_search(spark):
    space, _, nodes, edges = made(spark, 1)
    q = query.NodeQuery(space)
    assert {r["id"] for r in q.by_kind("core:a").ids().collect()} == {n[1] for n in nodes if n[2] == "core:a"}
    assert {r["id"] for r in q.text("LABEL é n1").ids().collect()} == {"n1"}
    assert q.within("g0").within("g1").ids().count() == 0
    near = {e[3] for e in edges if e[2] == "n0"} | {e[2] for e in edges if e[3] == "n0"}
    assert {r["id"] for r in q.neighbors_of("n0").ids().collect()} == near
    assert query.search_labels(space.nodes, "").count() == 0


def test_issues_of_a_broken_space(spark):
    s = Space.of(spark, [("g", "x"), ("a", "x"), ("b", "x")], [("g", "n", "Bad", "x", "nowhere"), ("a", "p", "core:k", "x", "b"), ("b", "q", "core:k", "x", "a"), ("g", "r", "core:k", "x", "b")], [("g", "e", "n", "p", "core:k", 1.0), ("g", "n", "n", "n", "core:k", float("nan"))])
    codes = sorted(r["code"] for r in validate.validate(s).collect())
    assert codes == sorted(["invalid-kind", "dangling-detail-ref", "dangling-edge-endpoint", "duplicate-id", "multiple-containment", "containment-cycle", "invalid-weight"])


@pytest.mark.parametrize("seed", range(2))
def test_budget_turns_with_ties_and_protected_nodes(spark, seed):
    space, _, nodes, _ = made(spark, 6 + seed)
    tree = forest.forest(space)
    p = paths(nodes)
    score = {i: (int(i[1:]) * 7 % 5) / 5 for i in p}
    held = {sorted(p)[-1 - seed % len(p)]}
    start = cut.build_cut(tree, 3)
    want = {r["id"] for r in start.collect()}
    kids = {}
    for i, path in p.items():
        if len(path) > 1:
            kids.setdefault(path[-2], []).append(i)
    limits = (max(1, len(want) // 2), 1)
    for limit in limits:
        now = set(want)
        while len(now) > limit:
            ready = [(min(score[c] for c in cs), q) for q, cs in kids.items() if q not in held and all(c in now and c not in held for c in cs)]
            if not ready:
                break
            q = min(ready)[1]
            now = now - set(kids[q]) | {q}
        got = cut.budget_cut(tree, start, spark.createDataFrame(list(score.items()), "id string, salience double"), limit, spark.createDataFrame([(i,) for i in held], "id string"))
        assert {r["id"] for r in got.collect()} == now


def test_deep_chains_are_read_whole(spark):
    n = 12
    s = Space.of(spark, [(f"g{k}", "") for k in range(n)], [(f"g{k}", f"n{k}", "core:k", "x", f"g{k + 1}" if k + 1 < n else None) for k in range(n)], [])
    tree = forest.forest(s, measures=False)
    assert forest.max_depth(tree).first()[0] == n - 1


def test_net_leads_where_the_deltas_lead(spark):
    import random
    from functools import reduce

    from arborlake.operators import delta

    rng = random.Random(3)

    def version(k):
        rng.seed(k)
        graphs = [(f"g{i}", f"l{rng.randrange(2)}") for i in range(3) if i == 0 or rng.random() < 0.7]
        nodes = [(rng.choice(graphs)[0], f"n{i}", "core:k", f"x{rng.randrange(2)}", rng.choice([None, *[g for g, _ in graphs]])) for i in range(8) if rng.random() < 0.8]
        ids = [x[1] for x in nodes]
        edges = [("g0", f"e{i}", rng.choice(ids), rng.choice(ids), "r:r", float(rng.randrange(2))) for i in range(5) if rng.random() < 0.7]
        s = Space.of(spark, graphs, nodes, edges)
        attrs = F.when(F.rand(k) < 0.6, F.create_map(F.lit("a:b"), F.lit(str(k)), F.lit("a:c"), F.lit("1")))
        return s.with_(nodes=spark.createDataFrame(s.nodes.withColumn("attrs", attrs).collect(), s.nodes.schema))

    versions = [version(k) for k in range(5)]
    log = [delta.diff(a, b).withColumn("counter", F.lit(k).cast("long")) for k, (a, b) in enumerate(zip(versions, versions[1:], strict=False))]
    log = [spark.createDataFrame(x.collect(), x.schema).coalesce(1) for x in log]
    for n in (2, 4):
        net = delta.net(reduce(lambda a, b: a.unionByName(b), log[:n]))
        now = delta.apply(versions[0], spark.createDataFrame(net.collect(), net.schema).coalesce(1))
        for name in ("graphs", "nodes", "edges"):
            want, got = (getattr(x, name) for x in (versions[n], now))
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
