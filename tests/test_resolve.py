import random

import pytest

from arborlake.model import Space
from arborlake.operators import cut, forest, resolve


def made(spark, seed):
    """A ragged random forest with some empty and some unloaded insides."""
    rng, nodes, graphs, open_ = random.Random(seed), [], [("root", "root")], ["root"]
    while open_ and len(nodes) < 60:
        graph = open_.pop(0)
        for _ in range(rng.randrange(1, 5) if graph == "root" else rng.randrange(0, 4)):
            i, detail = f"n{len(nodes)}", None
            if rng.random() < 0.6:
                detail = f"g{len(graphs)}"
                graphs.append((detail, detail))
                open_.append(detail)
            nodes.append((graph, i, "core:a", i, detail))
    ids = [n[1] for n in nodes]
    edges = [("root", f"e{k}", rng.choice(ids), rng.choice(ids), "core:x", None) for k in range(80)]
    return rng, nodes, Space.of(spark, graphs, nodes, edges)


class Plain:
    """The rules, walked from the roots down."""

    def __init__(self, nodes, marks, cold, level):
        self.kids, self.node, self.parent = {}, {}, {}
        for graph, i, _, _, detail in nodes:
            self.kids.setdefault(graph, []).append(i)
            self.node[i] = (graph, detail)
        for i, (graph, _) in self.node.items():
            self.parent[i] = next((p for p, (_, d) in self.node.items() if d == graph), None)
        self.cold, self.level = cold, level
        given = {}
        for i, kind in sorted(marks, reverse=True):
            given[i] = kind
        self.ignored = {(i, k, "removed") for i, k in given.items() if i not in self.node}
        here = {i: k for i, k in given.items() if i in self.node}
        self.ignored |= {(i, k, "shadowed") for i, k in here.items() if any(here.get(a) == "pin" for a in self.above(i))}
        self.marks = {i: k for i, k in here.items() if (i, k, "shadowed") not in self.ignored}
        self.needed = {a for i, k in self.marks.items() if k in ("pin", "expand") for a in self.above(i)}
        self.members = {}
        self.visit("root", 0)

    def above(self, i):
        out = []
        while (i := self.parent[i]) is not None:
            out.append(i)
        return out

    def inside(self, i):
        return self.kids.get(self.node[i][1], [])

    def visit(self, graph, depth):
        for i in self.kids.get(graph, []):
            mark, leaf, is_cold = self.marks.get(i), not self.inside(i), self.node[i][1] in self.cold and self.node[i][1] is not None
            if mark == "pin":
                reason = "pin"
            elif mark == "expand":
                reason = "cold" if is_cold else "leaf" if leaf else None
            elif mark == "collapse":
                reason = None if not leaf and i in self.needed else "collapse"
            elif leaf:
                reason = "cold" if is_cold and depth < self.level else "leaf"
            elif depth < self.level or i in self.needed:
                reason = None
            else:
                reason = "level" if depth == self.level else "expand-parent"
            if reason is None:
                self.visit(self.node[i][1], depth + 1)
            else:
                self.members[i] = reason

    def frontier(self, protected):
        kept = {x for i in protected for x in (i, *self.above(i))}
        out = {(i, "expand") for i in self.members if self.inside(i) or self.node[i][1] in self.cold} | {(i, "hydrate") for i in self.members if self.node[i][1] in self.cold}
        for i in self.members:
            p = self.parent[i]
            if p is not None and all(c in self.members and c not in kept for c in self.inside(p)):
                out.add((i, "collapse"))
        return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_rules_walked_down(spark, seed):
    rng, nodes, space = made(spark, seed)
    tree = forest.forest(space)
    marks = [(rng.choice(nodes)[1], rng.choice(["pin", "expand", "expand", "collapse", "collapse"])) for _ in range(9)] + [("lost", "pin")]
    empty = [n[4] for n in nodes if n[4] and not any(m[0] == n[4] for m in nodes)]
    cold, level = set(empty[::2]) | {n[4] for n in nodes[:9:3] if n[4]}, 1 + seed % 2
    plain = Plain(nodes, marks, cold, level)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    overrides, not_loaded = frame(marks, "id string, kind string"), frame([(c,) for c in cold], "graph_id string")
    members = cut.override_cut(tree, level, overrides, not_loaded)
    assert {r["id"]: r["reason"] for r in members.collect()} == plain.members
    effective, ignored = cut.effective_overrides(tree, overrides)
    assert {tuple(r) for r in ignored.collect()} == plain.ignored and {tuple(r) for r in effective.collect()} == set(plain.marks.items())
    proof = cut.coverage(tree, members).first()
    assert proof["covered_once"] == proof["total_leaves"] and proof["covered_twice"] == 0
    protected = [i for i, k in plain.marks.items() if k != "collapse"]
    got = cut.frontier(tree, members, frame([(i,) for i in protected], "id string"), not_loaded)
    assert {tuple(r) for r in got.collect()} == plain.frontier(protected)


def test_resolve_with_a_budget_and_a_focus(spark):
    nodes, space = next((n, s) for _, n, s in (made(spark, k) for k in range(7, 99)) if len(n) > 40)
    deep = max(nodes, key=lambda n: len(Plain(nodes, [], set(), 9).above(n[1])))[1]
    whole = resolve.resolve(space, resolve.Request(1.0))
    assert {r["id"] for r in whole.members.collect()} == set(Plain(nodes, [], set(), 99).members) and not whole.exceeded
    small = resolve.resolve(space, resolve.Request(1.0, focus=deep, max_nodes=8))
    members = {r["id"]: r["reason"] for r in small.members.collect()}
    proof = cut.coverage(forest.forest(space), small.members).first()
    assert proof["covered_once"] == proof["total_leaves"] and deep in members and "budget" in members.values()
    assert small.exceeded == (len(members) > 8)
    assert small.edges.where("src = dst").isEmpty()


def test_levels_and_hysteresis(spark):
    assert resolve.level_chain(2, ["a", "b", "c"]) == ["a", "b", "c"] and resolve.level_chain(2, ["a", "b"]) == ["level-0", "level-1", "level-2"] and resolve.level_chain(-1) == []
    steps = [0.25, 0.5, 0.75]
    assert [cut.level_for_zoom(z, steps, b) for z, b in ((0.5, None), (0.51, 1), (0.53, 1), (0.48, 2), (0.47, 2), (0.9, 0), (0.3, 9))] == [(2, 2), (1, 2), (2, 2), (2, 1), (1, 1), (3, 3), (1, 1)]
    _, _, space = made(spark, 3)
    with pytest.raises(ValueError):
        resolve.resolve(space, resolve.Request(0.5), steps=[0.6, 0.4])


def test_an_empty_space(spark):
    space = Space.of(spark, [("root", "r")], [("root", "a", "core:a", "a", None)], [])
    none = space.with_(nodes=space.nodes.limit(0), graphs=space.graphs.limit(0))
    found = resolve.resolve(none, resolve.Request(0.5))
    assert found.members.isEmpty() and found.frontier.isEmpty() and found.levels == [] and found.level == 0
