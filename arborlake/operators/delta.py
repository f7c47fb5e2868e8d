"""Changes of a space: diff, operations, inversion, replay and summaries.

An operation is a row: phase, t, graph_id, id, key, prev, next (prev and next are canonical JSON of what was and what comes).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Space

NODE = ["graph_id", "id", "kind", "label", "detail_graph", "attrs", "origin"]
EDGE = ["graph_id", "id", "src", "dst", "kind", "weight", "attrs", "origin"]
OP = ["phase", "t", "graph_id", "id", "key", "prev", "next"]


def _op(phase: int, t: str, side: str, prev: Column | None = None, next_: Column | None = None, key: Column | None = None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    id_ = F.col(f"{side}.id")
    graph = F.col(f"{side}.graph_id") if t.split(":")[0] != "graph" else id_
    return F.struct(F.lit(phase).alias("phase"), F.lit(t).alias("t"), graph.alias("graph_id"), id_.alias("id"), text(key).alias("key"), text(prev).alias("prev"), text(next_).alias("next"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: the rows of both by id; what only one side has is null on the other."""
    return a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "full").select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b"))


def _unfolded(pairs: DataFrame, ops: Column, **more: Column) -> DataFrame:
    """One row for each operation in an array: pairs are joined once, however many kinds of operations are made of them."""
    return pairs.select(F.explode(F.array_compact(ops)).alias("o"), *[c.alias(name) for name, c in more.items()]).select("o.*", *more)


def _json(cols: list[str], side: str) -> Column:
    """Attributes are written with sorted keys, so equal rows have equal texts."""
    value = lambda c: F.map_from_entries(F.array_sort(F.map_entries(F.col(f"{side}.attrs")))).alias(c) if c == "attrs" else F.col(f"{side}.{c}").alias(c)
    return F.to_json(F.struct(*[value(c) for c in cols]))


def diff(a: Space, b: Space, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Operations that lead from one space to another, ordered by phase: edges go, nodes go, graphs go, graphs come, graph labels
    change, nodes come, details change, attributes change, edges come. A node whose kind, label, origin or graph changes goes and
    comes, and so do the edges at it.

    Each part goes through keep(df, name), which may write it (scratch.written): then no two parts hold their shuffles at a time.
    """
    meta = ["label", "domain", "origin"]
    g = _pairs(*(s.graphs.select("id", *meta) for s in (a, b)))
    named = F.expr("a.id is not null and b.id is not null and not (" + " and ".join(f"a.{c} <=> b.{c}" for c in meta) + ")")
    graphs = _unfolded(g, F.array(
        F.when(F.expr("b.id is null"), _op(3, "graph:remove", "a", _json(meta, "a"))),
        F.when(F.expr("a.id is null"), _op(4, "graph:add", "b", None, _json(meta, "b"))),
        F.when(named, _op(5, "graph:meta", "b", _json(meta, "a"), _json(meta, "b"))),
    ))
    graphs = keep(graphs, "graph_ops")
    n = _pairs(a.nodes.select(NODE), b.nodes.select(NODE))
    core = " and ".join(f"a.{c} <=> b.{c}" for c in ("graph_id", "kind", "label", "origin"))
    both = "a.id is not null and b.id is not null"
    stay = F.expr(f"{both} and {core}")
    none = F.array().cast("array<string>")
    keys = F.when(stay, F.array_union(F.coalesce(F.map_keys("a.attrs"), none), F.coalesce(F.map_keys("b.attrs"), none))).otherwise(none)
    at = lambda side, k: F.try_element_at(f"{side}.attrs", k)
    attrs = F.transform(F.filter(keys, lambda k: ~at("a", k).eqNullSafe(at("b", k))), lambda k: _op(8, "node:attr", "a", at("a", k), at("b", k), k))
    nodes = _unfolded(n, F.concat(F.array(
        F.when(F.expr(f"a.id is not null and (b.id is null or not ({core}))"), _op(2, "node:remove", "a", _json(NODE, "a"))),
        F.when(F.expr(f"b.id is not null and (a.id is null or not ({core}))"), _op(6, "node:add", "b", None, _json(NODE, "b"))),
        F.when(stay & ~F.col("a.detail_graph").eqNullSafe(F.col("b.detail_graph")), _op(7, "node:detail", "a", F.col("a.detail_graph"), F.col("b.detail_graph"))),
    ), attrs), again=F.expr(both))
    nodes = keep(nodes, "node_ops")
    again = nodes.where("t = 'node:remove' and again").select(F.col("id").alias("node"))
    # An edge that has other ends on the other side differs anyway: so the ends on one side say which edges are at a node.
    ends = a.edges.select("id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"))
    touched = keep(ends.join(again, "node", "left_semi").select("id").distinct(), "touched").withColumn("touched", F.lit(True))
    # The edges get the mark before they are paired, as both joins are by their own id: they are shuffled once.
    e = _pairs(a.edges.select(EDGE).join(touched, "id", "left"), b.edges.select(EDGE))
    changed = "a.touched is not null or not (" + " and ".join(f"a.{c} <=> b.{c}" for c in EDGE if c != "attrs") + ") or not (to_json(a.attrs) <=> to_json(b.attrs))"
    edges = _unfolded(e, F.array(
        F.when(F.expr(f"a.id is not null and (b.id is null or {changed})"), _op(1, "edge:remove", "a", _json(EDGE, "a"))),
        F.when(F.expr(f"b.id is not null and (a.id is null or {changed})"), _op(9, "edge:add", "b", None, _json(EDGE, "b"))),
    ))
    return reduce(DataFrame.unionByName, [graphs, nodes.select(OP), keep(edges, "edge_ops")])


def invert(ops: DataFrame) -> DataFrame:
    """The operations that lead back: kinds and phases mirrored, prev and next swapped."""
    mirror = {"edge:remove": ("edge:add", 9), "edge:add": ("edge:remove", 1), "node:remove": ("node:add", 6), "node:add": ("node:remove", 2), "graph:remove": ("graph:add", 4), "graph:add": ("graph:remove", 3)}
    t, phase = F.col("t"), F.col("phase")
    for was, (now, at) in mirror.items():
        t, phase = F.when(F.col("t") == was, now).otherwise(t), F.when(F.col("t") == was, at).otherwise(phase)
    return ops.select(phase.alias("phase"), t.alias("t"), "graph_id", "id", "key", F.col("next").alias("prev"), F.col("prev").alias("next"))


def apply(space: Space, ops: DataFrame) -> Space:
    """The space after a set of operations that fit it, in bulk: what goes is an anti-join, what comes a union, changes are joins."""
    of = lambda *t: ops.where(F.col("t").isin(*t))
    meta = of("graph:meta").select("id", F.from_json("next", "label string, domain string, origin string").alias("m"))
    added = of("graph:add").select("id", F.from_json("next", "label string, domain string, origin string").alias("m")).select("id", "m.*")
    graphs = space.graphs.select("id", "label", "domain", "origin").join(of("graph:remove").select("id"), "id", "left_anti").join(meta, "id", "left")
    graphs = graphs.select("id", *[F.when(F.col("m").isNull(), F.col(c)).otherwise(F.col(f"m.{c}")).alias(c) for c in ("label", "domain", "origin")]).unionByName(added)
    kinds = {"node": "graph_id string, id string, kind string, label string, detail_graph string, attrs map<string,string>, origin string", "edge": "graph_id string, id string, src string, dst string, kind string, weight double, attrs map<string,string>, origin string"}
    come = lambda what: of(f"{what}:add").select(F.from_json("next", kinds[what]).alias("m")).select("m.*")
    no, none = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    detail, attr = F.col("t") == "node:detail", F.col("t") == "node:attr"
    put = F.map_from_entries(F.collect_list(F.when(attr & F.col("next").isNotNull(), F.struct("key", "next"))))
    changes = of("node:detail", "node:attr").groupBy("id").agg(F.max(detail).alias("moved"), F.max(F.when(detail, F.col("next"))).alias("to"), put.alias("put"), F.collect_set(F.when(attr, F.col("key"))).alias("cut"))
    # Nodes that stay and those that come are changed each for themselves: after their union all would be shuffled once more.
    stay = space.nodes.select(NODE).join(of("node:remove").select("id"), "id", "left_anti").join(changes, "id", "left")
    nodes = stay.unionByName(come("node").join(changes, "id", "left"))
    cut = F.coalesce("cut", no)
    attrs = F.map_concat(F.map_filter(F.coalesce("attrs", none), lambda k, v: ~F.array_contains(cut, k)), F.coalesce("put", none))
    nodes = nodes.select("graph_id", "id", "kind", "label", F.when(F.col("moved"), F.col("to")).otherwise(F.col("detail_graph")).alias("detail_graph"), F.when(F.size(cut) == 0, F.col("attrs")).when(F.size(attrs) == 0, None).otherwise(attrs).alias("attrs"), "origin")
    edges = space.edges.select(EDGE).join(of("edge:remove").select("id"), "id", "left_anti").select(EDGE).unionByName(come("edge"))
    return space.with_(graphs=graphs, nodes=nodes, edges=edges)


def net(log: DataFrame) -> DataFrame:
    """One set of operations, fit for apply(), that leads where the deltas of a log (counter, phase, ..) lead one after the other.

    Of what comes and goes, the last counts; what was there before goes first. Changes count if they are after it, the last one
    for each key.
    """
    log = log.withColumns({"kind": F.substring_index("t", ":", 1), "at": F.struct("counter", "phase"), "life": F.col("t").rlike(":(add|remove)$"), "k": F.coalesce("key", F.lit(""))})
    ends = log.where("life").groupBy("kind", "id").agg(F.max_by(F.struct("graph_id", "t", "next"), "at").alias("end"), F.max("at").alias("since"))
    none = F.lit(None).cast("string")
    phases = lambda kinds: F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("kind"))
    gone = ends.select(phases({"edge": 1, "node": 2, "graph": 3}).alias("phase"), F.concat("kind", F.lit(":remove")).alias("t"), F.col("end.graph_id").alias("graph_id"), "id", none.alias("key"), none.alias("prev"), none.alias("next"))
    changes = log.where("not life").join(ends, ["kind", "id"], "left").where("since is null or at > since and end.t not like '%:remove'")
    columns = ["phase", "t", "graph_id", "id", "key", "prev", "next"]
    last = changes.groupBy("kind", "id", "t", "k").agg(F.max_by(F.struct(*columns), "at").alias("o"), F.min_by("prev", "at").alias("first"), F.max("since").alias("since"))
    last = last.select("kind", "since", "o.phase", "o.t", "o.graph_id", "o.id", "o.key", F.col("first").alias("prev"), "o.next")
    # A graph's label comes with the graph, if that comes too.
    named = last.where("kind = 'graph' and since is not null").select("kind", "id", F.col("next").alias("now"))
    come = ends.where("end.t like '%:add'").join(named, ["kind", "id"], "left").select(phases({"graph": 4, "node": 6, "edge": 9}).alias("phase"), F.concat("kind", F.lit(":add")).alias("t"), F.col("end.graph_id").alias("graph_id"), "id", none.alias("key"), none.alias("prev"), F.coalesce("now", "end.next").alias("next"))
    return gone.unionByName(come).unionByName(last.where("kind <> 'graph' or since is null").select(columns))


def summary(ops: DataFrame) -> DataFrame:
    """t, kind, n: operations by type, and for nodes and edges by kind."""
    kind = F.get_json_object(F.coalesce("next", "prev"), "$.kind")
    return ops.groupBy("t", F.when(F.col("t").rlike("^(node|edge):(add|remove)$"), kind).alias("kind")).agg(F.count("*").alias("n"))


def moved_details(a: Space, b: Space) -> DataFrame:
    """graph, before, after: detail graphs that another node holds now."""
    held = lambda s, name: s.nodes.where("detail_graph is not null").groupBy(F.col("detail_graph").alias("graph")).agg(F.min("id").alias(name))
    return held(a, "before").join(held(b, "after"), "graph").where("before <> after")


def gaps(log: DataFrame) -> DataFrame:
    """site, counter, missing: places in each site's log (site, counter) where numbers are missing before a delta."""
    before = F.lag("counter").over(Window.partitionBy("site").orderBy("counter"))
    counters = log.select("site", "counter").distinct()
    return counters.withColumn("missing", F.col("counter") - before - 1).where("missing > 0")


def latest(log: DataFrame) -> DataFrame:
    """id, value of the last write (counter, seq) of each id; a null value is a removal and leaves no row."""
    last = log.groupBy("id").agg(F.max_by("value", F.struct("counter", "seq")).alias("value"))
    return last.where("value is not null")


def touched(log: DataFrame) -> DataFrame:
    """counter, n_ops, graphs, nodes: what each delta touched."""
    return log.groupBy("counter").agg(F.count("*").alias("n_ops"), F.countDistinct("graph_id").alias("graphs"), F.countDistinct("id").alias("nodes"))


def prev_conflicts(space: Space, ops: DataFrame) -> DataFrame:
    """Attribute operations whose stated prev isn't what the node has: id, key, prev, actual."""
    now = space.nodes.select("id", "attrs")
    asked = ops.where("t = 'node:attr'").join(now, "id", "left").withColumn("actual", F.try_element_at("attrs", F.col("key")))
    return asked.where("not (prev <=> actual)").select("id", "key", "prev", "actual")
