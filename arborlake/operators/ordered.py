"""Changes applied in order, all or nothing: the first operation of a delta that doesn't fit, and why.

Operations are rows (delta, i, t, graph_id, id, key, prev, next); i orders those of one delta. An operation that follows a wrong one
is never looked at, so each may be judged as if all before it were right: by what the delta's own operations before it, or else the
space, say of each id that it names. What an id was at a place in the delta is a join with the spans of its states; nothing runs
one operation after the other, and all deltas are judged at once, each against the same space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Space
from ..plans.scratch import Levels, written
from . import delta as changes
from .forest import containment_index
from .validate import KIND, ORIGINS, VALUE

OPERATIONS = "delta long, i long, t string, graph_id string, id string, key string, prev string, next string"
TYPES = ["graph:add", "graph:remove", "graph:meta", "node:add", "node:remove", "node:attr", "node:detail", "edge:add", "edge:remove"]
PAYLOAD = "id string, label string, domain string, origin string, kind string, detail_graph string, attrs map<string,string>, src string, dst string, weight double"
#: Counters of one range.
RANGE = 1 << 16


def _spans(events: DataFrame) -> DataFrame:
    """delta, ref, since, until, state of events (delta, ref, i, state): an operation after since, up to until, finds that state."""
    return events.select("delta", "ref", F.col("i").alias("since"), F.lead("i").over(Window.partitionBy("delta", "ref").orderBy("i")).alias("until"), "state")


def _as_of(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked (delta, i, ref, ..) with since and state of the span around i; both null where the delta said nothing before."""
    within = (asked["delta"] == spans["delta"]) & (asked["ref"] == spans["ref"]) & (spans["since"] < asked["i"]) & (spans["until"].isNull() | (spans["until"] >= asked["i"]))
    return asked.join(spans, within, "left").select(*[asked[c] for c in asked.columns], spans["since"], spans["state"])


def _base(space: Space) -> DataFrame:
    """ref and state of all that a space has; a state is what it is, the graph that it is in, and its payload."""
    kinds = dict(x.split(" ", 1) for x in PAYLOAD.split(", "))

    def rows(df: DataFrame, what: str, graph: str) -> DataFrame:
        payload = F.struct(*[(F.col(c) if c in df.columns else F.lit(None).cast(k)).alias(c) for c, k in kinds.items()])
        return df.select(F.col("id").alias("ref"), F.struct(F.lit(what).alias("what"), F.col(graph).alias("graph"), payload.alias("x")).alias("state"))

    return rows(space.graphs, "graph", "id").unionByName(rows(space.nodes, "node", "graph_id")).unionByName(rows(space.edges, "edge", "graph_id"))


def _payload_code(c: str) -> Column:
    """What is wrong with the node or edge that comes, in the order in which it is looked at."""
    x, is_edge = F.col(c), F.col("t") == "edge:add"
    bad_id = lambda v: v.isNull() | (v == "") | (F.instr(v, "\x1f") > 0)
    keys = F.coalesce(F.map_keys(x["attrs"]), F.array().cast("array<string>"))
    values = F.coalesce(F.map_values(x["attrs"]), F.array().cast("array<string>"))
    return (
        F.when(bad_id(x["id"]), "invalid-id")
        .when(is_edge & (F.isnan(x["weight"]) | (F.abs(x["weight"]) == float("inf"))), "invalid-weight")
        .when(is_edge & (bad_id(x["src"]) | bad_id(x["dst"])), "invalid-id")
        .when(x["kind"].isNull() | ~x["kind"].rlike(KIND), "invalid-kind")
        .when(~is_edge & x["detail_graph"].isNotNull() & bad_id(x["detail_graph"]), "invalid-id")
        .when(F.exists(keys, lambda k: ~k.rlike(KIND)), "invalid-attr-key")
        .when(F.exists(keys, lambda k: k.startswith("core:")), "reserved-core-key")
        .when(F.exists(values, lambda v: v.isNull() | ~v.rlike(VALUE)), "invalid-attr-value")
        .when(x["origin"].isNull() | ~x["origin"].isin(ORIGINS), "invalid-provenance")
    )


def _sorted(attrs: Column) -> Column:
    return F.coalesce(F.array_sort(F.map_entries(attrs)), F.array().cast("array<struct<key:string,value:string>>"))


def _count_before(asked: DataFrame, events: DataFrame, base: DataFrame, name: str) -> DataFrame:
    """delta, i, name: for each asked (delta, i, ref) what the space counts at ref (base: ref, n), and the events (delta, ref, i, n) before i."""
    inside = asked.join(events.select("delta", "ref", F.col("i").alias("at"), "n"), ["delta", "ref"]).where("at < i").select("delta", "i", "n")
    there = asked.join(base, "ref").select("delta", "i", "n")
    return inside.unionByName(there).groupBy("delta", "i").agg(F.sum("n").alias(name))


def _cycles(claims: DataFrame, spans: DataFrame, held: DataFrame) -> DataFrame:
    """delta, i of claims (delta, i, host, target) whose target is the host's graph or one above it, at that place in the delta.

    Hosts are followed upwards together, one graph at a time; as many rounds as the deepest of them is deep.
    """
    found = Levels(claims.sparkSession, "claims")
    walk = found.add(claims.select("delta", "i", "target", F.col("host").alias("ref"), F.array("host").alias("path")))
    while not walk.isEmpty():
        up = _as_of(walk.where("ref <> target"), spans).join(held, "ref", "left")
        parent = F.when(F.col("since").isNotNull(), F.col("state.graph")).otherwise(F.col("holder.graph"))
        up = up.select("delta", "i", "target", parent.alias("ref"), "path").where(F.col("ref").isNotNull() & ~F.array_contains("path", F.col("ref")))
        walk = found.add(up.withColumn("path", F.concat("path", F.array("ref"))))
    return found.all().where("ref = target").select("delta", "i").distinct()


def judged(space: Space, ops: DataFrame) -> DataFrame:
    """The operations, each with code: what is wrong with it if all before it in its delta are right, or null."""
    add, keys = F.col("t").endswith(":add"), ["delta", "i"]
    # Texts that don't parse give no payload.
    whole = F.from_json("next", PAYLOAD + ", _corrupt_record string")
    x = F.when((add | (F.col("t") == "graph:meta")) & whole["_corrupt_record"].isNull(), whole.dropFields("_corrupt_record"))
    o = ops.select("delta", "i", "t", "graph_id", F.when(F.col("t").startswith("graph:"), F.col("graph_id")).otherwise(F.col("id")).alias("id"), "key", "prev", "next", x.alias("x"))
    o = written(o.withColumn("x", F.when(F.col("x").isNotNull(), F.col("x").withField("id", F.coalesce("x.id", "id")))), "ordered-ops")
    target = F.when(F.col("t") == "node:add", F.col("x.detail_graph")).when(F.col("t") == "node:detail", F.col("next"))

    # What each named id is at that place.
    what = F.substring_index("t", ":", 1)
    gone = F.lit(None).cast(f"struct<what:string,graph:string,x:struct<{', '.join(c.replace(' ', ':', 1) for c in PAYLOAD.split(', '))}>>")
    came = F.struct(what.alias("what"), F.col("graph_id").alias("graph"), F.col("x").alias("x"))
    lives = _spans(o.where(add | F.col("t").endswith(":remove")).select(*keys, F.col("id").alias("ref"), F.when(add, came).otherwise(gone).alias("state")))
    roles = {"own": F.col("id"), "graph": F.col("graph_id"), "src": F.col("x.src"), "dst": F.col("x.dst"), "target": target}
    asked = o.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("role"), c.alias("ref")) for r, c in roles.items()])).alias("a")).select(*keys, "a.role", "a.ref").where("ref is not null")
    base = _base(space).join(asked.select("ref").distinct(), "ref", "left_semi").withColumnRenamed("state", "was")
    known = _as_of(asked, lives).join(base, "ref", "left")
    state = F.when(F.col("since").isNotNull(), F.col("state")).otherwise(F.col("was"))
    of = lambda role: F.any_value(F.when(F.col("role") == role, state), ignoreNulls=True).alias(role)
    since = F.max(F.when(F.col("role") == "own", F.coalesce("since", F.lit(-1)))).alias("own_since")
    o = written(o.join(known.groupBy(*keys).agg(*[of(r) for r in roles], since), keys, "left").withColumn("target_id", target), "ordered-named")
    node = (F.col("own.what") == "node") & (F.col("own.graph") == F.col("graph_id"))

    # A node's detail, a graph's label and a node's attribute: the last change since it came, else as it came.
    def value(t: str, c: Column, ref: Column, where: str, first: Column, name: str) -> DataFrame:
        events = _spans(o.where(F.col("t") == t).select(*keys, ref.alias("ref"), F.struct(c.alias("v")).alias("state")))
        now = _as_of(o.where(where).select(*keys, ref.alias("ref"), "own", "own_since", "key"), events)
        return now.select(*keys, F.when(F.col("since") > F.col("own_since"), F.col("state.v")).otherwise(first).alias(name))

    details = value("node:detail", F.col("next"), F.col("id"), "t in ('node:remove', 'node:detail')", F.col("own.x.detail_graph"), "detail")
    meta = lambda at: F.struct(F.col(f"{at}.label").alias("label"), F.col(f"{at}.domain").alias("domain"), F.col(f"{at}.origin").alias("origin"))
    metas = value("graph:meta", meta("x"), F.col("id"), "t in ('graph:remove', 'graph:meta') and prev is not null", meta("own.x"), "meta")
    both = F.concat_ws("\x1f", "id", "key")
    attrs = value("node:attr", F.col("next"), both, "t = 'node:attr' and prev is not null", F.try_element_at("own.x.attrs", F.col("key")), "attr")
    # All attributes of a node that goes, where they are stated.
    sets = _spans(o.where("t = 'node:attr'").select(*keys, both.alias("ref"), F.struct("id", "key", "next").alias("state")))
    leaving = o.where("t = 'node:remove' and prev is not null").select("delta", "i", "id", "own_since")
    put = leaving.join(sets.select("delta", "since", "until", "state.*"), ["delta", "id"]).where("since < i and (until is null or until >= i) and since > own_since")
    puts = put.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "next"))).alias("put"))
    o = written(reduce(lambda a, b: a.join(b, keys, "left"), [details, metas, attrs, puts], o), "ordered-valued")

    # Who holds a graph.
    claimed = F.col("target_id").isNotNull() & ((F.col("t") == "node:add") | ~F.col("target_id").eqNullSafe(F.col("detail")))
    released = F.col("detail").isNotNull() & ((F.col("t") == "node:remove") | ~F.col("detail").eqNullSafe(F.col("next")))
    holder = F.struct(F.col("graph_id").alias("graph"), F.col("id").alias("node"))
    claims, nobody = o.where(claimed), F.lit(None).cast("struct<graph:string,node:string>")
    holds = claims.select(*keys, F.col("target_id").alias("ref"), holder.alias("state")).unionByName(o.where(released).select(*keys, F.col("detail").alias("ref"), nobody.alias("state")))
    spans = written(_spans(holds), "ordered-holds")
    held = containment_index(space).select(F.col("graph").alias("ref"), F.struct(F.col("in_graph").alias("graph"), F.col("node").alias("node")).alias("holder"))
    about = claims.select(*keys, F.col("target_id").alias("ref")).unionByName(o.where("t = 'graph:remove'").select(*keys, F.col("id").alias("ref")))
    now = _as_of(about, spans).join(held, "ref", "left").select(*keys, F.when(F.col("since").isNotNull(), F.col("state")).otherwise(F.col("holder")).alias("holder"))
    around = _cycles(claims.select(*keys, F.col("graph_id").alias("host"), F.col("target_id").alias("target")), spans, held).withColumn("cycle", F.lit(True))

    # How many edges a node has, and how much there is in a graph.
    edge = F.when(F.col("t") == "edge:add", F.col("x")).otherwise(F.col("own.x"))
    one = F.when(add, 1).otherwise(-1)
    ends = o.where("t in ('edge:add', 'edge:remove')").select(*keys, F.explode(F.array(edge["src"], edge["dst"])).alias("ref"), one.alias("n"))
    contents = o.where("t in ('node:add', 'node:remove', 'edge:add', 'edge:remove')").select(*keys, F.col("graph_id").alias("ref"), one.alias("n"))
    nodes_gone, graphs_gone = (o.where(F.col("t") == t).select(*keys, F.col("id").alias("ref")) for t in ("node:remove", "graph:remove"))

    def counted(df: DataFrame, asked: DataFrame) -> DataFrame:
        return df.join(asked.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.count("*").alias("n"))

    degrees = _count_before(nodes_gone, ends, counted(space.edges.select(F.explode(F.array("src", "dst")).alias("ref")), nodes_gone), "degree")
    inside = space.nodes.select(F.col("graph_id").alias("ref")).unionByName(space.edges.select(F.col("graph_id").alias("ref")))
    fills = _count_before(graphs_gone, contents, counted(inside, graphs_gone), "fill")
    o = reduce(lambda a, b: a.join(b, keys, "left"), [now, around, degrees, fills], o)

    # The codes, in the order in which they are looked at.
    stated = F.from_json("prev", PAYLOAD)
    differs = lambda a, b, *cols: reduce(lambda p, q: p | q, [~a[c].eqNullSafe(b[c]) for c in cols])
    asserted, none = F.col("prev").isNotNull(), F.create_map().cast("map<string,string>")
    there = F.map_concat(F.map_filter(F.coalesce("own.x.attrs", none), lambda k, v: ~F.map_contains_key(F.coalesce("put", none), k)), F.map_filter(F.coalesce("put", none), lambda k, v: v.isNotNull()))
    node_changed = differs(stated, F.col("own.x"), "kind", "label", "origin") | ~stated["detail_graph"].eqNullSafe(F.col("detail")) | (_sorted(stated["attrs"]) != _sorted(there))
    edge_changed = differs(stated, F.col("own.x"), "kind", "origin", "src", "dst", "weight") | (_sorted(stated["attrs"]) != _sorted(F.col("own.x.attrs")))
    meta_changed = differs(stated, F.col("meta"), "label", "domain", "origin")
    no_graph = F.coalesce(F.col("graph.what") != "graph", F.lit(True))
    no_node = ~F.coalesce(node, F.lit(False))
    bad_meta = F.when(F.coalesce(F.col("x.domain"), F.lit("")) == "", "invalid-domain").when(~F.coalesce(F.col("x.origin").isin(ORIGINS), F.lit(False)), "invalid-provenance")
    bad_id = (F.col("id") == "") | (F.instr("id", "\x1f") > 0) | F.col("id").isNull()
    known_target = F.coalesce(F.col("target.what") == "graph", F.lit(False))
    claim = F.when(claimed & ~known_target, "unknown-detail-graph").when(claimed & F.col("holder").isNotNull(), "detail-not-root").when(claimed & F.col("cycle"), "containment-cycle")
    used = F.when(F.col("own").isNotNull(), "duplicate-id")

    def end(c: str) -> Column:
        is_node = F.col(f"{c}.what") == "node"
        return F.when(is_node & (F.col(f"{c}.graph") != F.col("graph_id")), "cross-graph-edge").when(~F.coalesce(is_node, F.lit(False)), "unknown-node")

    graph_, node_ = F.when(no_graph, "unknown-graph"), F.when(no_node, "unknown-node")
    conflict = lambda c: F.when(asserted & c, "op-conflict")
    rules = {
        "graph:add": [F.when(F.col("x").isNull(), "invalid-op"), F.when(bad_id, "invalid-id"), bad_meta, used],
        "graph:remove": [graph_, F.when(F.col("fill") > 0, "graph-not-empty"), F.when(F.col("holder").isNotNull(), "graph-contained"), conflict(meta_changed)],
        "graph:meta": [F.when(F.col("x").isNull(), "invalid-op"), graph_, conflict(meta_changed), bad_meta],
        "node:add": [F.when(F.col("x").isNull(), "invalid-op"), graph_, _payload_code("x"), used, claim],
        "node:remove": [graph_, node_, F.when(F.col("degree") > 0, "node-has-edges"), conflict(node_changed)],
        "node:attr": [graph_, node_, F.when(~F.coalesce(F.col("key").rlike(KIND), F.lit(False)), "invalid-attr-key"), F.when(F.col("key").startswith("core:"), "reserved-core-key"), conflict(~F.col("prev").eqNullSafe(F.col("attr"))), F.when(~F.col("next").rlike(VALUE), "invalid-attr-value")],
        "node:detail": [graph_, node_, conflict(~F.col("prev").eqNullSafe(F.col("detail"))), F.when((F.col("next") == "") | (F.instr("next", "\x1f") > 0), "invalid-id"), claim],
        "edge:add": [F.when(F.col("x").isNull(), "invalid-op"), graph_, _payload_code("x"), used, end("src"), end("dst")],
        "edge:remove": [graph_, F.when(~F.coalesce((F.col("own.what") == "edge") & (F.col("own.graph") == F.col("graph_id")), F.lit(False)), "unknown-edge"), conflict(edge_changed)],
    }
    code = F.coalesce(*[F.when(F.col("t") == t, F.coalesce(*found)) for t, found in rules.items()], F.when(~F.coalesce(F.col("t").isin(TYPES), F.lit(False)), "invalid-op"))
    return o.select("delta", "i", "t", "graph_id", "id", "key", "prev", "next", code.alias("code"))


def rejections(space: Space, ops: DataFrame, deltas: DataFrame | None = None, version: tuple[int, str] | None = None) -> DataFrame:
    """delta, i, code, graph_id, id: the first operation of each delta that doesn't fit, for those that are refused.

    ops: OPERATIONS (an i may not repeat in a delta); prev is an assertion, or null. deltas (delta, base_counter, base_site, actor)
    are looked at before their operations: without actor (invalid-delta), made for another version than the space's (stale-delta;
    no counter fits any), or without operations (empty-delta); i and ids are null there. An empty table gives no rows.
    """
    first = judged(space, ops).where("code is not null").groupBy("delta").agg(F.min_by(F.struct("i", "code", "graph_id", "id"), "i").alias("r")).select("delta", "r.*")
    if deltas is None:
        return first
    counts = ops.groupBy("delta").agg(F.count("*").alias("n"))
    stale = F.lit(False) if version is None else F.col("base_counter").isNotNull() & ~((F.col("base_counter") == version[0]) & F.col("base_site").eqNullSafe(F.lit(version[1])))
    code = F.when(F.coalesce("actor", F.lit("")) == "", "invalid-delta").when(stale, "stale-delta").when(F.col("n").isNull(), "empty-delta")
    envelopes = deltas.join(counts, "delta", "left").select("delta", code.alias("envelope")).where("envelope is not null")
    none = F.lit(None).cast("string")
    refused = envelopes.select("delta", F.lit(None).cast("long").alias("i"), F.col("envelope").alias("code"), none.alias("graph_id"), none.alias("id"))
    return refused.unionByName(first.join(envelopes, "delta", "left_anti"))


def apply(space: Space, ops: DataFrame, check: bool = True) -> tuple[Space, DataFrame]:
    """The space after one delta, and its rejection (no row if it fits): either all operations are applied or none.

    Of each id, the last of what the delta says counts, so this is one fold and one bulk application, whatever the order was.
    """
    ops = written(ops, "ordered-delta")
    refused = written(rejections(space, ops), "ordered-refused") if check else None
    if refused is not None and not refused.isEmpty():
        return space, refused
    phases = {"edge:remove": 1, "node:remove": 2, "graph:remove": 3, "graph:add": 4, "graph:meta": 5, "node:add": 6, "node:detail": 7, "node:attr": 8, "edge:add": 9}
    phase = F.coalesce(*[F.when(F.col("t") == t, p) for t, p in phases.items()])
    # Payloads needn't repeat where they go.
    x = F.from_json("next", PAYLOAD)
    whole = {f"{what}:add": F.to_json(F.struct("graph_id", *["id" if c == "id" else x[c].alias(c) for c in columns[1:]])) for what, columns in (("node", changes.NODE), ("edge", changes.EDGE))}
    ops = ops.withColumn("next", F.coalesce(*[F.when(F.col("t") == t, text) for t, text in whole.items()], F.col("next")))
    log = ops.select(F.col("i").alias("counter"), phase.alias("phase"), "t", "graph_id", F.when(F.col("t").startswith("graph:"), F.col("graph_id")).otherwise(F.col("id")).alias("id"), "key", "prev", "next")
    return changes.apply(space, changes.net(log)), refused


def composed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One delta from consecutive ones (site, counter, i, ..): its operations, numbered anew, and the gaps.

    Each delta's counter must follow the one before it, at one site; gaps has site and counter of those that don't
    (non-consecutive-deltas), and then there are no operations. Deltas are numbered within ranges of counters, so no task gets all.
    """
    counts = written(log.groupBy("site", "counter").agg(F.count("*").alias("n")).withColumn("range", F.floor(F.col("counter") / RANGE)), "composed")
    first = counts.agg(F.min(F.struct("counter", "site")).alias("first"))
    before = counts.select("site", (F.col("counter") + 1).alias("counter"))
    gaps = counts.join(before, ["site", "counter"], "left_anti").join(F.broadcast(first)).where("counter <> first.counter or site <> first.site")
    gaps = gaps.select("site", "counter", F.lit("non-consecutive-deltas").alias("code"))
    if not gaps.isEmpty():
        return log.limit(0).withColumn("delta", F.lit(0).cast("long")), gaps
    # One row for every RANGE counters.
    starts = counts.groupBy("range").agg(F.sum("n").alias("n")).select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    inner = F.sum("n").over(Window.partitionBy("range").orderBy("counter")) - F.col("n")
    placed = counts.withColumn("inner", inner).join(starts, "range").select("site", "counter", (F.col("start") + F.col("inner")).alias("from"))
    within = F.row_number().over(Window.partitionBy("site", "counter").orderBy("i"))
    numbered = log.withColumn("within", within.cast("long")).join(placed, ["site", "counter"])
    return numbered.withColumns({"delta": F.lit(0).cast("long"), "i": F.col("from") + F.col("within") - 1}).drop("from", "within", "site", "counter"), gaps
