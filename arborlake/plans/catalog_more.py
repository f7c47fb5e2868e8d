"""Query, change, validation, view, shape and adapter queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import derived_id
from ..model import Space
from ..operators import cut, delta, induced, query, shape, validate, views
from ..operators.forest import forest
from ..sources import adapters
from . import sql, tables
from .scratch import written

QUERIES: dict = {}
ORACLES: dict = {}


def registered(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _space(spark, d, links: bool = True) -> Space:
    return tables.space(spark, d, links)


# --- node queries -----------------------------------------------------------------------------------------------------------

_ALL = sql.SPACE + ", every AS (SELECT 'graphs' AS what, '' AS kind FROM g UNION ALL SELECT 'nodes', kind FROM n UNION ALL SELECT 'edges', kind FROM e) "


@registered("space_stats", _ALL + "SELECT what, kind, count(*)::BIGINT AS n FROM every GROUP BY 1, 2 UNION ALL SELECT 'roots', '', 1::BIGINT")
def _(spark, d):
    return query.stats(_space(spark, d))


@registered("provenance_tally", sql.SPACE + "SELECT 'source' AS origin, ((SELECT count(*) FROM g) + (SELECT count(*) FROM n))::BIGINT AS n UNION ALL SELECT 'derived', count(*)::BIGINT FROM e")
def _(spark, d):
    return query.provenance_tally(_space(spark, d))


@registered("graph_manifest", sql.SPACE + "SELECT g.id AS graph_id, coalesce(a.k, 0)::BIGINT AS nodes, coalesce(b.k, 0)::BIGINT AS edges FROM g LEFT JOIN (SELECT graph_id, count(*) AS k FROM n GROUP BY 1) a ON a.graph_id = g.id LEFT JOIN (SELECT graph_id, count(*) AS k FROM e GROUP BY 1) b ON b.graph_id = g.id")
def _(spark, d):
    return query.manifest(_space(spark, d))


@registered("query_kind_text", "SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'")
def _(spark, d):
    return query.NodeQuery(_space(spark, d, False)).by_kind("core:order").text("Urgent 1").ids()


@registered("query_neighbors", sql.SPACE + "SELECT DISTINCT n.id, n.label FROM n JOIN (SELECT dst AS id FROM e WHERE src = 'n3' UNION ALL SELECT src FROM e WHERE dst = 'n3') x USING (id)")
def _(spark, d):
    return query.NodeQuery(_space(spark, d)).neighbors_of("n3").nodes().select("id", "label")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"


@registered("label_search", f"SELECT 'p' || p_partkey AS id, p_name AS label, 2::BIGINT AS score FROM part WHERE list_has_all({_TOKENS.format('p_name')}, (SELECT {_TOKENS.format('p_name')}[1:2] FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)))")
def _(spark, d):
    part = tables.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"))
    first = tables.table(spark, d, "part").agg(F.min_by("p_name", "p_partkey")).first()[0]
    import re

    words = list(dict.fromkeys(w for w in re.split("[^a-z0-9]+", first.lower()) if w))[:2]
    return query.search_labels(part, " ".join(words))


@registered("posting_index", f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({_TOKENS.format('p_name')}) AS token FROM part) GROUP BY 1")
def _(spark, d):
    part = tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"))
    return query.posting_index(part).groupBy("token").agg(F.count("*").alias("n"))


@registered("inspect_node", sql.SPACE + "SELECT direction, edge, x.kind, other, n.label AS other_label FROM (SELECT 'out' AS direction, id AS edge, kind, dst AS other FROM e WHERE src = 'n3' UNION ALL SELECT 'in', id, kind, src FROM e WHERE dst = 'n3') x LEFT JOIN n ON n.id = x.other")
def _(spark, d):
    return query.inspect(_space(spark, d), "n3")


@registered("without_nodes", sql.SPACE + "SELECT 'nodes' AS what, count(*)::BIGINT AS n FROM n WHERE id NOT IN ('n3', 'n4') UNION ALL SELECT 'edges', count(*)::BIGINT FROM e WHERE src NOT IN ('n3', 'n4') AND dst NOT IN ('n3', 'n4')")
def _(spark, d):
    left = query.without_nodes(_space(spark, d), spark.createDataFrame([("n3",), ("n4",)], "id string"))
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count("nodes", left.nodes).unionByName(count("edges", left.edges))


@registered("derive_ids", f"""WITH h AS (SELECT n_nationkey, sha256('core' || chr(31) || n_name || chr(31) || n_nationkey)[1:32] || '0' AS x FROM nation),
b AS (SELECT n_nationkey, k, ('0x' || x[(5 * k // 4) + 1 : (5 * k // 4) + 2])::INT AS two FROM h, range(26) t(k))
SELECT n_nationkey::BIGINT AS key, 'n' || string_agg('abcdefghijklmnopqrstuvwxyz234567'[((two >> (3 - (5 * k) % 4)::INT) & 31) + 1], '' ORDER BY k) AS id FROM b GROUP BY 1""")
def _(spark, d):
    nation = tables.table(spark, d, "nation")
    return nation.select(F.col("n_nationkey").cast("long").alias("key"), derived_id("n", F.lit("core"), F.col("n_name"), F.col("n_nationkey").cast("string")).alias("id"))


# --- changes ----------------------------------------------------------------------------------------------------------------


def _edited(spark, d) -> tuple[Space, Space]:
    """The space, and one in which orders divisible by 7 are gone, by 5 are relabelled and by 11 have another status."""
    before = _space(spark, d, False)
    key = F.substring("id", 2, 20).cast("long")
    order = F.col("kind") == "core:order"
    nodes = before.nodes.where(~(order & (key % 7 == 0)))
    nodes = nodes.withColumn("label", F.when(order & (key % 5 == 0), "new").otherwise(F.col("label")))
    nodes = nodes.withColumn("attrs", F.when(order & (key % 11 == 0), F.create_map(F.lit("tpch:status"), F.lit('{"v":"X"}'))).otherwise(F.col("attrs")))
    return before, before.with_(nodes=nodes)


_EDITED = """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 AS gone, o_orderkey % 5 = 0 AS renamed, o_orderkey % 11 = 0 AND o_orderstatus <> 'X' AS changed, 'o' || o_orderkey AS id FROM orders),
p AS (SELECT 'p' || o_orderkey AS id, o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0 OR nxt % 5 = 0 AND nxt % 7 <> 0 AS again FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL),
ops AS (SELECT 2 AS phase, 'node:remove' AS t, id FROM o WHERE gone OR renamed UNION ALL SELECT 6, 'node:add', id FROM o WHERE renamed AND NOT gone UNION ALL SELECT 8, 'node:attr', id FROM o WHERE changed AND NOT gone AND NOT renamed
UNION ALL SELECT 1, 'edge:remove', id FROM p WHERE again UNION ALL SELECT 9, 'edge:add', id FROM p WHERE again) """


@registered("diff_ops", _EDITED + "SELECT phase::BIGINT AS phase, t, id FROM ops")
def _(spark, d):
    return delta.diff(*_edited(spark, d)).select(F.col("phase").cast("long").alias("phase"), "t", "id")


@registered("diff_summary", _EDITED + "SELECT t, CASE WHEN t LIKE 'node:%e' OR t = 'node:add' THEN 'core:order' WHEN t LIKE 'edge:%' THEN 'core:precedes' END AS kind, count(*)::BIGINT AS n FROM ops GROUP BY 1, 2")
def _(spark, d):
    return delta.summary(delta.diff(*_edited(spark, d)))


@registered("diff_moved", "SELECT 'gc' || c_custkey AS graph, 'c' || c_custkey AS before, 'c' || (c_custkey + 1) AS after FROM customer WHERE c_custkey % 10 = 0 AND c_custkey + 1 IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'gc' || c_custkey, 'c' || c_custkey, 'c' || (c_custkey - 1) FROM customer WHERE c_custkey % 10 = 1 AND c_custkey - 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def _(spark, d):
    space = _space(spark, d, False)
    key = F.substring("id", 2, 20).cast("long")
    keys = space.nodes.where("kind = 'core:customer'").select(key.alias("k"))
    to = F.when(key % 10 == 0, key + 1).when(key % 10 == 1, key - 1).otherwise(key)
    swapped = space.nodes.where("kind = 'core:customer'").withColumn("to", to).join(keys.select(F.col("k").alias("to"), F.lit(True).alias("there")), "to", "left")
    swapped = swapped.withColumn("detail_graph", F.concat(F.lit("gc"), F.when(F.col("there"), F.col("to")).otherwise(key).cast("string"))).select(space.nodes.columns)
    return delta.moved_details(space, space.with_(nodes=space.nodes.where("kind <> 'core:customer'").unionByName(swapped)))


@registered("invert_ops", _EDITED + "SELECT CASE t WHEN 'node:remove' THEN 'node:add' WHEN 'node:add' THEN 'node:remove' WHEN 'edge:remove' THEN 'edge:add' WHEN 'edge:add' THEN 'edge:remove' ELSE t END AS t, id FROM ops")
def _(spark, d):
    return delta.invert(delta.diff(*_edited(spark, d))).select("t", "id")


@registered("apply_replay_equal", "SELECT 'there' AS way, 0::BIGINT AS left_over UNION ALL SELECT 'back', 0::BIGINT")
def _(spark, d):
    a, b = _edited(spark, d)
    steady = lambda s: s.with_(**{name: written(getattr(s, name), name) for name in ("graphs", "nodes", "edges")})
    rest = lambda way, x, y: delta.diff(x, y, written).agg(F.count("*").alias("left_over")).select(F.lit(way).alias("way"), "left_over")
    ops = delta.diff(a, b, written)
    there = steady(delta.apply(a, ops))
    return rest("there", there, b).unionByName(rest("back", steady(delta.apply(there, delta.invert(ops))), a))


@registered("oplog_replay", "SELECT user_id::BIGINT AS id, arg_max(value, struct_pack(a := ts, b := event_id)) AS value FROM events GROUP BY 1 HAVING arg_max(event_type, struct_pack(a := ts, b := event_id)) <> 'error'")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return delta.latest(ev.select(F.col("user_id").alias("id"), F.col("ts").alias("counter"), F.col("event_id").alias("seq"), value.alias("value")))


@registered("version_gap", "WITH c AS (SELECT DISTINCT event_type AS site, (event_id // 10)::BIGINT AS counter FROM events), l AS (SELECT *, lag(counter) OVER (PARTITION BY site ORDER BY counter) AS b FROM c) SELECT site, counter, counter - b - 1 AS missing FROM l WHERE counter - b > 1")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    return delta.gaps(ev.select(F.col("event_type").alias("site"), F.floor(F.col("event_id") / 10).alias("counter")))


@registered("delta_touched", "SELECT (event_id // 100)::BIGINT AS counter, count(*)::BIGINT AS n_ops, count(DISTINCT event_type)::BIGINT AS graphs, count(DISTINCT user_id)::BIGINT AS nodes FROM events GROUP BY 1")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    return delta.touched(ev.select(F.floor(F.col("event_id") / 100).alias("counter"), F.col("event_type").alias("graph_id"), F.col("user_id").alias("id")))


# --- validation -------------------------------------------------------------------------------------------------------------


def _broken(spark, d) -> Space:
    """The space with one fault of each kind for each nation."""
    s = _space(spark, d, False)
    nation = tables.table(spark, d, "nation")
    k = F.col("n_nationkey").cast("string")
    node = lambda graph, id_, kind, detail: nation.select(graph.alias("graph_id"), id_.alias("id"), F.lit(kind).alias("kind"), F.lit("x").alias("label"), detail.cast("string").alias("detail_graph"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit("source").alias("origin"))
    no = F.lit(None)
    nodes = s.nodes.unionByName(node(F.lit("root"), F.concat(F.lit("c"), (F.col("n_nationkey") + 1).cast("string")), "core:again", no))
    nodes = nodes.unionByName(node(F.lit("root"), F.concat(F.lit("dd"), k), "core:lost", F.concat(F.lit("nowhere"), k)))
    nodes = nodes.unionByName(node(F.lit("root"), F.concat(F.lit("zz"), k), "Bad Kind", F.concat(F.lit("gn"), k)))
    for a, b in (("a", "b"), ("b", "a")):  # two graphs that hold each other, and one that hangs on them
        nodes = nodes.unionByName(node(F.concat(F.lit(f"cy{a}"), k), F.concat(F.lit(f"cn{a}"), k), "core:cycle", F.concat(F.lit(f"cy{b}"), k)))
    nodes = nodes.unionByName(node(F.concat(F.lit("cya"), k), F.concat(F.lit("cnc"), k), "core:hangs", F.concat(F.lit("cyc"), k)))
    graphs = s.graphs
    for a in "abc":
        graphs = graphs.unionByName(nation.select(F.concat(F.lit(f"cy{a}"), k).alias("id"), F.lit("x").alias("label"), F.lit("core").alias("domain"), F.lit("source").alias("origin")))
    lost = nation.select(F.lit("root").alias("graph_id"), F.concat(F.lit("le"), k).alias("id"), F.concat(F.lit("n"), k).alias("src"), F.lit("r0").alias("dst"), F.lit("core:lost").alias("kind"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit("source").alias("origin"))
    return Space(graphs, nodes, s.edges.unionByName(lost), nation.select(F.concat(F.lit("gn"), k).alias("id")))


@registered("validate_duplicate_id", "SELECT 'duplicate-id' AS code, NULL::VARCHAR AS graph_id, 'c' || (n_nationkey + 1) AS element_id FROM nation WHERE n_nationkey + 1 IN (SELECT c_custkey FROM customer)")
def _(spark, d):
    return validate.duplicate_ids(_broken(spark, d))


@registered("validate_dangling", "SELECT 'dangling-detail-ref' AS code, 'root' AS graph_id, 'dd' || n_nationkey AS element_id FROM nation UNION ALL SELECT 'dangling-edge-endpoint', 'root', 'le' || n_nationkey FROM nation")
def _(spark, d):
    s = _broken(spark, d)
    return validate.dangling_details(s).unionByName(validate.dangling_endpoints(s))


@registered("validate_multi_containment", "SELECT 'multiple-containment' AS code, 'root' AS graph_id, 'zz' || n_nationkey AS element_id FROM nation")
def _(spark, d):
    return validate.multiple_containment(_broken(spark, d))


@registered("validate_cycle", "SELECT 'containment-cycle' AS code, 'cya' || n_nationkey AS graph_id, NULL::VARCHAR AS element_id FROM nation")
def _(spark, d):
    return validate.containment_cycles(_broken(spark, d))


@registered("validate_roots", "SELECT 'root-mismatch' AS code, 'gn' || n_nationkey AS graph_id, NULL::VARCHAR AS element_id FROM nation UNION ALL SELECT 'root-mismatch', 'root', NULL")
def _(spark, d):
    return validate.root_mismatches(_broken(spark, d))


@registered("validate_kind", "SELECT 'invalid-kind' AS code, 'root' AS graph_id, 'zz' || n_nationkey AS element_id FROM nation UNION ALL SELECT 'unregistered-kind', 'gc' || o_custkey, 'o' || o_orderkey FROM orders")
def _(spark, d):
    s = _broken(spark, d)
    known = spark.createDataFrame([(f"core:{k}",) for k in ("region", "nation", "customer", "again", "lost", "cycle", "hangs", "precedes")], "kind string")
    return validate.bad_kinds(s).unionByName(validate.unregistered_kinds(s, known))


# --- views ------------------------------------------------------------------------------------------------------------------


def _timed(spark, d) -> DataFrame:
    ev = tables.table(spark, d, "events")
    start = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    return ev.select(F.col("event_id").alias("id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("lane_name"), start.alias("start"), (start + F.col("event_id") % 1000).alias("end"))


_TIMED = "WITH x AS (SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN event_type ELSE '(none)' END AS lane_name, (epoch_us(ts) // 1000)::DOUBLE AS start, (epoch_us(ts) // 1000)::DOUBLE + event_id % 1000 AS \"end\" FROM events) "


@registered("timeline_events", _TIMED + "SELECT id, dense_rank() OVER (ORDER BY lane_name = '(none)', lane_name) - 1 AS lane, lane_name, start, \"end\" FROM x")
def _(spark, d):
    return views.timeline(_timed(spark, d))


@registered("timeline_extent", _TIMED + "SELECT min(start) - (max(\"end\") - min(start)) * 0.02::DOUBLE AS start, max(\"end\") + (max(\"end\") - min(start)) * 0.02::DOUBLE AS \"end\" FROM x")
def _(spark, d):
    return views.extent(_timed(spark, d))


@registered("timeline_overlap", _TIMED + ", m AS (SELECT epoch_ms('2024-01-05'::TIMESTAMP)::DOUBLE AS a, epoch_ms('2024-01-09'::TIMESTAMP)::DOUBLE AS b) SELECT id, start, \"end\" FROM x, m WHERE \"end\" >= a AND start <= b")
def _(spark, d):
    return views.overlapping(_timed(spark, d), 1704412800000.0, 1704758400000.0).select("id", "start", "end")


def _at_nations(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    tree = forest(_space(spark, d, False))
    members = cut.build_cut(tree, 1)
    return tree, members.join(tree.select("id", "parent"), "id"), written(induced.induced_edges(_space(spark, d).edges, induced.node_cover(tree, members)), "induced")


@registered("matrix_cells", sql.SPACE + f"SELECT src AS row, dst AS col, sum(weight) AS weight, sum(multiplicity)::BIGINT AS edges FROM {sql.induced(1)} GROUP BY 1, 2")
def _(spark, d):
    return views.matrix_cells(_at_nations(spark, d)[2])


@registered(
    "matrix_order",
    sql.SPACE + f""", i AS (SELECT * FROM {sql.induced(1)}), w AS (SELECT id, sum(weight) AS degree FROM (SELECT src AS id, weight FROM i UNION ALL SELECT dst, weight FROM i) GROUP BY 1),
m AS (SELECT f.id, f.parent AS cluster, coalesce(degree, 0) AS degree FROM f LEFT JOIN w USING (id) WHERE depth = 1)
SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, id) - 1 AS place FROM m""",
)
def _(spark, d):
    _, members, edges = _at_nations(spark, d)
    return views.matrix_order(members, edges)


@registered(
    "matrix_order_flat",
    """WITH RECURSIVE m AS (SELECT DISTINCT 'o' || o_orderkey AS id FROM orders), i AS (SELECT 'o' || o_orderkey AS src, 'o' || nxt AS dst, o_custkey FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL),
w AS (SELECT id, count(*) AS degree, any_value(o_custkey) AS c FROM (SELECT src AS id, o_custkey FROM i UNION ALL SELECT dst, o_custkey FROM i) GROUP BY 1),
k AS (SELECT m.id, coalesce(min(m.id) FILTER (WHERE w.c IS NOT NULL) OVER (PARTITION BY w.c), '~') AS cluster, coalesce(degree, 0) AS degree FROM m LEFT JOIN w USING (id))
SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY degree DESC, id) - 1 AS place FROM k""",
)
def _(spark, d):
    """All orders as one flat cut: what follows each other belongs together."""
    edges = tables.precedes(spark, d).select("src", "dst", "kind", F.lit(1.0).alias("weight"))
    members = tables.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"))
    return views.matrix_order(members, edges)


@registered("chat_trees", "SELECT conv_id::VARCHAR AS conversation, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, 'm' || lpad(turn::VARCHAR, 6, '0') AS id, coalesce(text, '') AS text FROM conversations")
def _(spark, d):
    """Conversations as exported trees: whole chains (0), chains whose second message has lost its parent (1), and rings (2)."""
    from ..sources import exports

    t = tables.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = lambda c: F.concat(F.lit("m"), F.lpad(c.cast("string"), 6, "0"))
    order, every = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    way, nth = F.col("conv_id") % 3, F.row_number().over(order)
    t = t.select("*", way.alias("way"), nth.alias("nth"), F.lag(key(F.col("turn"))).over(order).alias("before"), F.lead(key(F.col("turn"))).over(order).alias("after"), F.max(key(F.col("turn"))).over(every).alias("last"))
    parent = F.when((F.col("way") == 1) & (F.col("nth") == 2), F.lit("lost")).when((F.col("way") == 2) & (F.col("nth") == 1), F.col("last")).otherwise(F.col("before"))
    cut = (F.col("way") == 1) & (F.col("nth") == 1)
    message = F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    entry = F.struct(key(F.col("turn")).alias("key"), F.struct(key(F.col("turn")).alias("id"), parent.alias("parent"), F.when(cut | F.col("after").isNull(), F.array().cast("array<string>")).otherwise(F.array("after")).alias("children"), message.alias("message")).alias("value"))
    tree = t.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(entry)).alias("mapping"))
    texts = tree.select(F.col("conv_id").alias("doc"), F.to_json(F.struct(F.col("conv_id").cast("string").alias("conversation_id"), "mapping")).alias("text"))
    return exports.chat_messages(texts).select("conversation", "place", "id", "text")


@registered("view_suitability", sql.SPACE + f", i AS (SELECT count(*) AS m FROM {sql.induced(1)}), k AS (SELECT count(*) AS n FROM f WHERE depth = 1) SELECT 'map' AS view, 0.5::DOUBLE AS score UNION ALL SELECT 'matrix', round(least(1.0::DOUBLE, m::DOUBLE / (n * (n - 1))), 9) FROM i, k UNION ALL SELECT 'outline', 0.6::DOUBLE UNION ALL SELECT 'timeline', 0.0::DOUBLE")
def _(spark, d):
    _, members, edges = _at_nations(spark, d)
    return views.suitability(members, edges)


@registered(
    "outline_rows",
    sql.SPACE + """, s AS (SELECT id, row_number() OVER (PARTITION BY graph_id ORDER BY label, id) - 1 AS k FROM f),
o AS (SELECT x.id, string_agg(lpad(s.k::VARCHAR, 9, '0'), '/' ORDER BY x.i) AS p FROM (SELECT id, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM f) x JOIN s ON s.id = x.a GROUP BY x.id)
SELECT row_number() OVER (ORDER BY p) - 1 AS place, f.id, label, depth::BIGINT AS indent FROM f JOIN o USING (id)""",
)
def _(spark, d):
    return views.outline(forest(_space(spark, d, False)), ["label"]).select(F.col("place").cast("long").alias("place"), "id", "label", "indent")


@registered("layout_grid", "WITH k AS (SELECT 'c' || c_custkey AS id FROM customer), p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM k) SELECT id, (i % 20 * 50)::DOUBLE AS x, (i // 20 * 50)::DOUBLE AS y FROM p")
def _(spark, d):
    return views.grid_layout(_space(spark, d, False).nodes.where("kind = 'core:customer'"), 20, 50.0)


def _boxes(spark, d) -> DataFrame:
    c = tables.table(spark, d, "customer")
    return c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") % 100 * 12).cast("double").alias("x"), (F.col("c_custkey") % 37 * 9).cast("double").alias("y"), (10 + F.col("c_custkey") % 5).cast("double").alias("w"), F.lit(8.0).alias("h"))


_BOXES = "WITH b AS (SELECT 'c' || c_custkey AS id, (c_custkey % 100 * 12)::DOUBLE AS x, (c_custkey % 37 * 9)::DOUBLE AS y, (10 + c_custkey % 5)::DOUBLE AS w, 8.0::DOUBLE AS h FROM customer) "


@registered("viewport_cull", _BOXES + "SELECT id FROM b WHERE x <= 500 AND x + w >= 200 AND y <= 150 AND y + h >= 40")
def _(spark, d):
    return views.cull(_boxes(spark, d), 200.0, 40.0, 500.0, 150.0).select("id")


@registered("nearest_node", _BOXES + "SELECT id FROM b ORDER BY CASE WHEN x <= 301 AND x + w >= 301 AND y <= 77 AND y + h >= 77 THEN 0 ELSE 1 END, CASE WHEN x <= 301 AND x + w >= 301 AND y <= 77 AND y + h >= 77 THEN w * h ELSE (x + w / 2 - 301) ^ 2 + (y + h / 2 - 77) ^ 2 END, id LIMIT 1")
def _(spark, d):
    return views.anchor(_boxes(spark, d), 301.0, 77.0)


@registered("layout_stability", _BOXES + "SELECT round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - sqrt((substr(id, 2)::BIGINT % 7) ^ 2 + (substr(id, 2)::BIGINT % 3) ^ 2) / 40.0::DOUBLE))), 9) AS score FROM b")
def _(spark, d):
    b = _boxes(spark, d)
    k = F.substring("id", 2, 20).cast("long")
    moved = b.select("id", (F.col("x") + k % 7).alias("x"), (F.col("y") + k % 3).alias("y"))
    return views.stability(b, moved, 10.0).select(F.round("score", 9).alias("score"))


# --- shape ------------------------------------------------------------------------------------------------------------------


def _links(spark, d) -> DataFrame:
    """The graph between parts and orders of all line items."""
    rows = tables.table(spark, d, "lineitem")
    return rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("dst"))


_LINKS = "WITH RECURSIVE l AS (SELECT DISTINCT 'p' || l_partkey AS a, 'o' || l_orderkey AS b FROM lineitem), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l) "


@registered("weak_components", _LINKS + """, c AS (SELECT DISTINCT a AS id, a AS component FROM u), r(id, component) USING KEY (id) AS (
  SELECT id, component FROM c UNION SELECT u.b, min(r.component) FROM r JOIN u ON u.a = r.id JOIN recurring.r AS old ON old.id = u.b WHERE r.component < old.component GROUP BY u.b)
SELECT id, component FROM r""")
def _(spark, d):
    return shape.components(_links(spark, d))


@registered("hub_collapse", _LINKS + ", g AS (SELECT a, count(*) AS n, min(b) AS hub FROM u GROUP BY a) SELECT g.hub, g.a AS satellite FROM g JOIN g h ON h.a = g.hub WHERE g.n = 1 AND h.n >= 2")
def _(spark, d):
    return shape.hub_satellites(_links(spark, d))


def _nation_links(spark, d) -> DataFrame:
    return tables.supplies(spark, d).where("src <> dst").select("src", "dst").distinct()


_NATION = sql.SPACE + ", w AS (SELECT 'n' || a AS s, 'n' || b AS t FROM links WHERE a <> b GROUP BY a, b), u AS (SELECT s AS a, t AS b FROM w UNION SELECT t, s FROM w) "


@registered("clustering_coefficient", _NATION + ", deg AS (SELECT a, count(*) AS n FROM u GROUP BY a), tri AS (SELECT x.a, count(*) AS k FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a) SELECT round(avg(2.0::DOUBLE * coalesce(k, 0) / (n * (n - 1))), 9) AS coefficient FROM deg LEFT JOIN tri USING (a) WHERE n >= 2")
def _(spark, d):
    return shape.clustering_coefficient(_nation_links(spark, d)).select(F.round("coefficient", 9).alias("coefficient"))


def _clusters(spark, d) -> DataFrame:
    e = tables.table(spark, d, "embeddings")
    return shape.kmeans(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


@registered("kmeans_assign", None)
def _(spark, d):
    return _clusters(spark, d).select("id", "cluster")


@registered("kmeans_cohesion", None)
def _(spark, d):
    return shape.cohesion(_clusters(spark, d))


@registered("ari_vs_label", None)
def _(spark, d):
    e = tables.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))
    return shape.agreement(_clusters(spark, d).join(e, "id").select("cluster", "truth"))


@registered("label_agreement", """WITH c AS (SELECT label % 3 AS c, label AS t, count(*)::DOUBLE AS n FROM embeddings GROUP BY 1, 2), r AS (SELECT c, sum(n) AS n, max(n) AS top FROM c GROUP BY c), k AS (SELECT t, sum(n) AS n FROM c GROUP BY t),
x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM r) AS a, (SELECT sum(n * (n - 1) / 2) FROM k) AS b, (SELECT sum(n * (n - 1) / 2) FROM c) AS s, (SELECT sum(n) FROM r) AS al, (SELECT sum(top) FROM r) AS top)
SELECT round(top / al, 9) AS purity, round((s - a * b / (al * (al - 1) / 2)) / ((a + b) / 2 - a * b / (al * (al - 1) / 2)), 9) AS ari FROM x""")
def _(spark, d):
    e = tables.table(spark, d, "embeddings").select((F.col("label") % 3).alias("cluster"), F.col("label").alias("truth"))
    return shape.agreement(e).select(F.round("purity", 9).alias("purity"), F.round("ari", 9).alias("ari"))


# --- adapters ---------------------------------------------------------------------------------------------------------------

_EXCHANGES = "WITH x AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)) "


@registered("conv_exchanges", _EXCHANGES + "SELECT conv_id, turn, role, exchange::BIGINT AS exchange FROM x")
def _(spark, d):
    return adapters.exchanges(tables.table(spark, d, "conversations"))


@registered("conv_replies", _EXCHANGES + ", y AS (SELECT conv_id, turn AS src, lag(turn) OVER (PARTITION BY conv_id, exchange ORDER BY turn) AS dst FROM x) SELECT * FROM y WHERE dst IS NOT NULL")
def _(spark, d):
    return adapters.replies(tables.table(spark, d, "conversations"))


@registered("conv_document", _EXCHANGES + "SELECT 'conv:session' AS kind, count(DISTINCT conv_id)::BIGINT AS n FROM x UNION ALL SELECT 'conv:exchange', count(DISTINCT (conv_id, exchange))::BIGINT FROM x UNION ALL SELECT 'conv:' || role, count(*)::BIGINT FROM x GROUP BY role")
def _(spark, d):
    return adapters.conversation_document(tables.table(spark, d, "conversations"))[0].groupBy("kind").agg(F.count("*").alias("n"))


_ESSAY = r"""WITH p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)) AS parts FROM documents WHERE text <> ''),
u AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS part FROM p),
q AS (SELECT doc_id, n, split_part(part, chr(1), 1) AS sentence, coalesce(sum(length(replace(part, chr(1), ''))) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u) """


@registered("essay_spans", _ESSAY + "SELECT doc_id, n::BIGINT AS n, start::BIGINT AS start, length(sentence)::BIGINT AS length FROM q WHERE sentence <> ''")
def _(spark, d):
    return adapters.essay(tables.table(spark, d, "documents")).select("doc_id", "n", "start", "length")


@registered("essay_sentences", _ESSAY + "SELECT doc_id, n::BIGINT AS n, sentence FROM q WHERE sentence <> ''")
def _(spark, d):
    return adapters.essay(tables.table(spark, d, "documents")).select("doc_id", "n", "sentence")


@registered("sibling_order", sql.SPACE + "SELECT id, row_number() OVER (PARTITION BY graph_id ORDER BY label, id) - 1 AS place FROM n")
def _(spark, d):
    w = Window.partitionBy("graph_id").orderBy("label", "id")
    return _space(spark, d, False).nodes.select("id", (F.row_number().over(w) - 1).cast("long").alias("place"))
