"""Proposals, recorded calls, budgets, arbitration and source queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import assist, delta, proposals
from ..sources import exports
from . import sql, tables

QUERIES: dict = {}
ORACLES: dict = {}


def registered(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


_GROUPS = sql.SPACE + ", m AS (SELECT 'c' || c_custkey AS id, 'gn' || c_nationkey AS graph, c_mktsegment AS seg FROM customer), k AS (SELECT graph, seg FROM m GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT * FROM m JOIN k USING (graph, seg)) "


@registered("proposal_operations", _GROUPS + "SELECT t, n::BIGINT AS n FROM (SELECT 'graph:add' AS t, (SELECT count(*) FROM k) AS n UNION ALL SELECT 'node:add', (SELECT count(*) FROM k) + (SELECT count(*) FROM x) UNION ALL SELECT 'node:remove', (SELECT count(*) FROM x)) WHERE n > 0")
def _(spark, d):
    space = tables.space(spark, d, links=False)
    ops = proposals.operations(space, proposals.by_attribute(space, "core:customer", "tpch:segment"))
    return ops.groupBy("t").agg(F.count("*").alias("n"))


@registered("proposal_refusals", sql.SPACE + ", m AS (SELECT 'gn' || c_nationkey AS graph, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2) SELECT 'too-small' AS code, count(*)::BIGINT AS n FROM m WHERE n = 1 HAVING count(*) > 0")
def _(spark, d):
    space = tables.space(spark, d, links=False)
    return proposals.refusals(space, proposals.by_attribute(space, "core:customer", "tpch:segment")).groupBy("code").agg(F.count("*").alias("n"))


@registered("proposal_applied", _GROUPS + "SELECT (SELECT count(*) FROM n)::BIGINT + (SELECT count(*) FROM k)::BIGINT AS nodes, (SELECT count(*) FROM x)::BIGINT AS moved")
def _(spark, d):
    space = tables.space(spark, d, links=False)
    after = delta.apply(space, proposals.operations(space, proposals.by_attribute(space, "core:customer", "tpch:segment")))
    own = space.graphs.select(F.col("id").alias("graph_id"))
    moved = after.nodes.join(own, "graph_id", "left_anti").agg(F.count("*").alias("moved"))
    return after.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(moved))  # one row each


@registered("budget_status", "WITH c AS (SELECT user_id AS session, event_id AS seq, round(abs(value))::DOUBLE AS cost FROM events), b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM c) SELECT session, seq, before AS spent, CASE WHEN before >= 500 THEN 'stopped' WHEN before + cost >= 400 THEN 'warned' ELSE 'ok' END AS status FROM b")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    return assist.budget_status(ev.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.round(F.abs("value")).alias("cost")), 500.0)


@registered("replay_calls", "SELECT n_name AS input, 'answer ' || n_nationkey AS answer FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, d):
    nation = tables.table(spark, d, "nation")
    calls = nation.select(F.lit("name").alias("prompt"), F.lit(1).alias("version"), F.col("n_name").alias("input"), "n_nationkey")
    recorded = assist.call_key(calls.where("n_nationkey % 3 <> 0")).select("key", F.concat(F.lit("answer "), F.col("n_nationkey").cast("string")).alias("answer"))
    return assist.replayed(calls.drop("n_nationkey"), recorded)[0].select("input", "answer")


@registered("replay_misses", "SELECT n_name AS input FROM nation WHERE n_nationkey % 3 = 0")
def _(spark, d):
    nation = tables.table(spark, d, "nation")
    calls = nation.select(F.lit("name").alias("prompt"), F.lit(1).alias("version"), F.col("n_name").alias("input"), "n_nationkey")
    recorded = assist.call_key(calls.where("n_nationkey % 3 <> 0")).select("key", F.lit("x").alias("answer"))
    return assist.replayed(calls.drop("n_nationkey"), recorded)[1].select("input")


@registered(
    "token_f1",
    r"""WITH p AS (SELECT a.p_partkey AS id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1), x AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split(lower(a), ' ')) AS w FROM p) GROUP BY 1, 2), y AS (SELECT id, w, count(*) AS m FROM (SELECT id, unnest(string_split(lower(b), ' ')) AS w FROM p) GROUP BY 1, 2)
SELECT id, 2.0::DOUBLE * sum(least(coalesce(n, 0), coalesce(m, 0))) / (sum(coalesce(n, 0)) + sum(coalesce(m, 0))) AS f1 FROM x FULL JOIN y USING (id, w) GROUP BY id""",
)
def _(spark, d):
    part = tables.table(spark, d, "part")
    after = part.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b"))
    return assist.token_f1(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a")).join(after, "id"))


@registered("sound_proposals", "WITH e AS (SELECT user_id AS request, event_id AS at, event_type AS id FROM events), k AS (SELECT DISTINCT request, id FROM e), g AS (SELECT user_id AS request, event_type AS src, CASE WHEN event_id % 4 = 0 THEN 'lost' ELSE event_type END AS dst FROM events), ok AS (SELECT * FROM g WHERE dst <> 'lost') SELECT request, ((SELECT count(*) FROM e WHERE e.request = r.request) - (SELECT count(*) FROM k WHERE k.request = r.request) + (SELECT count(*) FROM g WHERE g.request = r.request) - (SELECT count(*) FROM ok WHERE ok.request = r.request))::BIGINT AS dropped FROM (SELECT DISTINCT request FROM e) r")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    nodes = ev.select(F.col("user_id").alias("request"), F.col("event_id").alias("at"), F.col("event_type").alias("id"))
    edges = ev.select(F.col("user_id").alias("request"), F.col("event_type").alias("src"), F.when(F.col("event_id") % 4 == 0, "lost").otherwise(F.col("event_type")).alias("dst"))
    return assist.sound(nodes, edges)[2]


@registered("arbitration", "WITH s AS (SELECT page_id, 'a' AS parser, (page_id % 5) / 4.0 AS score FROM pages UNION ALL SELECT page_id, 'b', (page_id % 3) / 2.0 FROM pages), t AS (SELECT page_id, max(score) AS best FROM s GROUP BY 1), u AS (SELECT s.page_id, best, count(*) FILTER (WHERE score = best) AS n, min(parser) FILTER (WHERE score = best) AS parser FROM s JOIN t USING (page_id) GROUP BY 1, 2) SELECT page_id::VARCHAR AS uri, CASE WHEN best > 0 AND n = 1 THEN parser END AS parser, CASE WHEN best <= 0 THEN 'no-parser' WHEN n > 1 THEN 'ambiguous-source' END AS code FROM u")
def _(spark, d):
    pages = tables.table(spark, d, "pages")
    uri = F.col("page_id").cast("string").alias("uri")
    scores = pages.select(uri, F.lit("a").alias("parser"), ((F.col("page_id") % 5) / 4.0).alias("score")).unionByName(pages.select(uri, F.lit("b").alias("parser"), ((F.col("page_id") % 3) / 2.0).alias("score")))
    return exports.arbitrate(scores)


@registered("assignment_states", "SELECT user_id AS job, CASE WHEN bool_or(event_type = 'error') THEN 'escalated' WHEN bool_or(event_type = 'purchase') THEN 'delivered' ELSE 'in_progress' END AS state, arg_min(epoch_us(ts) // 1000, event_id)::BIGINT AS started, arg_max(epoch_us(ts) // 1000, event_id)::BIGINT AS ended FROM events GROUP BY 1")
def _(spark, d):
    ev = tables.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "escalation").when(F.col("event_type") == "purchase", "deliverable").otherwise("note")
    return exports.assignment_states(ev.select(F.col("user_id").alias("job"), F.col("event_id").alias("at"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind")))


_DIRS = "WITH p AS (SELECT 'src/' || lower(p_brand) || '/' || p_partkey AS path FROM part), s AS (SELECT string_split(path, '/') AS x FROM p), e AS (SELECT DISTINCT array_to_string(x[1:k], '/') AS path FROM s, (VALUES (1), (2), (3)) t(k)) "


@registered("project_tree", _DIRS + "SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent, string_split(path, '/')[-1] AS name FROM e")
def _(spark, d):
    part = tables.table(spark, d, "part")
    return exports.directories(part.select(F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path")))


@registered("name_segments", "WITH s AS (SELECT p_type AS path, p_brand AS name, p_size::VARCHAR AS signature, p_partkey AS line FROM part) SELECT path, name, line, CASE WHEN count(*) OVER (PARTITION BY path, name) = 1 THEN name WHEN count(*) OVER (PARTITION BY path, name, signature) = 1 THEN name || '#' || signature ELSE name || '#' || signature || '~' || row_number() OVER (PARTITION BY path, name, signature ORDER BY line) END AS segment FROM s")
def _(spark, d):
    part = tables.table(spark, d, "part")
    return exports.segments(part.select(F.col("p_type").alias("path"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("signature"), F.col("p_partkey").alias("line")))


@registered("back_edges", None)
def _(spark, d):
    return assist.back_edge_ratio(tables.space(spark, d).edges.where("kind = 'core:supplies'").select("graph_id", "src", "dst").distinct())


@registered("camera_zoom", "SELECT p_partkey AS id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ln(p_retailprice) - ln(100.0::DOUBLE)) / (ln(5000.0::DOUBLE) - ln(100.0::DOUBLE)))), 9) AS zoom, greatest(72, least(260, 24 + length(p_name) * 7))::BIGINT AS width FROM part")
def _(spark, d):
    part = tables.table(spark, d, "part")
    return part.select(F.col("p_partkey").alias("id"), F.round(geometry.zoom_for_scale(F.col("p_retailprice"), 100.0, 5000.0), 9).alias("zoom"), geometry.node_width(F.col("p_name")).cast("long").alias("width"))
