"""Queries over deltas applied in order: one delta for each customer, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered
from . import tables
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


def _deltas(spark, d) -> DataFrame:
    """By the customer's number, modulo 6: all orders and the graph go, in order (0), the same but the last edge stays (1), the graph
    goes with all in it (2), an id comes again (3), a node is put above itself (4), an edge leaves its graph (5)."""
    customer = tables.table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 6).alias("way"))
    by_date = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    every = Window.partitionBy("o_custkey")
    orders = tables.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by_date).alias("k"), F.count("*").over(every).alias("n"))
    own = F.col("c_custkey").cast("string")
    gc, gn, c = (F.concat(F.lit(p), x.cast("string")) for p, x in (("gc", F.col("c_custkey")), ("gn", F.col("c_nationkey")), ("c", F.col("c_custkey"))))

    def op(rows: DataFrame, i: Column, t: str, graph: Column, id_: Column, next_: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("string")
        return rows.select(F.col("c_custkey").alias("delta"), i.cast("long").alias("i"), F.lit(t).alias("t"), graph.alias("graph_id"), id_.alias("id"), none.alias("key"), none.alias("prev"), (none if next_ is None else next_).alias("next"))

    def payload(**x: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in x.items()], F.lit("source").alias("origin")))

    made = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"))
    going = made.where("way in (0, 1)")
    edges = F.greatest(F.col("n") - 1 - F.col("way"), F.lit(0))
    totals = customer.where("way in (0, 1)").join(orders.where("k = 1"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    new = F.concat(F.lit("new"), own)
    node = payload(id=new, kind=F.lit("core:order"), label=F.lit("new"))
    rows = [
        op(going.where("k < n - way"), F.col("k") - 1, "edge:remove", gc, F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))),
        op(going, edges + F.col("k") - 1, "node:remove", gc, F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))),
        op(totals, edges + F.col("n"), "node:detail", gn, c),
        op(totals, edges + F.col("n") + 1, "graph:remove", gc, gc),
        op(customer.where("way = 2"), F.lit(0), "graph:remove", gc, gc),
        op(customer.where("way in (3, 5)"), F.lit(0), "node:add", gc, new, node),
        op(customer.where("way = 3"), F.lit(1), "node:add", gc, c, payload(id=c, kind=F.lit("core:order"), label=F.lit("again"))),
        op(customer.where("way = 4"), F.lit(0), "node:detail", gn, c, F.lit("root")),
        op(customer.where("way = 5"), F.lit(1), "edge:add", gc, F.concat(F.lit("e"), own), payload(src=new, dst=c, kind=F.lit("core:precedes"))),
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return written(out, "customer-deltas")


_REJECTED = """
WITH o AS (
  SELECT o_custkey AS c, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders
), r AS (
  SELECT c AS delta, n - 2 + n - 2 AS i, 'node-has-edges' AS code, 'gc' || c AS graph_id, 'o' || o_orderkey AS id FROM o WHERE c % 6 = 1 AND n > 1 AND k = n - 1
  UNION ALL SELECT c_custkey, 0, CASE WHEN c_custkey IN (SELECT c FROM o) THEN 'graph-not-empty' ELSE 'graph-contained' END, 'gc' || c_custkey, 'gc' || c_custkey FROM customer WHERE c_custkey % 6 = 2
  UNION ALL SELECT c_custkey, 1, 'duplicate-id', 'gc' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 6 = 3
  UNION ALL SELECT c_custkey, 0, 'containment-cycle', 'gn' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_custkey % 6 = 4
  UNION ALL SELECT c_custkey, 1, 'cross-graph-edge', 'gc' || c_custkey, 'e' || c_custkey FROM customer WHERE c_custkey % 6 = 5
)
"""


@registered("apply_rejections", _REJECTED + "SELECT delta, i::BIGINT AS i, code, graph_id, id FROM r")
def _(spark, d):
    return ordered.rejections(tables.space(spark, d, links=False), _deltas(spark, d))


@registered("apply_ordered", "SELECT 'graphs' AS what, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT 'nodes', count(*) FROM orders WHERE o_custkey % 6 <> 0 UNION ALL SELECT 'edges', count(*) FROM (SELECT row_number() OVER (PARTITION BY o_custkey) AS k FROM orders WHERE o_custkey % 6 <> 0) WHERE k > 1 UNION ALL SELECT 'refused', 0")
def _(spark, d):
    """The sound deltas as one, in the order of customers."""
    log = _deltas(spark, d).where("delta % 6 = 0").select("*", F.lit("s").alias("site"), F.floor(F.col("delta") / 6).alias("counter"))
    one, _ = ordered.composed(log.drop("delta"))
    after, refused = ordered.apply(tables.space(spark, d, links=False), one)
    counts = [(after.graphs.where("id like 'gc%'"), "graphs"), (after.nodes.where("kind = 'core:order'"), "nodes"), (after.edges, "edges"), (refused, "refused")]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n") for df, name in counts]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
