"""The driver's relational tables as a graph space: region > nation > customer > order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Space

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, c: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = spark.createDataFrame([("root", "all")], "id string, label string")
    parts = [(t, p, k, n) for t, p, k, n in (("region", "gr", "r_regionkey", "r_name"), ("nation", "gn", "n_nationkey", "n_name"), ("customer", "gc", "c_custkey", "c_name"))]
    for name, prefix, key, label in parts:
        root = root.unionByName(table(spark, sf_dir, name).select(_id(prefix, key).alias("id"), F.col(label).alias("label")))
    return root.withColumns({"domain": F.lit("core"), "origin": F.lit("source")})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(None).cast("string")
    attr = lambda key, c: F.create_map(F.lit(key), F.to_json(F.struct(F.col(c).alias("v")))) if key else F.lit(None).cast("map<string,string>")
    specs = [
        ("region", F.lit("root"), "r", "r_regionkey", "core:region", "r_name", "gr", None, None),
        ("nation", _id("gr", "n_regionkey"), "n", "n_nationkey", "core:nation", "n_name", "gn", None, None),
        ("customer", _id("gn", "c_nationkey"), "c", "c_custkey", "core:customer", "c_name", "gc", "tpch:segment", "c_mktsegment"),
        ("orders", _id("gc", "o_custkey"), "o", "o_orderkey", "core:order", "o_orderpriority", None, "tpch:status", "o_orderstatus"),
    ]
    out = None
    for name, graph, prefix, key, kind, label, detail, attr_key, attr_col in specs:
        part = table(spark, sf_dir, name).select(
            graph.alias("graph_id"), _id(prefix, key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"),
            (_id(detail, key) if detail else no).alias("detail_graph"), attr(attr_key, attr_col).alias("attrs"), F.lit("source").alias("origin"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def precedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each order to its customer's next one."""
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("next", after).where("next is not null")
    return rows.select(_id("gc", "o_custkey").alias("graph_id"), _id("p", "o_orderkey").alias("id"), _id("o", "o_orderkey").alias("src"), _id("o", "next").alias("dst"), F.lit("core:precedes").alias("kind"), F.lit(None).cast("double").alias("weight"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link for each line item: from the supplier's nation to the customer's (ids number the lines of an order)."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    lines = table(spark, sf_dir, "lineitem").withColumn("number", number)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("from_nation"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("to_nation"))
    # Orders get their customer's nation first: that way the line items, which are many more, are shuffled by their order only.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "to_nation")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(F.concat(F.lit("s"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("number").cast("string")).alias("id"), _id("n", "from_nation").alias("src"), _id("n", "to_nation").alias("dst"), F.lit("core:supplies").alias("kind"), F.col("l_quantity").alias("weight"))


def space(spark: SparkSession, sf_dir: str, links: bool = True, tree: DataFrame | None = None) -> Space:
    """The whole space. Links across graphs are moved up to the lowest graph that both ends are in; tree is its forest, if known."""
    from ..operators.forest import forest, rebase

    found = Space(graphs(spark, sf_dir), nodes(spark, sf_dir), precedes(spark, sf_dir))
    if links:
        up = rebase((forest(found, measures=False, levels=2) if tree is None else tree).where("depth <= 1"), supplies(spark, sf_dir))
        found = found.with_(edges=found.edges.unionByName(up.select("graph_id", "id", "src", "dst", "kind", "weight")))
    return found.with_(edges=found.edges.withColumns({"attrs": F.lit(None).cast("map<string,string>"), "origin": F.lit("derived")}))
