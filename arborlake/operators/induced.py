"""Edges between the members of a cut, gathered from all edges below them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, FAN_OUT = 3, 32
#: Parts that the edges between two members are summed in first.
PARTS = 64


def node_cover(tree: DataFrame, cut: DataFrame) -> DataFrame:
    """id, member: the deepest member of the cut on each node's path; nodes above the cut have none and are left out."""
    on = tree.select("id", F.posexplode("path").alias("at", "on"))
    return on.join(cut.select(F.col("id").alias("on")), "on").groupBy("id").agg(F.max_by("on", "at").alias("member"))


def level_cover(tree: DataFrame, level: int) -> DataFrame:
    """node_cover of a plain cut at a level, read off the paths: the node on the path there, or a leaf above it."""
    member = F.when(F.col("depth") >= level, F.get("path", F.lit(level))).when(F.col("is_leaf"), F.col("id"))
    return tree.select("id", member.alias("member")).where("member is not null")


def induced_edges(edges: DataFrame, cover: DataFrame) -> DataFrame:
    """src, dst, kind, weight (sum, null counts 1), multiplicity and samples (the least edge ids); edges within one member go.

    A pair of members may have any number of edges: they are summed in parts first, each with its own least ids.
    """
    sides = [cover.select(F.col("id").alias(c), F.col("member").alias(f"m_{c}")) for c in ("src", "dst")]
    lifted = edges.select("id", "src", "dst", "kind", "weight").join(sides[0], "src").join(sides[1], "dst").where("m_src <> m_dst")
    keys = ["m_src", "m_dst", "kind"]
    salted = lifted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    place = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("id"))
    parts = salted.withColumn("place", place).groupBy(*keys, "part").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"), F.count("*").alias("multiplicity"), F.collect_list(F.when(F.col("place") <= SAMPLES, F.col("id"))).alias("ids"))
    whole = parts.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("multiplicity").alias("multiplicity"), F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, SAMPLES).alias("samples"))
    return whole.select(F.col("m_src").alias("src"), F.col("m_dst").alias("dst"), "kind", "weight", "multiplicity", "samples")


def cap_fan_out(induced: DataFrame, most: int = FAN_OUT) -> tuple[DataFrame, DataFrame]:
    """The heaviest edges out of and into each member (first out, then in over those left), and what was hidden: node, direction,
    hidden, weight, multiplicity."""
    kept, rests = induced, []
    for direction, node, other in (("out", "src", "dst"), ("in", "dst", "src")):
        order = Window.partitionBy(node).orderBy(F.desc("weight"), other, "kind")
        ranked = kept.withColumn("rank", F.row_number().over(order))
        rest = ranked.where(F.col("rank") > most).groupBy(F.col(node).alias("node")).agg(F.count("*").alias("hidden"), F.sum("weight").alias("weight"), F.sum("multiplicity").alias("multiplicity"))
        rests.append(rest.withColumn("direction", F.lit(direction)))
        kept = ranked.where(F.col("rank") <= most).drop("rank")
    return kept, rests[0].unionByName(rests[1])


def refreshed(induced: DataFrame, edges: DataFrame, cover: DataFrame, touched: DataFrame) -> DataFrame:
    """Induced edges after a change of edges at some nodes (touched: id): only pairs with a member over a touched node are computed
    again. The nodes themselves must be as before."""
    hit = cover.join(touched.select("id").distinct(), "id", "left_semi").select("member").distinct()
    over = cover.join(hit, "member", "left_semi").select("id")
    old = induced.join(hit.select(F.col("member").alias("src")), "src", "left_anti").join(hit.select(F.col("member").alias("dst")), "dst", "left_anti")
    near = edges.join(over.select(F.col("id").alias("src")), "src", "left_semi").unionByName(edges.join(over.select(F.col("id").alias("src")), "src", "left_anti").join(over.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return old.unionByName(induced_edges(near, cover))
