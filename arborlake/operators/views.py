"""Views of a space: outline, matrix, timeline, and which suits best; and simple layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .forest import ordered_paths


def outline(tree: DataFrame, keys: list) -> DataFrame:
    """place, id, label, indent: the rows in the order of their paths; depth is counted from the shallowest.

    Places come from a range partitioning, so no task sorts all rows: each part's rows are numbered and begin where the one
    before ends.
    """
    rows = tree.join(ordered_paths(tree, keys), "id").withColumn("text_path", F.array_join(F.transform("order_path", lambda x: F.lpad(x.cast("string"), 9, "0")), "/"))
    top = F.broadcast(tree.agg(F.min("depth").alias("least")))  # one row
    return numbered(rows.join(top).select("id", "label", (F.col("depth") - F.col("least")).alias("indent"), "text_path"), "text_path", "place").select("place", "id", "label", "indent")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """df with places from 0 in the order of a column without ties."""
    parts = df.repartitionByRange(by).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(by)
    parts = parts.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    from ..plans.scratch import written

    parts = written(parts, "numbered")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each part
    return parts.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn(name, F.col("_row") + F.col("_start")).drop("_part", "_row", "_start")


def matrix_cells(induced: DataFrame) -> DataFrame:
    """row, col, weight, edges: summed over kinds."""
    return induced.groupBy(F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.sum("weight").alias("weight"), F.sum("multiplicity").alias("edges"))


def weighted_degree(induced: DataFrame) -> DataFrame:
    ends = induced.select(F.explode(F.array("src", "dst")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def matrix_order(members: DataFrame, induced: DataFrame) -> DataFrame:
    """id, cluster, place of a matrix's rows (members: id, parent; edges between them). If there is more than one parent, the clusters are
    the parents (those without one: an empty name), and members without an edge are in them too. Else the clusters are what the edges
    connect, by the least id, and members without an edge come last, as "~". Within a cluster the heaviest come first, then by id."""
    from .shape import components

    ends = [members.select(F.col("id").alias(c)) for c in ("src", "dst")]
    inner = induced.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi")
    rows = members.select("id", F.coalesce("parent", F.lit("")).alias("parent")).join(weighted_degree(inner), "id", "left")
    if members.select("parent").distinct().limit(2).count() > 1:
        rows = rows.withColumn("cluster", F.col("parent"))
    else:
        rows = rows.join(components(inner.select("src", "dst")), "id", "left").withColumn("cluster", F.coalesce("component", F.lit("~")))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.coalesce("degree", F.lit(0.0))), "id")
    return rows.select("id", "cluster", (F.row_number().over(order) - 1).cast("long").alias("place"))


def timeline(events: DataFrame) -> DataFrame:
    """id, lane, lane_name, start, end of timed events (id, lane_name, start, end); lanes are numbered by name, unnamed last."""
    timed = events.where("start is not null").withColumn("lane_name", F.coalesce("lane_name", F.lit("(none)"))).withColumn("end", F.greatest("end", "start"))
    lanes = timed.select("lane_name").distinct()
    order = Window.orderBy(F.when(F.col("lane_name") == "(none)", 1).otherwise(0), "lane_name")  # one row for each lane
    return timed.join(lanes.withColumn("lane", (F.row_number().over(order) - 1).cast("long")), "lane_name").select("id", "lane", "lane_name", "start", "end")


def extent(events: DataFrame) -> DataFrame:
    """start, end in ms over all events, with 2 % of padding, or 30 s if they are one instant."""
    e = events.agg(F.min("start").alias("a"), F.max("end").alias("b"))
    pad = F.when(F.col("a") == F.col("b"), F.lit(30_000.0)).otherwise((F.col("b") - F.col("a")) * 0.02)
    return e.select((F.col("a") - pad).alias("start"), (F.col("b") + pad).alias("end"))


def overlapping(events: DataFrame, start: float, end: float) -> DataFrame:
    """Events that share an instant with a closed window; both predicates reach the scan."""
    return events.where((F.col("end") >= start) & (F.col("start") <= end))


def suitability(members: DataFrame, induced: DataFrame, timed: int = 0) -> DataFrame:
    """view, score of the views of a cut, best first by score: the map always suits somewhat, a matrix when edges are dense, a
    timeline when members are timed, an outline when members are nested."""
    n = members.agg(F.count("*").alias("n"), F.countDistinct("parent").alias("parents"))
    e = induced.agg(F.count("*").alias("m"))
    one = n.join(F.broadcast(e))  # one row each
    density = F.least(F.lit(1.0), F.col("m") / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1)))
    nested = F.when(F.col("parents") > 1, 0.6).otherwise(0.3)
    views = F.array(*[F.struct(F.lit(v).alias("view"), s.alias("score")) for v, s in (("map", F.lit(0.5)), ("matrix", density), ("outline", nested), ("timeline", F.lit(timed) / F.greatest(F.col("n"), F.lit(1))))])
    return one.select(F.explode(views).alias("v")).select("v.view", F.round("v.score", 9).alias("score"))


def grid_layout(members: DataFrame, columns: int, spacing: float) -> DataFrame:
    """id, x, y: members in rows of a grid, by id."""
    placed = numbered(members.select("id"), "id", "place")
    return placed.select("id", ((F.col("place") % columns) * spacing).cast("double").alias("x"), (F.floor(F.col("place") / columns) * spacing).cast("double").alias("y"))


def cull(boxes: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    """Boxes (x, y, w, h) that touch a viewport."""
    return boxes.where((F.col("x") <= x2) & (F.col("x") + F.col("w") >= x1) & (F.col("y") <= y2) & (F.col("y") + F.col("h") >= y1))


def anchor(boxes: DataFrame, x: float, y: float) -> DataFrame:
    """The smallest box that holds a point, else the nearest by its centre; ties by id."""
    inside = (F.col("x") <= x) & (F.col("x") + F.col("w") >= x) & (F.col("y") <= y) & (F.col("y") + F.col("h") >= y)
    away = F.pow(F.col("x") + F.col("w") / 2 - x, 2) + F.pow(F.col("y") + F.col("h") / 2 - y, 2)
    order = F.struct(F.when(inside, 0).otherwise(1), F.when(inside, F.col("w") * F.col("h")).otherwise(away), F.col("id"))
    return boxes.agg(F.min_by("id", order).alias("id"))


def stability(before: DataFrame, after: DataFrame, gap: float) -> DataFrame:
    """score: mean over nodes in both layouts (id, x, y) of 1 less the distance moved in units of four gaps, within 0..1."""
    both = before.alias("a").join(after.alias("b"), "id")
    moved = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return both.agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - moved / (4 * gap)))), F.lit(1.0)).alias("score"))
