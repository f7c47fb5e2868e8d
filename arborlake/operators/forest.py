"""The containment forest: which node holds which graph, and what follows from it for every node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Space
from ..plans.scratch import Levels, written


def containment_index(space: Space) -> DataFrame:
    """graph, in_graph, node: the node that holds each graph; the least (graph, id) where several claim it."""
    claims = space.nodes.where("detail_graph is not null").groupBy(F.col("detail_graph").alias("graph")).agg(F.min(F.struct("graph_id", "id")).alias("c"))
    held = claims.select("graph", F.col("c.graph_id").alias("in_graph"), F.col("c.id").alias("node"))
    return held.join(space.graphs.select(F.col("id").alias("graph")), "graph", "left_semi")


def derived_roots(space: Space) -> DataFrame:
    """Graphs that no node holds."""
    return space.graphs.select("id").join(space.nodes.select(F.col("detail_graph").alias("id")), "id", "left_anti")


def forest(space: Space, measures: bool = True, levels: int | None = None) -> DataFrame:
    """Every node that is reachable from a root: graph_id, id, kind, label, detail_graph, depth, path, parent, is_leaf, and with
    measures also leaves, size (of its subtree, itself included) and children.

    Levels are joined one after the other, each on the edge of the last, down to the deepest; a graph has one holder, so cycles are
    never entered from a root. A node is a leaf if its detail graph is missing or has no node. levels limits how deep the forest is
    read.
    """
    nodes = space.nodes.select("graph_id", "id", "kind", "label", "detail_graph")
    filled = nodes.groupBy(F.col("graph_id").alias("detail_graph")).agg(F.count("*").alias("children"))
    # Nodes without a detail graph stay out of the join: one task would get them all, as they have the same (null) key.
    plain = nodes.where("detail_graph is null").withColumns({"children": F.lit(0).cast("long"), "holds": F.lit(False)})
    nodes = nodes.where("detail_graph is not null").join(filled, "detail_graph", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))
    holders = containment_index(space).select(F.col("graph").alias("held_graph"), F.col("node").alias("held_by"))
    holds = F.col("held_by").isNotNull() & (F.col("children") > 0)
    nodes = nodes.join(holders, (F.col("detail_graph") == F.col("held_graph")) & (F.col("id") == F.col("held_by")), "left").withColumn("holds", holds).drop("held_graph", "held_by")
    # Written once, as every level reads them: the holders are found by a sort of all claims.
    nodes = written(nodes, "holders").unionByName(plain)
    roots = written(derived_roots(space).select(F.col("id").alias("graph_id")), "roots")
    level = nodes.join(roots, "graph_id", "left_semi").withColumns({"path": F.array("id"), "parent": F.lit(None).cast("string")})
    found, depth = Levels(space.nodes.sparkSession, "forest"), 0
    while True:
        # Written level by level: none is computed twice, and the plan stays small, however deep the forest.
        level = found.add(level.withColumn("depth", F.lit(depth).cast("long")))
        if depth + 1 == levels or level.where("holds").isEmpty():
            break
        inner = level.where("holds").select(F.col("detail_graph").alias("graph_id"), F.col("id").alias("parent"), F.col("path").alias("above"))
        level = nodes.join(inner, "graph_id").withColumn("path", F.concat("above", F.array("id"))).drop("above")
        depth += 1
    return measured(found, depth) if measures else found.all().drop("holds").withColumn("is_leaf", F.col("children") == 0)


def measured(levels: Levels, deepest: int) -> DataFrame:
    """The forest with leaves and size, added up from the deepest level: each level is joined with its children's sums only."""
    found, below = Levels(levels.spark, "forest-measured"), None
    for depth in range(deepest, -1, -1):
        level = levels.one(depth).drop("holds").withColumn("is_leaf", F.col("children") == 0)
        if below is None:
            level = level.withColumns({"in_leaves": F.lit(0).cast("long"), "in_size": F.lit(0).cast("long")})
        else:
            level = level.join(below.groupBy(F.col("parent").alias("id")).agg(F.sum("leaves").alias("in_leaves"), F.sum("size").alias("in_size")), "id", "left")
        leaves = F.when(F.col("is_leaf"), F.lit(1)).otherwise(F.coalesce("in_leaves", F.lit(0))).cast("long")
        below = found.add(level.withColumns({"leaves": leaves, "size": 1 + F.coalesce("in_size", F.lit(0))}).drop("in_leaves", "in_size"))
    return found.all()


def max_depth(tree: DataFrame) -> DataFrame:
    """max_depth; -1 for an empty forest."""
    return tree.agg(F.coalesce(F.max("depth"), F.lit(-1)).cast("long").alias("max_depth"))


def containment_paths(space: Space) -> DataFrame:
    """graph, depth and path (graph ids from a root down to it) of every graph that a root reaches."""
    steps = containment_index(space).select("graph", "in_graph")
    level = derived_roots(space).select(F.col("id").alias("graph"), F.array("id").alias("path"))
    found, depth = Levels(space.nodes.sparkSession, "paths"), 0
    while True:
        level = found.add(level.withColumn("depth", F.lit(depth).cast("long")))
        if level.isEmpty():
            return found.all()
        level = steps.join(level.select(F.col("graph").alias("in_graph"), "path"), "in_graph").select("graph", F.concat("path", F.array("graph")).alias("path"))
        depth += 1


def rebase(tree: DataFrame, links: DataFrame) -> DataFrame:
    """Links between any two nodes, moved up to the lowest graph that holds an ancestor of both ends: graph_id, id, src, dst, kind,
    weight. Links within one such ancestor go."""
    ends = tree.select("id", "path")
    joined = links.join(ends.select(F.col("id").alias("src"), F.col("path").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("path").alias("b")), "dst")
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    up = joined.withColumn("same", same).where("same < size(a) and same < size(b)")
    moved = up.select(F.get("a", F.col("same")).alias("src"), F.get("b", F.col("same")).alias("dst"), "id", "kind", "weight")
    return moved.join(tree.select(F.col("id").alias("src"), "graph_id"), "src")


def incident_degree(space: Space) -> DataFrame:
    """id, degree: edges at each node; a loop counts twice."""
    ends = space.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return space.nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def rolled_up(tree: DataFrame, values: DataFrame) -> DataFrame:
    """id, low, high: the least and greatest value (id, value) in each node's subtree; nodes without one are left out."""
    return tree.join(values, "id").select(F.explode("path").alias("id"), "value").groupBy("id").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def subspace(space: Space, graph: str) -> Space:
    """What is reachable from one graph, its nodes and edges included."""
    inside = containment_paths(space).where(F.array_contains("path", graph)).select(F.col("graph").alias("graph_id"))
    keep = lambda df: df.join(inside, "graph_id", "left_semi")
    return Space(space.graphs.join(inside, F.col("id") == F.col("graph_id"), "left_semi"), keep(space.nodes), keep(space.edges))


def ordered_paths(tree: DataFrame, keys: list) -> DataFrame:
    """id, order_path: the positions of a node and its ancestors among their siblings, which are ordered by keys and id."""
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy(*keys, "id")) - 1
    placed = tree.select("id", place.cast("int").alias("place"))
    steps = tree.select("id", F.posexplode("path").alias("at", "on"))
    joined = steps.join(placed.select(F.col("id").alias("on"), "place"), "on")
    return joined.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda s: s["place"]).alias("order_path"))
