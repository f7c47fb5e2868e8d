"""Level-of-detail cuts: sets of nodes that cover every leaf exactly once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Levels, written

#: Thresholds rise evenly; a level is entered or left only beyond half of this band around its threshold.
HYSTERESIS = 0.05


def thresholds(max_level: int) -> list[float]:
    """Zooms at which the levels 1, 2, .. begin."""
    return [(k + 1) / (max_level + 1) for k in range(max_level)]


def nominal_level(zoom: Column, steps: list[float]) -> Column:
    return sum((F.when(zoom >= s, 1).otherwise(0) for s in steps), F.lit(0)).cast("long")


def build_cut(tree: DataFrame, level: int) -> DataFrame:
    """Nodes at the level, and leaves above it: id, graph_id, depth, reason, covered_leaves."""
    at = tree.where((F.col("depth") == level) | (F.col("is_leaf") & (F.col("depth") < level)))
    return at.select("id", "graph_id", "depth", F.when(F.col("depth") == level, "level").otherwise("leaf").alias("reason"), F.col("leaves").alias("covered_leaves"))


def coverage(tree: DataFrame, cut: DataFrame) -> DataFrame:
    """total_leaves, covered_once, uncovered, covered_twice over all leaves of the forest.

    Members on each node's path are counted down the levels, from its parent's count: leaves are not joined by all their ancestors,
    as those of one root would be one task's.
    """
    marks = written(cut.groupBy("id").agg(F.count("*").alias("hit")), "coverage-members")
    found, above, depth = Levels(tree.sparkSession, "coverage"), None, 0
    while True:
        level = tree.where(F.col("depth") == depth).select("id", "parent", "is_leaf").join(marks, "id", "left").withColumn("n", F.coalesce("hit", F.lit(0))).drop("hit")
        if above is not None:
            level = above.where("not is_leaf").select(F.col("id").alias("parent"), F.col("n").alias("before")).join(level, "parent").withColumn("n", F.col("n") + F.col("before")).drop("before")
        above = found.add(level)
        if above.where("not is_leaf").isEmpty():
            break
        depth += 1
    hits = found.all().where("is_leaf")
    return hits.agg(*[F.count_if(c).cast("long").alias(n) for n, c in (("total_leaves", F.lit(True)), ("covered_once", F.col("n") == 1), ("uncovered", F.col("n") == 0), ("covered_twice", F.col("n") > 1))])


def effective_overrides(tree: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, override of what counts among overrides (id, kind: pin, expand or collapse), and id, kind, reason of what is ignored: nodes
    that aren't there (removed) or lie below a pinned one (shadowed). Of several for one node the least kind counts."""
    marks = overrides.groupBy("id").agg(F.min("kind").alias("kind"))
    placed = written(marks.join(tree.select("id", "path"), "id", "left"), "overrides")
    pins = placed.where("kind = 'pin' and path is not null").select(F.col("id").alias("on"))
    under = placed.select("id", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("on")).join(pins, "on", "left_semi").select("id").distinct()
    there = placed.join(under.withColumn("under", F.lit(True)), "id", "left")
    ignored = there.withColumn("reason", F.when(F.col("path").isNull(), "removed").when(F.col("under"), "shadowed"))
    return there.where("path is not null and under is null").select("id", F.col("kind").alias("override")), ignored.where("reason is not null").select("id", "kind", "reason")


def _on_the_way(tree: DataFrame, ids: DataFrame, itself: bool) -> DataFrame:
    """Nodes that lie above the ids, and themselves if so."""
    path = F.col("path") if itself else F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    return tree.join(ids.select("id"), "id", "left_semi").select(F.explode(path).alias("id")).distinct()


def override_cut(tree: DataFrame, level: int, overrides: DataFrame, cold: DataFrame | None = None) -> DataFrame:
    """A cut under overrides (id, kind: pin, expand or collapse) and graphs that aren't loaded (cold: graph_id).

    A pin stops the descent. An expanded node is opened, unless it is a leaf or its inside is cold. A collapsed one stops, unless some
    pin or expand below needs it open. Without an override, a leaf stops (as cold if its inside is, and it is above the level), and any
    other at the level or below, unless it is needed open: as level there, and as expand-parent below, where only what is around it was
    opened. Overrides below a pin, and of nodes that aren't there, have no effect (effective_overrides returns them). The topmost stop
    on each path is the member, which needs no recursion.
    """
    marks = effective_overrides(tree, overrides)[0]
    t = tree.join(marks, "id", "left")
    if cold is not None:
        t = t.join(cold.select(F.col("graph_id").alias("detail_graph"), F.lit(True).alias("is_cold")).distinct(), "detail_graph", "left")
    else:
        t = t.withColumn("is_cold", F.lit(None).cast("boolean"))
    opened = _on_the_way(tree, marks.where("override in ('pin', 'expand')"), False).withColumn("opens", F.lit(True))
    t = t.join(opened, "id", "left").withColumns({"opens": F.coalesce("opens", F.lit(False)), "is_cold": F.coalesce("is_cold", F.lit(False))})
    kind, leaf = F.col("override"), F.col("is_leaf")
    reason = (
        F.when(kind == "pin", "pin")
        .when(kind == "expand", F.when(F.col("is_cold"), "cold").when(leaf, "leaf"))
        .when(kind == "collapse", F.when(leaf | ~F.col("opens"), "collapse"))
        .when(leaf, F.when(F.col("is_cold") & (F.col("depth") < level), "cold").otherwise("leaf"))
        .when((F.col("depth") >= level) & ~F.col("opens"), F.when(F.col("depth") == level, "level").otherwise("expand-parent"))
    )
    stops = t.withColumn("reason", reason).where("reason is not null")
    above = stops.select(F.col("id").alias("on"))
    shadowed = stops.select("id", F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("on")).join(above, "on", "left_semi").select("id").distinct()
    return stops.join(shadowed, "id", "left_anti").select("id", "graph_id", "depth", "reason", F.col("leaves").alias("covered_leaves"))


def frontier(tree: DataFrame, cut: DataFrame, protected: DataFrame | None = None, cold: DataFrame | None = None) -> DataFrame:
    """id, action of members: expand (what has an inside, loaded or not), hydrate (its inside is cold) and collapse (all children of its
    parent are members, and none of them is or holds a protected node)."""
    members = tree.join(cut.select("id"), "id", "left_semi")
    is_cold = tree.select("id").limit(0) if cold is None else members.join(cold.select(F.col("graph_id").alias("detail_graph")), "detail_graph", "left_semi").select("id")
    expand = members.where("not is_leaf").select("id").union(is_cold).distinct()
    held = members.select("id", "parent").where("parent is not null")
    inside = held.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    free = tree.join(inside, "id").where("n = children").select(F.col("id").alias("parent"))
    if protected is not None:
        kept = _on_the_way(tree, protected, True)
        free = free.join(tree.join(kept, "id", "left_semi").select("parent"), "parent", "left_anti")
    collapse = held.join(free, "parent", "left_semi").select("id")
    parts = [df.select("id", F.lit(action).alias("action")) for df, action in ((expand, "expand"), (is_cold, "hydrate"), (collapse, "collapse"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def salience(measures: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """id, salience of the candidates (id, size, degree, recency; recency may be null): each signal scaled to 0..1 over them, null
    recency 0; if no candidate has a recency, the other weights are scaled up. A signal that doesn't vary counts 0."""
    bounds = measures.agg(*[f(c).alias(f"{n}_{c}") for c in ("size", "degree", "recency") for n, f in (("lo", F.min), ("hi", F.max))])
    m = measures.join(F.broadcast(bounds))  # one row
    scaled = lambda c: F.when(F.col(f"hi_{c}") <= F.col(f"lo_{c}"), 0.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    recent = F.when(F.col("hi_recency").isNull(), 0.0).otherwise(weights[2])
    total = sum(F.lit(w) * scaled(c) for w, c in zip(weights, ("size", "degree"), strict=False)) + recent * F.coalesce(scaled("recency"), F.lit(0.0))
    return m.select("id", (total / (weights[0] + weights[1] + recent)).alias("salience"))


def level_for_zoom(zoom: float, steps: list[float], before: int | None = None, band: float = HYSTERESIS) -> tuple[int, int]:
    """The level of a zoom after the level before it, and the level without it: see zoom_levels."""
    nominal = sum(zoom >= t for t in steps)
    if before is None:
        return nominal, nominal
    before = max(0, min(before, len(steps)))
    if abs(nominal - before) > 1:
        return nominal, nominal
    if before < len(steps) and zoom >= steps[before] + band / 2:
        return before + 1, nominal
    if before > 0 and zoom < steps[before - 1] - band / 2:
        return before - 1, nominal
    return before, nominal


def zoom_levels(requests: DataFrame, steps: list[float], band: float = HYSTERESIS) -> DataFrame:
    """session, seq, zoom, level: each session's requests in order. A level changes by more than one at once; else only when the
    zoom is beyond half the band from the threshold. State is one number, so a session streams through."""
    steps_ = list(steps)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, level = None, None
        for batch in batches:
            out = []
            for s, z in zip(batch["session"], batch["zoom"], strict=True):
                nominal = sum(z >= t for t in steps_)
                if s != session or level is None or abs(nominal - level) > 1:
                    level = nominal
                elif nominal > level and z >= steps_[level] + band / 2:
                    level += 1
                elif nominal < level and z < steps_[level - 1] - band / 2:
                    level -= 1
                session = s
                out.append(level)
            yield batch.assign(level=out)

    ordered = requests.select("session", "seq", "zoom").repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInPandas(run, "session string, seq long, zoom double, level long")


def budget_cut(tree: DataFrame, cut: DataFrame, scores: DataFrame, max_nodes: int, protected: DataFrame | None = None) -> DataFrame:
    """id, depth, reason of a cut of at most max_nodes members where that can be had: parents all of whose children are members are
    collapsed, the one whose least salient child has the least salience first (ties by id), until the cut is small enough. Children
    that are protected (id), or hold such a node, stay.

    A parent's turn comes when its own key and those of all parents below it have come up, so turns are in the order of the
    greatest key among them, deeper ones first. Keys are found level by level from below; the turns are then ordered by ranges,
    and taken until enough members are gone. Nothing is put into one group.
    """
    spark = tree.sparkSession
    members = written(tree.join(cut.select("id"), "id", "left_semi").select("id", "parent", "depth"), "budget-members")
    total, deepest = members.agg(F.count("*"), F.max("depth")).first()
    kept = members.withColumn("reason", F.lit("kept"))
    if total <= max_nodes:
        return kept.select("id", "depth", "reason")
    safe = written(_on_the_way(tree, protected, True), "budget-protected") if protected is not None else spark.createDataFrame([], "id string")
    rated = written(scores.select("id", F.coalesce("salience", F.lit(0.0)).alias("salience")), "budget-scores")
    lock = "lock struct<salience: double, id: string>"
    turns = Levels(spark, "budget-turns")
    below = turns.add(spark.createDataFrame([], f"id string, parent string, depth long, {lock}, gain long"))
    for depth in range(deepest, 0, -1):
        here = members.where(F.col("depth") == depth).select("id", "parent", F.lit(None).cast(lock.split(" ", 1)[1]).alias("lock"))
        here = here.unionByName(below.select("id", "parent", "lock")).where("parent is not null")
        here = here.join(rated, "id", "left").join(safe.withColumn("safe", F.lit(True)), "id", "left")
        inside = here.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.count("safe").alias("held"), F.min(F.coalesce("salience", F.lit(0.0))).alias("least"), F.max("lock").alias("after"))
        ready = tree.where(F.col("depth") == depth - 1).select("id", "parent", "depth", "children").join(inside, "id").where("n = children and held = 0")
        own = F.struct(F.col("least").alias("salience"), "id")
        below = turns.add(ready.select("id", "parent", "depth", F.when(F.col("after") > own, F.col("after")).otherwise(own).alias("lock"), (F.col("children") - 1).alias("gain")))
    order = ["lock.salience", "lock.id", F.desc("depth")]
    parts = turns.all().repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = written(parts, "budget-parts")
    sums = parts.groupBy("_part").agg(F.sum("gain").alias("_gain"))
    before = F.coalesce(F.sum("_gain").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    starts = sums.withColumn("_before", before).where(F.col("_before") < total - max_nodes)
    within = F.coalesce(F.sum("gain").over(Window.partitionBy("_part").orderBy("lock.salience", "lock.id", F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = parts.join(F.broadcast(starts), "_part").withColumn("_so_far", F.col("_before") + within).where(F.col("_so_far") < total - max_nodes)
    taken = written(taken.select("id", "parent", "depth"), "budget-taken")
    left = kept.unionByName(taken.withColumn("reason", F.lit("budget")))
    return left.join(taken.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "depth", "reason")


def refinement(tree: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change (move, exit or enter), link: what a member of one cut becomes in another. A member of both moves; one that goes
    is linked to its ancestor in the new cut, or else to its first descendant there; one that comes, likewise to the old cut."""
    a, b = before.select("id").withColumn("old", F.lit(True)), after.select("id").withColumn("new", F.lit(True))
    both = a.join(b, "id", "full").withColumn("change", F.when(F.col("old") & F.col("new"), "move").when(F.col("old"), "exit").otherwise("enter"))
    paths = tree.select("id", "path")
    out = both.where("change = 'move'").select("id", "change", F.col("id").alias("link"))
    for change, other in (("exit", after), ("enter", before)):
        mine = both.where(F.col("change") == change).select("id", "change").join(paths, "id")
        targets = other.select(F.col("id").alias("on")).join(tree.select(F.col("id").alias("on"), "depth", F.col("path").alias("on_path")), "on")
        up = mine.select("id", F.explode("path").alias("on")).join(targets, "on").groupBy("id").agg(F.max_by("on", "depth").alias("up"))
        down = targets.select("on", F.explode("on_path").alias("id")).join(mine.select("id"), "id", "left_semi").groupBy("id").agg(F.min("on").alias("down"))
        out = out.unionByName(mine.join(up, "id", "left").join(down, "id", "left").select("id", "change", F.coalesce("up", "down").alias("link")))
    return out


def affected(before: DataFrame, after: DataFrame, recomputed: DataFrame | None = None) -> DataFrame:
    """id, change (added, removed or retained) and affected of the members of two cuts: whether a retained one is among those whose edges
    were computed anew (recomputed: id)."""
    a, b = before.select("id").distinct().withColumn("old", F.lit(True)), after.select("id").distinct().withColumn("new", F.lit(True))
    both = a.join(b, "id", "full").withColumn("change", F.when(F.col("old") & F.col("new"), "retained").when(F.col("old"), "removed").otherwise("added"))
    again = a.select("id").limit(0) if recomputed is None else recomputed.select("id").distinct()
    both = both.join(again.withColumn("again", F.lit(True)), "id", "left")
    return both.select("id", "change", ((F.col("change") == "retained") & F.coalesce("again", F.lit(False))).alias("affected"))


def compound_groups(tree: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, group of a cut's members: the graph that each lies in; and group, parent of these graphs and all above them (a root graph has no
    row)."""
    on_the_way = tree.join(_on_the_way(tree, cut, True), "id", "left_semi").select("graph_id", "parent").where("parent is not null").distinct()
    holders = tree.select(F.col("id").alias("parent"), F.col("graph_id").alias("above"))
    nesting = on_the_way.join(holders, "parent").select(F.col("graph_id").alias("group"), F.col("above").alias("parent")).distinct()
    return cut.select("id", F.col("graph_id").alias("group")), nesting


def ranked(df: DataFrame, by: list, most: int, within: list[str]) -> DataFrame:
    """The first rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("rank") <= most)
