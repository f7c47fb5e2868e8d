"""Layouts of cuts: trees, packed components, and what changed between two layouts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_layout(members: DataFrame, spacing: float = 40.0) -> DataFrame:
    """graph_id, id, x, y of trees (graph_id, id, parent): leaves stand side by side in the order of ids, parents above the middle
    of theirs. A tree is laid out as one; different graphs are independent."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = set(rows["id"])
        inside: dict[str | None, list[str]] = {}
        for i, p in sorted(zip(rows["id"], rows["parent"], strict=True)):
            inside.setdefault(p if p in ids else None, []).append(i)
        x: dict[str, float] = {}
        depth: dict[str, int] = {}
        place = 0.0
        work = [(i, 0, False) for i in reversed(inside.get(None, []))]
        while work:
            node, level, done = work.pop()
            below = inside.get(node, [])
            if not below:
                x[node], depth[node] = place, level
                place += spacing
            elif done:
                x[node], depth[node] = (x[below[0]] + x[below[-1]]) / 2, level
            else:
                work.append((node, level, True))
                work += [(i, level + 1, False) for i in reversed(below)]
        graph = rows["graph_id"].iloc[0]
        return pd.DataFrame([(graph, i, x[i], depth[i] * spacing) for i in sorted(x)], columns=["graph_id", "id", "x", "y"])

    return members.select("graph_id", "id", "parent").groupBy("graph_id").applyInPandas(run, "graph_id string, id string, x double, y double")


def bounds(boxes: DataFrame) -> DataFrame:
    """x1, y1, x2, y2 over all boxes (x, y, w, h)."""
    return boxes.agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))


def packed(components: DataFrame, spacing: float = 40.0) -> DataFrame:
    """component, x, y: components (component, w, h) on shelves, the tallest first, about as wide as all of them together are high.

    What is packed is one row for each component of a cut, so one task does it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "component"], ascending=[False, True])
        wide = max(float((rows["w"] * rows["h"]).sum()) ** 0.5 * 1.3, float(rows["w"].max()))
        out, x, y, shelf = [], 0.0, 0.0, 0.0
        for r in rows.itertuples():
            if x and x + r.w > wide:
                x, y, shelf = 0.0, y + shelf + spacing, 0.0
            out.append((r.component, x, y))
            x, shelf = x + r.w + spacing, max(shelf, r.h)
        return pd.DataFrame(out, columns=["component", "x", "y"])

    return components.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "component string, x double, y double")


def layout_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, change (added, removed or moved) between two layouts (id, x, y)."""
    both = before.alias("a").join(after.alias("b"), F.col("a.id") == F.col("b.id"), "full")
    change = F.when(F.col("a.id").isNull(), "added").when(F.col("b.id").isNull(), "removed").when(~(F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.y").eqNullSafe(F.col("b.y"))), "moved")
    return both.select(F.coalesce("a.id", "b.id").alias("id"), change.alias("change")).where("change is not null")
