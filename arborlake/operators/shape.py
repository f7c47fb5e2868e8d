"""The shape of graphs: components, hubs, triangles; and groups of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import unit
from ..plans.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """id, component of every node at an edge (src, dst): the least id that is reachable, in either direction.

    In each round a node goes to its least neighbour in an order that a hash of the round gives, and edges follow; a constant
    share of the nodes goes each round, whatever the graph looks like.
    """
    edges = written(edges.select("src", "dst").where("src <> dst").distinct(), "component-edges")
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    label, turn = written(ends(edges).withColumn("root", F.col("id")), "component-labels"), 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        step = written(both.groupBy("src").agg(F.min(order("dst")).alias("m")).select("src", F.least("m", order("src"))["id"].alias("to")), "component-step")
        label = written(label.join(step.select(F.col("src").alias("root"), "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "component-labels")
        moved = edges.join(step, "src").select(F.col("to").alias("a"), "dst").join(step.select(F.col("src").alias("dst"), F.col("to").alias("b")), "dst")
        edges = written(moved.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst").distinct(), "component-edges")
        turn += 1
    least = label.groupBy("root").agg(F.min("id").alias("component"))
    return label.join(least, "root").select("id", "component")


def _neighbors(edges: DataFrame) -> DataFrame:
    """id, other: each pair of distinct neighbours in both directions, once."""
    pairs = edges.select("src", "dst").where("src <> dst")
    return pairs.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(pairs.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()


def hub_satellites(edges: DataFrame) -> DataFrame:
    """hub, satellite: nodes with one neighbour, where that has two or more."""
    near = _neighbors(edges)
    degree = near.groupBy("id").agg(F.count("*").alias("degree"), F.min("other").alias("hub"))
    ones = degree.where("degree = 1").select(F.col("id").alias("satellite"), "hub")
    return ones.join(degree.where("degree >= 2").select(F.col("id").alias("hub")), "hub").select("hub", "satellite")


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """coefficient: the mean over nodes with two or more neighbours of how many pairs of neighbours are neighbours themselves.

    Triangles are found from their least end in order of degree, so a hub's pairs are never listed.
    """
    near = _neighbors(edges)
    degree = near.groupBy("id").agg(F.count("*").alias("degree"))
    rank = degree.select("id", F.struct("degree", "id").alias("r"))
    up = near.join(rank, "id").join(rank.select(F.col("id").alias("other"), F.col("r").alias("q")), "other").where("r < q").select("id", "other")
    up = written(up, "oriented")
    wedge = up.select(F.col("id").alias("a"), F.col("other").alias("b")).join(up.select(F.col("id").alias("a"), F.col("other").alias("c")), "a").where("b <> c")
    triangles = wedge.join(up.select(F.col("id").alias("b"), F.col("other").alias("c")), ["b", "c"])
    corners = triangles.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    share = degree.where("degree >= 2").join(corners, "id", "left").select((2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("c"))
    return share.agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("coefficient"))


def default_k(n: int) -> int:
    return max(1, min(n, math.floor(math.sqrt(n / 2) + 0.5)))


def _to_centers(v: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centre (ties: the first)."""
    d = np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ centers.T + (centers * centers).sum(axis=1), 0).round(12)
    k = d.argmin(axis=1)
    return k, d[np.arange(len(v)), k]


def kmeans(vectors: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """id, cluster, distance2 of vectors (id, v), scaled to unit length. Starts are spread farthest first from the least id; then
    Lloyd's rounds until the centres stand still. Ties go to the first; a centre without vectors stays.

    Distances are matrix products in the tasks; each task sums its own vectors, and only the k centres come to the driver.
    """
    points = written(vectors.select("id", unit(F.col("v").cast("array<double>")).alias("v")), "points")
    first = points.orderBy("id").limit(1).collect()
    if not first:
        return points.select("id", F.lit(0).cast("long").alias("cluster"), F.lit(0.0).alias("distance2"))

    def assigned(centers: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                c, d = _to_centers(np.stack(batch["v"]), centers) if len(batch) else ([], [])
                yield pd.DataFrame({"id": batch["id"], "cluster": c, "distance2": d})

        return points.mapInPandas(run, f"id {dict(points.dtypes)['id']}, cluster long, distance2 double")

    def sums(centers: np.ndarray) -> dict[int, np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(centers), centers.shape[1] + 1))
            for batch in batches:
                if len(batch):
                    v = np.stack(batch["v"])
                    hot = np.zeros((len(v), len(centers)))
                    hot[np.arange(len(v)), _to_centers(v, centers)[0]] = 1
                    total += hot.T @ np.hstack([v, np.ones((len(v), 1))])
            yield pd.DataFrame([(j, i, x) for j, row in enumerate(total) for i, x in enumerate(row)], columns=["k", "i", "x"])

        out = np.zeros((len(centers), centers.shape[1] + 1))
        for r in points.mapInPandas(run, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():
            out[r["k"], r["i"]] = r["x"]
        return {j: row[:-1] / row[-1] for j, row in enumerate(out) if row[-1]}

    centers = np.array([first[0]["v"]])
    while len(centers) < k:
        far = assigned(centers).orderBy(F.desc("distance2"), "id").limit(1).collect()[0]
        if far["distance2"] <= 0:
            break
        centers = np.vstack([centers, points.where(F.col("id") == far["id"]).first()["v"]])
    for _ in range(rounds):
        found = sums(centers)
        now = np.array([found.get(j, c) for j, c in enumerate(centers)])
        still = np.abs(now - centers).max() < 1e-12
        centers = now
        if still:
            break
    return assigned(centers)


def cohesion(assigned: DataFrame) -> DataFrame:
    """cluster, n, cohesion: 1 less the mean squared distance, within 0..1."""
    value = F.least(F.greatest(1 - F.avg("distance2"), F.lit(0.0)), F.lit(1.0))
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), value.alias("cohesion"))


def agreement(pairs: DataFrame) -> DataFrame:
    """purity, ari of two groupings (cluster, truth): share of the most frequent truths, and the adjusted Rand index."""
    cells = pairs.groupBy("cluster", "truth").agg(F.count("*").cast("double").alias("n"))
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows = cells.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("top")).agg(F.sum(choose("n")).alias("a"), F.sum("n").alias("all"), F.sum("top").alias("top"))
    cols = cells.groupBy("truth").agg(F.sum("n").alias("n")).agg(F.sum(choose("n")).alias("b"))
    both = cells.agg(F.sum(choose("n")).alias("s"))
    joined = rows.join(F.broadcast(cols)).join(F.broadcast(both))  # one row each
    expected = F.col("a") * F.col("b") / choose("all")
    spread = (F.col("a") + F.col("b")) / 2 - expected
    return joined.select((F.col("top") / F.col("all")).alias("purity"), F.when(spread == 0, 1.0).otherwise((F.col("s") - expected) / spread).alias("ari"))
