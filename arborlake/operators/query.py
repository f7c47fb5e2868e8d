"""Node queries, label search and inspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..model import Space


class NodeQuery:
    """Constraints that all hold; each is a filter or a semi-join, so Catalyst pushes them into the scan of the nodes."""

    def __init__(self, space: Space, found: DataFrame | None = None) -> None:
        self.space, self.found = space, space.nodes if found is None else found

    def _with(self, found: DataFrame) -> NodeQuery:
        return NodeQuery(self.space, found)

    def within(self, graph: str) -> NodeQuery:
        return self._with(self.found.where(F.col("graph_id") == graph))

    def by_kind(self, kind: str) -> NodeQuery:
        return self._with(self.found.where(F.col("kind") == kind))

    def text(self, words: str) -> NodeQuery:
        """Each word of the question must be a word of the label; no word is no constraint."""
        asked = tokens(F.lit(words))
        return self._with(self.found.where(F.size(F.array_except(asked, tokens(F.col("label")))) == 0))

    def from_origin(self, origin: str) -> NodeQuery:
        return self._with(self.found.where(F.col("origin") == origin))

    def neighbors_of(self, node: str, direction: str = "both", kind: str | None = None) -> NodeQuery:
        edges = self.space.edges if kind is None else self.space.edges.where(F.col("kind") == kind)
        sides = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
        near = reduce(DataFrame.unionByName, [edges.where(F.col(a) == node).select(F.col(b).alias("id")) for a, b in sides])
        return self._with(self.found.join(near, "id", "left_semi"))

    def nodes(self) -> DataFrame:
        return self.found

    def ids(self) -> DataFrame:
        return self.found.select("id").orderBy("id")


def posting_index(nodes: DataFrame) -> DataFrame:
    """token, id: what a materialised search table holds."""
    return nodes.select(F.explode(tokens(F.col("label"))).alias("token"), "id")


def updated_postings(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The index after nodes were removed (id) and added."""
    return index.join(removed.select("id"), "id", "left_anti").select("token", "id").unionByName(posting_index(added))


def search_labels(nodes: DataFrame, words: str) -> DataFrame:
    """id, label, score of the nodes whose label has all words; none for an empty question."""
    asked = tokens(F.lit(words))
    hit = nodes.where((F.size(asked) > 0) & (F.size(F.array_except(asked, tokens(F.col("label")))) == 0))
    return hit.select("id", "label", F.size(asked).cast("long").alias("score"))


def inspect(space: Space, node: str) -> DataFrame:
    """direction, edge, kind, other, other_label of the edges at a node."""
    labels = space.nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    out = None
    for direction, here, there in (("out", "src", "dst"), ("in", "dst", "src")):
        part = space.edges.where(F.col(here) == node).select(F.lit(direction).alias("direction"), F.col("id").alias("edge"), "kind", F.col(there).alias("other"))
        out = part if out is None else out.unionByName(part)
    return out.join(labels, "other", "left").select("direction", "edge", "kind", "other", "other_label")


def without_nodes(space: Space, hidden: DataFrame) -> Space:
    """The space without some nodes (id) and the edges at them."""
    nodes = space.nodes.join(hidden.select("id"), "id", "left_anti").select(space.nodes.columns)
    edges = space.edges
    for c in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(c)), c, "left_semi")
    return space.with_(nodes=nodes, edges=edges.select(space.edges.columns))


def stats(space: Space) -> DataFrame:
    """what, kind, n: numbers of graphs, nodes and edges, in all and by kind, and of stated (else derived) roots."""
    from .forest import derived_roots

    roots = derived_roots(space) if space.roots is None else space.roots
    out = roots.agg(F.count("*").alias("n")).select(F.lit("roots").alias("what"), F.lit("").alias("kind"), "n")
    out = out.unionByName(space.graphs.agg(F.count("*").alias("n")).select(F.lit("graphs").alias("what"), F.lit("").alias("kind"), "n"))
    for what, df in (("nodes", space.nodes), ("edges", space.edges)):
        out = out.unionByName(df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n"))
    return out


def provenance_tally(space: Space) -> DataFrame:
    """origin, n over graphs, nodes and edges; summed before the union's shuffle."""
    parts = [df.groupBy("origin").agg(F.count("*").alias("n")) for df in (space.graphs, space.nodes, space.edges)]
    return reduce(DataFrame.unionByName, parts).groupBy("origin").agg(F.sum("n").alias("n"))


def manifest(space: Space) -> DataFrame:
    """graph_id, nodes, edges of each graph."""
    n = space.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    e = space.edges.groupBy("graph_id").agg(F.count("*").alias("edges"))
    g = space.graphs.select(F.col("id").alias("graph_id"))
    return g.join(n, "graph_id", "left").join(e, "graph_id", "left").na.fill(0, ["nodes", "edges"])
