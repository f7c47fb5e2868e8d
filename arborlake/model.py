"""The data model: a space of property graphs, held as three tables.

A node may refer to a detail graph; these references make a forest. Attributes are a map from namespaced keys to canonical JSON
texts, so that they can be compared, grouped and diffed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPHS = "id string, label string, domain string, origin string"
NODES = "graph_id string, id string, kind string, label string, detail_graph string, attrs map<string,string>, origin string"
EDGES = "graph_id string, id string, src string, dst string, kind string, weight double, attrs map<string,string>, origin string"


@dataclass(frozen=True)
class Space:
    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    #: Stated roots (id), or None: then they are derived.
    roots: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Space:
        return replace(self, **tables)

    @staticmethod
    def of(spark: SparkSession, graphs: list, nodes: list, edges: list) -> Space:
        """A small space from rows: graphs (id, label), nodes (graph, id, kind, label, detail), edges (graph, id, src, dst, kind, weight)."""
        none = F.lit(None).cast("map<string,string>")
        g = spark.createDataFrame(graphs, "id string, label string").withColumns({"domain": F.lit("core"), "origin": F.lit("source")})
        n = spark.createDataFrame(nodes, "graph_id string, id string, kind string, label string, detail_graph string").withColumns({"attrs": none, "origin": F.lit("source")})
        e = spark.createDataFrame(edges, "graph_id string, id string, src string, dst string, kind string, weight double").withColumns({"attrs": none, "origin": F.lit("source")})
        return Space(g, n, e)
