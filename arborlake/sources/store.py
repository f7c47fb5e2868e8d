"""A versioned store: checkpoints as Parquet, an operation log beside them, and a pointer that says which checkpoint holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGES, GRAPHS, NODES, Space
from ..operators import delta

#: Nodes and edges of a checkpoint lie in so many folders, by a hash of their graph, and in so many files in each.
BUCKETS, FILES = 16, 4
LOG = "counter long, site string, phase int, t string, graph_id string, id string, key string, prev string, next string"


class Store:
    """Paths under one root of any file system that Spark reads: v=N/{graphs,nodes,edges}, log/, and CURRENT/N.

    A checkpoint is written whole and then published by creating its (empty) pointer file, which fails if it is there already.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        fs, p = self._fs(f"{self.root}/CURRENT")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=-1) if fs.exists(p) else -1

    def checkpoint(self, space: Space, version: int | None = None) -> int:
        version = self.version() + 1 if version is None else version
        from ..operators.forest import derived_roots

        # What a checkpoint reads may be the one before it, so roots come from the tables as they are written.
        for name, df in (("graphs", space.graphs), ("nodes", space.nodes), ("edges", space.edges)):
            if name != "graphs":
                df = df.withColumn("bucket", bucket(F.col("graph_id"))).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(FILES)))
            writer = df.write.mode("overwrite")
            (writer if name == "graphs" else writer.partitionBy("bucket")).parquet(f"{self.root}/v={version}/{name}")
        derived_roots(self._at(version)).write.mode("overwrite").parquet(f"{self.root}/v={version}/roots")
        fs, p = self._fs(f"{self.root}/CURRENT/{version}")
        if not fs.createNewFile(p):
            raise FileExistsError(f"version {version} was published by another writer")
        return version

    def append(self, ops: DataFrame, counter: int, site: str = "local") -> None:
        """One delta: refused if its number isn't the one after the last."""
        last = self.last_counter()
        if counter != last + 1:
            raise ValueError(f"stale delta: {counter} after {last}")
        ops.select(F.lit(counter).cast("long").alias("counter"), F.lit(site).alias("site"), F.col("phase").cast("int").alias("phase"), "t", "graph_id", "id", "key", "prev", "next").write.mode("errorifexists").parquet(f"{self.root}/log/{counter:012d}")

    def last_counter(self) -> int:
        """The checkpoint holds all deltas up to its own number, so versions and deltas are counted alike."""
        fs, p = self._fs(f"{self.root}/log")
        return max([self.version(), *(int(s.getPath().getName()) for s in fs.listStatus(p))]) if fs.exists(p) else self.version()

    def open(self) -> Space:
        """The last checkpoint with the deltas after it, which are folded into one set of operations first."""
        space, after = self._at(self.version()), self._after()
        return space if after is None else delta.apply(space, delta.net(after))

    def _at(self, version: int, keep: Column | None = None) -> Space:
        """A checkpoint, or of its nodes and edges those to keep."""
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.root}/v={version}/{name}")
        nodes, edges = (df if keep is None else df.where(keep) for df in (read("nodes", NODES + ", bucket int"), read("edges", EDGES + ", bucket int")))
        return Space(read("graphs", GRAPHS), nodes.drop("bucket"), edges.drop("bucket"))

    def _after(self) -> DataFrame | None:
        """The log after the last checkpoint."""
        after = [f"{self.root}/log/{counter:012d}" for counter in range(self.version() + 1, self.last_counter() + 1)]
        return self.spark.read.schema(LOG).parquet(*after) if after else None

    def compact(self) -> int:
        """A checkpoint of what open() gives."""
        return self.checkpoint(self.open(), self.last_counter())

    def graph(self, graph_id: str) -> Space:
        """One graph with its nodes and edges. Only its bucket of the checkpoint is read, and of the log what is said of it."""
        one = F.col("graph_id") == graph_id
        space = self._at(self.version(), (F.col("bucket") == bucket_of(self.spark, graph_id)) & one)
        space = space.with_(graphs=space.graphs.where(F.col("id") == graph_id))
        after = self._after()
        return space if after is None else delta.apply(space, delta.net(after.where(one)))

    def spine(self) -> tuple[Space, DataFrame]:
        """The root graphs with all that is in them, and all other graphs without (as shells); and the ids of the shells (graph_id).

        Where the log has more than the checkpoint, it is folded in first; else only the buckets of the roots are read, if these are at
        most as many as there are buckets.
        """
        after = self._after()
        if after is None:
            roots = self.spark.read.parquet(f"{self.root}/v={self.version()}/roots")
            some = roots.select(bucket(F.col("id")).alias("bucket")).distinct()
            space = self._at(self.version(), F.col("bucket").isin([r["bucket"] for r in some.collect()]))  # at most BUCKETS
        else:
            from ..operators.forest import derived_roots

            space = self.open()
            roots = derived_roots(space)
        inside = roots.select(F.col("id").alias("graph_id"))
        shells = space.graphs.select(F.col("id").alias("graph_id")).join(inside, "graph_id", "left_anti")
        keep = lambda df: df.join(inside, "graph_id", "left_semi").select(df.columns)
        return space.with_(nodes=keep(space.nodes), edges=keep(space.edges)), shells


def bucket(graph_id: Column) -> Column:
    return F.pmod(F.xxhash64(graph_id), F.lit(BUCKETS)).cast("int")


def bucket_of(spark: SparkSession, graph_id: str) -> int:
    return spark.range(1).select(bucket(F.lit(graph_id)).alias("b")).first()["b"]


def salvaged(space: Space) -> Space:
    """A sound part of a damaged space: nodes of known graphs, edges between their nodes, and one holder for each detail graph.

    Of rows that claim one id the first stays, by graph and then by the row's text.
    """
    nodes = space.nodes.join(space.graphs.select(F.col("id").alias("graph_id")), "graph_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in space.nodes.columns])
    nodes = nodes.groupBy("id").agg(F.min_by(row, F.struct("graph_id", F.to_json(row))).alias("row")).select("row.*")
    holder = nodes.where("detail_graph is not null").groupBy("detail_graph").agg(F.min(F.struct("graph_id", "id")).alias("h"))
    known = space.graphs.select(F.col("id").alias("detail_graph"), F.lit(True).alias("known"))
    nodes = nodes.join(holder, "detail_graph", "left").join(known, "detail_graph", "left")
    keep = F.col("known") & (F.col("h.id") == F.col("id"))
    nodes = nodes.withColumn("detail_graph", F.when(keep, F.col("detail_graph"))).select(space.nodes.columns)
    edges = space.edges
    for c in ("src", "dst"):
        edges = edges.join(nodes.select("graph_id", F.col("id").alias(c)), ["graph_id", c], "left_semi")
    return space.with_(nodes=nodes, edges=edges.select(space.edges.columns))
