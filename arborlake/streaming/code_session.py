"""A project that is watched: a stream of changed files in, the operations that each batch of changes means out.

For each file, keyed state holds the greatest version seen and the digest of its text, so what is late or changes nothing goes no
further. Only files that changed are parsed; their facts go into a log. A batch's operations are the difference, places left out,
between the project's document before and after it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import EDGES, GRAPHS, NODES, Space
from ..sources import code

CHANGES = "path string, version long, text string"
OPERATIONS = "phase int, t string, graph_id string, id string, key string, prev string, next string"


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The file's newest change, if it is newer than what was seen and its text differs from that."""
    version, digest = state.get if state.exists else (None, None)
    text, newer = None, False
    for batch in batches:
        for v, t in zip(batch["version"], batch["text"], strict=True):
            if v is not None and not pd.isna(v) and (version is None or v > version):
                version, text, newer = int(v), t, True
    if newer:
        now = "" if text is None else hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        state.update((version, now))
        if now != (digest or ""):
            yield pd.DataFrame({"path": [key[0]], "version": [version], "text": [text]})


def changed_files(changes: DataFrame) -> DataFrame:
    """The stream of changes (path, version, text; a null text: the file is gone) without what is late or changes nothing.

    Versions of one file grow; the order in which changes arrive doesn't matter, nor does one that comes twice (of equal versions in one
    batch, the first that is read counts). Changes without path or version are left out.
    """
    given = changes.where("path is not null and version is not null").select("path", "version", "text")
    return given.groupBy("path").applyInPandasWithState(_newest, CHANGES, "version long, digest string", "append", GroupStateTimeout.NoTimeout)


class Session:
    """The tables of a watched project under a root that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, project: str = "project") -> None:
        self.spark, self.root, self.project = spark, root.rstrip("/"), project

    def _batches(self, what: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = (s.getPath() for s in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return sorted(int(p.getName().partition("=")[2]) for p in done)

    def facts(self, batch: int) -> DataFrame:
        """Facts of the files that are there after a batch: the last that the log has of each."""
        paths = [f"{self.root}/facts/batch={b}" for b in self._batches("facts") if b <= batch]
        log = self.spark.read.option("basePath", f"{self.root}/facts").schema(f"path string, gone boolean, {code.FACTS}, batch int").parquet(*paths)
        last = log.groupBy("path").agg(F.max_by(F.struct("gone", "length", "decls", "imports", "calls"), "batch").alias("f"))
        return last.where("not f.gone").select("path", "f.length", "f.decls", "f.imports", "f.calls")

    def document(self, batch: int | None = None) -> Space:
        """The document after a batch (None: the last); without any, an empty one."""
        done = [b for b in self._batches("edges") if batch is None or b <= batch]
        if not done:
            return Space(*[self.spark.createDataFrame([], s) for s in (GRAPHS, NODES, EDGES)])
        tables = zip(("graphs", "nodes", "edges"), (GRAPHS, NODES, EDGES), strict=True)
        return Space(*[self.spark.read.schema(s).parquet(f"{self.root}/{what}/batch={done[-1]}") for what, s in tables])

    def operations(self, batch: int) -> DataFrame:
        return self.spark.read.schema(OPERATIONS).parquet(f"{self.root}/operations/batch={batch}")

    def published(self) -> list[int]:
        """Batches whose operations are out; one that changed nothing has none."""
        return self._batches("operations")

    def take(self, changed: DataFrame, batch: int) -> None:
        """One batch of changed files. A batch that is run again writes over what it wrote, so it counts once.

        Documents older than the last two are removed; the operations of all batches stay.
        """
        changed = changed.persist()
        try:
            if changed.isEmpty():
                return
            read = code.modules(changed.where("text is not null")).withColumn("gone", F.lit(False))
            gone = changed.where("text is null").select("path", F.lit(True).alias("gone"))
            read.unionByName(gone, allowMissingColumns=True).select("path", "gone", "length", "decls", "imports", "calls").write.mode("overwrite").parquet(f"{self.root}/facts/batch={batch}")
        finally:
            changed.unpersist()
        before, after = self.document(batch - 1), code.code_document(self.facts(batch), self.project)
        ops = code.diff_modulo_spans(before, after).select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in OPERATIONS.split(", "))])
        ops.write.mode("overwrite").parquet(f"{self.root}/operations/batch={batch}")
        for what, df in (("graphs", after.graphs), ("nodes", after.nodes), ("edges", after.edges)):
            df.write.mode("overwrite").parquet(f"{self.root}/{what}/batch={batch}")
        for old in [b for b in self._batches("edges") if b <= batch][:-2]:
            for what in ("edges", "nodes", "graphs"):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{what}/batch={old}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def watch(self, changes: DataFrame, **trigger):
        """Starts the stream of changes; its place is kept under the root, so it goes on where it stopped."""
        return changed_files(changes).writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**trigger).start()
