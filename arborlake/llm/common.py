"""What the operators share: reading tables, shared scratch tables and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


BATCH_ROWS, TEXTS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under sf_dir, by Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a new local one only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="arborlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/arborlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs; texts go to Python TEXTS_PER_BATCH at a time, unless the session says otherwise: some may be very long."""
    spark = docs.sparkSession
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default
        spark.conf.set(BATCH_ROWS, str(TEXTS_PER_BATCH))
    return docs


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for place in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key, from the batches of a partition sorted by keys; what is held is one key's rows and one batch."""
    held, key = [], None
    for batch in batches:
        if not len(batch):
            continue
        changed = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
        for a, b in zip(changed, [*changed[1:], len(batch)], strict=True):
            part = batch.iloc[a:b]
            now = tuple(part[k].iloc[0] for k in keys)
            if held and now != key:
                yield key, held[0] if len(held) == 1 else pd.concat(held)
                held = []
            key = now
            held.append(part)
    if held:
        yield key, held[0] if len(held) == 1 else pd.concat(held)


def summed_arrays(df: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], np.ndarray | None], blocks: int = 64) -> np.ndarray | None:
    """The sum of the flat arrays that partial returns for each task (None: nothing), which all have one fixed length.

    Arrays are cut into blocks and summed in a shuffle, so no task and no driver holds more than one array and one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = partial(batches)
        if found is not None:
            yield pd.DataFrame({"block": np.arange(blocks), "part": TaskContext.get().partitionId(), "x": np.array_split(found.astype(np.float32), blocks)})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch["block"], batch["x"], strict=True):
                sums[block] = sums.get(block, 0.0) + x.astype(np.float64)
        yield pd.DataFrame(list(sums.items()), columns=["block", "x"])

    parts = df.mapInPandas(run, "block int, part int, x array<float>")
    summed = parts.repartition("block").sortWithinPartitions("block", "part").mapInPandas(total, "block int, x array<double>")
    found = {r["block"]: r["x"] for r in summed.collect()}
    return np.concatenate([found[b] for b in range(blocks)]) if found else None


def words(text):
    """Column of the words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
