"""Streams of operations: staged batches that are published only when all went well, and a change feed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import LOG, Store

ACCEPTED = "site string, counter long, expected long, accepted boolean"


def read_log(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The operation log as a stream; batches are bounded by files, which is the back-pressure."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)


def stage(stream: DataFrame, store: Store, checkpoint: str, check: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Writes all operations of a bounded stream into a staging table, checks the whole (check returns issues), and only then
    publishes a checkpoint that holds them. Returns the version; raises, and publishes nothing, if there is an issue.

    The staging table belongs to the stream's own checkpoint: a run that broke off goes on with what it staged, and no other run sees
    it. It is removed once it is published or refused. Batches are written by number, so one that runs again after a lost executor
    replaces itself. Deltas must follow the store's last one by number, without gaps, at one site; else the whole is refused. A stream
    without operations publishes nothing.
    """
    from ..operators import delta

    spark = store.spark
    staged = f"{store.root}/staging/{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(staged)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staged}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not files.exists(path):
        return store.version()
    try:
        ops = spark.read.schema(LOG + ", batch int").parquet(staged)
        counters = ops.agg(F.min("counter"), F.max("counter"), F.countDistinct("counter"), F.countDistinct("site")).first()
        if counters[0] is None:
            return store.version()
        if counters[0] != store.last_counter() + 1 or counters[1] - counters[0] + 1 != counters[2] or counters[3] > 1:
            raise ValueError(f"nothing was published: deltas {counters[0]} to {counters[1]} don't follow {store.last_counter()}")
        space = delta.apply(store.open(), delta.net(ops))
        if check is not None:
            found = check(space).take(1)
            if found:
                raise ValueError(f"nothing was published: {found[0]}")
        return store.checkpoint(space, counters[1])
    finally:
        files.delete(path, True)


def change_feed(stream: DataFrame) -> DataFrame:
    """Each operation as a line of JSON, for a text or message sink."""
    return stream.select(F.to_json(F.struct("counter", "t", "graph_id", "id", "key", "prev", "next")).alias("value"))


def guarded(stream: DataFrame) -> DataFrame:
    """site, counter, expected, accepted of deltas (site, counter): a delta is accepted if it is the next of its site.

    State is one number for each site.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else 0
        counters = sorted(int(c) for batch in batches for c in batch["counter"])
        out = []
        for c in counters:
            out.append((key[0], c, expected, c == expected))
            expected += c == expected
        state.update((expected,))
        yield pd.DataFrame(out, columns=["site", "counter", "expected", "accepted"])

    return stream.select("site", "counter").groupBy("site").applyInPandasWithState(run, ACCEPTED, "expected long", "append", GroupStateTimeout.NoTimeout)
