"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new local folder only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="arborlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With it, a query's shuffle files go when it is done, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: later steps read it instead of computing it again, and nothing is left of its shuffles."""
    path = f"{shared_dir(df.sparkSession)}/arborlake/{name}-{uuid.uuid4().hex}"
    with _cleanup(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Levels:
    """Tables of one schema, written one after the other and read back together: the plan doesn't grow with their number."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n, self.schema = spark, f"{shared_dir(spark)}/arborlake/{name}-{uuid.uuid4().hex}", 0, None

    def add(self, df: DataFrame) -> DataFrame:
        self.schema = self.schema or df.schema
        df.select(self.schema.fieldNames()).write.parquet(f"{self.path}/n={self.n}")
        self.n += 1
        return self.one(self.n - 1)

    def one(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/n={k}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
