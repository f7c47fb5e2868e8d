"""Reading trees of files: globs, and what is too large to be parsed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_LINES = 10 << 20, 50_000


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** crosses directories, * and ? don't."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
        elif glob.startswith("**", k):
            out.append(".*")
            k += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])))
            k += 1
    return f"^{''.join(out)}$"


def selected(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Whether a path fits one of include (all, if there is none) and none of exclude."""
    fits = lambda globs: F.lit(False) if not globs else path.rlike("|".join(map(glob_pattern, globs)))
    return (F.lit(True) if not include else fits(include)) & ~fits(exclude)


def oversize(text: Column) -> Column:
    return (F.octet_length(text) > MOST_BYTES) | (F.length(text) - F.length(F.translate(text, "\n", "")) > MOST_LINES)


def read_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """path (below root), text and code (binary, invalid-utf8, oversize or null) of the files of a tree."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    files = raw.select(F.substring_index("path", base, -1).alias("path"), "content").where(selected(F.col("path"), include, exclude))
    text = F.decode("content", "UTF-8")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    code = F.when(F.instr(F.decode("content", "ISO-8859-1"), "\x00") > 0, "binary").when(~valid, "invalid-utf8").when(F.octet_length("content") > MOST_BYTES, "oversize")
    found = files.withColumn("code", code)
    return found.select("path", F.when(F.col("code").isNull(), text).alias("text"), "code")


def chunked(rows: DataFrame, by: list[str], order: list, size: int = 512) -> DataFrame:
    """rows with the number of their delta: size rows of each key make one."""
    from pyspark.sql import Window

    return rows.withColumn("delta", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))
