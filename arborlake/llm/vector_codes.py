"""Product quantisation of vectors in whole numbers: a codebook for each part of the vector, the code of each vector, its error.

Codebooks are small and broadcast as integers. Tasks take the vectors in Arrow batches, compute all squared distances by
expanding the norm with exact 64-bit matrix products, and take the first least. What a round needs is sums of the parts that
went to each entry: tasks add up their own, and a grouped shuffle merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one matrix product.
ROWS = 4096
#: A label with more than this share of all rows is joined by a broadcast; there are fewer than one in SHARE such labels.
SHARE = 1 / 512


def _usable(vector: Column) -> Column:
    x = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & F.forall(vector, x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of the book for each row of x, and its squared distance."""
    at, best = [], []
    turned, norms = np.ascontiguousarray(book.T), (book * book).sum(axis=1)
    for i in range(0, len(x), ROWS):
        part = x[i : i + ROWS]
        products = np.matmul(part, turned)
        distances = (part * part).sum(axis=1)[:, None] - 2 * products + norms
        found = distances.argmin(axis=1)
        at.append(found)
        best.append(distances[np.arange(len(part)), found])
    return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *best])


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floored mean of the parts nearest to it, or as it was if there are none."""
    parts, entries, width = books.shape
    given = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), parts * width)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                at, _ = nearest(own, given.value[p])
                np.add.at(sums[p], at, own)
                n[p] += np.bincount(at, minlength=entries)
        p, e = n.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    found = vectors.select("x").mapInArrow(run, "part int, entry int, n long, sums array<bigint>")
    # As many rows as the codebooks have numbers.
    merged = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    out = books.copy()
    for part, entry, place, x, n in merged:
        out[part, entry, place] = x // n
    given.unpersist()
    return out


def _clean(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    dim = -(-longest // parts) * parts
    most = min(1 << 30, isqrt((1 << 62) // max(dim, 1)) // 2)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(dim) - F.size("v")))
    return written(kept.select("id", "label", padded.alias("x")), "codes-vectors"), dim


def train(cleaned: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, numbers) of the cleaned vectors; fewer entries where there are fewer rows."""
    first = cleaned.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) and dim else 0):
        books = _round(cleaned, books)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """id_col, label_col, code (two hex digits for each part), error, label_error and codebooks_sha256.

    Rows whose vector is null or has a null or non-finite number are left out; others are floor(SCALE * x). A codebook starts
    as that part of the ``entries`` smallest ids (equal ids by vector, null ids last) and changes ``rounds`` times; ties go to
    the lower entry. error: squared distance to the entries of the final codebooks; label_error: its sum over the rows of one
    label (nulls are one label). codebooks_sha256: digest of all entries' numbers, by part, entry and place, with commas.

    Vectors shorter than the longest, and lengths that parts don't divide, count as if zeros followed; an empty vector is all
    zeros. So that no distance passes 64 bits, scaled numbers beyond 2 ** 30, or 2 ** 31 through the root of four times the
    length, are taken as that bound; sums beyond 64 bits are given as the greatest long. Repeated rows count each; an empty
    table gives no rows; other columns are not returned. entries is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256")
    cleaned, dim = _clean(vectors, id_col, vector_col, label_col, parts)
    books = train(cleaned, dim, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    given, width = vectors.sparkSession.sparkContext.broadcast(books), dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes, error = _matrix(batch.column("x"), dim), np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                at, distances = nearest(x[:, p * width : (p + 1) * width], given.value[p])
                codes[:, p] = at
                error += distances
            text = codes.tobytes().hex()
            hexes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(hexes, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = dict(cleaned.dtypes)
    coded = written(cleaned.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"), "codes-coded")
    with_sums = with_label_sums(coded, coded.count())
    return with_sums.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def with_label_sums(coded: DataFrame, rows: int, share: float = SHARE) -> DataFrame:
    """coded with label_error, the sum of error over equal labels, nulls together.

    Labels with more than ``share`` of the rows are fewer than 1 / share, so these are broadcast; the rows of others are dealt by
    label, and none of those is large. One label may hold any share of the rows.
    """
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = written(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), most).cast("long").alias("label_error"), F.count("*").alias("n")), "codes-labels")
    hot = sums.where((F.col("n") > rows * share) | F.col("label").isNull()).select(F.col("label").alias("l"), "label_error")
    same = coded["label"].eqNullSafe(F.col("l"))
    here = coded.join(F.broadcast(hot), same).drop("l")
    rest = coded.join(F.broadcast(hot.select("l")), same, "left_anti").join(sums.drop("n"), "label")
    return here.unionByName(rest)
