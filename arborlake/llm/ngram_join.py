"""N-gram Jaccard join: documents whose sets of word shingles overlap by 80 % or more, and the groups they form.

Rare-first prefix filtering. A set's shingles are put in hash order and only the first part of it, twice a classic prefix, is
sent out to be counted; of that part the most frequent half is dropped, so what is joined on are a set's rarest shingles (a set
of n shingles keeps n // 5 + 2 of its first 2 * (n // 5) + 2). Two sets that overlap enough share one of those: they share at
least one more of the longer parts than either of them drops, and the rarest shared one is dropped by neither.

Sets that share such a shingle meet around a pivot, the shingle's set with the fewest shingles of its own. A pair of sets belongs
to the least of the pivots that both meet at, and is verified there only, once. In a meeting (split into blocks of bounded
volume, each against each) pairs are ruled out by three filters, and what is left is verified by counting common shingles:

- length: sets of too different size;
- position: of two sets no more can be common before, or after, a place in the hash order than either has there;
- suffix: the hash order is halved again and again, and the parts' sizes bound what can be common in each.

No list of pairs is written: a block returns, for each of its sets, the number of rows it is linked with, and at most one link
for each set, which together make the same groups as all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, in_small_batches, runs, written

WORDS = 5
#: Sets, and shingles, that a block of a meeting holds at about most.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20
#: Distinct words whose hashes a task remembers.
REMEMBERED = 1 << 18
#: Candidates' ids are broadcast up to this number (16 bytes each), classes of rows up to a quarter; beyond it they are joined by
#: a shuffle.
BROADCAST_IDS = 2_000_000
#: Halvings of the hash order in the suffix filter.
HALVINGS = 5
#: Columns of shingles that are counted at a time; shingles in so many sets of a block are counted by a product of matrices.
COLUMNS, FREQUENT = 2048, 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: dict | None = None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text; fewer words make one shingle, no word makes none.

    Words are what lies between ASCII white space, A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _Words() if known is None else known
    a = np.array([known[w] for w in words], dtype=np.uint64)
    width = min(n, len(a))
    h = np.full(len(a) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = (h ^ a[k : len(a) - width + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit key of a set of shingles: equal sets are one set from here on."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def links(a: int, b: int, common: np.ndarray | int) -> np.ndarray | bool:
    return 9 * common >= 4 * (a + b)  # 100 * common >= 80 * (a + b - common)


def _sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (hash of the text), s (key of the set), n, and the first part of the set in hash order.

    The part comes with a set's first row in a task only, so that copies, however many, send it once for each task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = _Words(), set()
        for batch in batches:
            keys, sizes, parts = [], [], []
            for text in batch["text"]:
                h = shingles(text, known)
                key = set_key(h) if len(h) else None
                keys.append(key)
                sizes.append(len(h))
                parts.append(None if key in seen else h[: 2 * (len(h) // 5) + 2].view(np.int64))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
            yield pd.DataFrame({"id": batch["id"], "t": batch["t"], "s": pd.array(keys, dtype="Int64"), "n": np.array(sizes, dtype=np.int64), "part": parts})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, t long, s long, n long, part array<long>")


def _kept(sketch: DataFrame) -> DataFrame:
    """(h, s, n, own): the shingles of each set's rare-first prefix that occur in other sets, and how many of the prefix don't.

    Repeated sets count for each task that they are in, which any order allows; whether a shingle is a set's own is told by the keys.
    """
    sent = sketch.where("part is not null and n > 0").select("s", "n", F.explode("part").alias("h"))
    here = Window.partitionBy("h")
    shared = (
        sent.withColumns({"low": F.min("s").over(here), "high": F.max("s").over(here), "df": F.count("*").over(here)})
        .where("low < high")
        .select("s", "n", "h", "df")
    )
    shared = shared.groupBy("s", "h").agg(F.first("n").alias("n"), F.first("df").alias("df"))
    here = Window.partitionBy("s")
    fifth = F.floor(F.col("n") / 5)
    own = F.least(F.col("n"), 2 * fifth + 2) - F.count("*").over(here)
    place = F.row_number().over(here.orderBy("df", "h"))
    return shared.withColumns({"own": own, "place": place}).where(F.col("own") + F.col("place") <= fifth + 2).select("h", "s", "n", "own")


def _meetings(kept: DataFrame) -> DataFrame:
    """(pivot, s, n, own): for each shingle, its sets, named by the one that has the smallest share of shingles of its own."""
    pivots = kept.groupBy("h").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("u"), "s")).alias("p"), F.count("*").alias("c")).where("c > 1")
    return kept.join(pivots, "h").select(F.col("p.s").alias("pivot"), "s", "n", "own").distinct()


def _filtered(n: np.ndarray, hashes: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of sets, sizes n, that lengths, positions and suffixes don't rule out."""
    kept = links(n[x], n[y], np.minimum(n[x], n[y]))
    x, y = x[kept], y[kept]
    finest = np.array([np.bincount((h >> np.uint64(64 - HALVINGS)).astype(np.int64), minlength=1 << HALVINGS) for h in hashes], dtype=np.int32)
    for depth in range(1, HALVINGS + 1):
        sizes = finest.reshape(len(n), 1 << depth, -1).sum(axis=2)
        kept = [links(n[x[k : k + 65536]], n[y[k : k + 65536]], np.minimum(sizes[x[k : k + 65536]], sizes[y[k : k + 65536]]).sum(axis=1)) for k in range(0, len(x), 65536)]
        kept = np.concatenate([*kept, np.zeros(0, dtype=bool)])
        x, y = x[kept], y[kept]
    return x, y


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _overlaps(columns: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of some sets have in common; frequent ones by a product of matrices, the others pair by pair."""
    m = len(columns)
    every, owner = np.concatenate(columns), np.repeat(np.arange(m), [len(c) for c in columns])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    _, column, df = np.unique(every, return_inverse=True, return_counts=True)
    out = np.zeros((m, m), dtype=np.float32)
    rare = df[column] < FREQUENT
    e, o = column[rare & (df[column] > 1)], owner[rare & (df[column] > 1)]
    for lag in range(1, FREQUENT):
        at = np.flatnonzero(e[lag:] == e[:-lag])
        if not len(at):
            break
        np.add.at(out.ravel(), o[at] * m + o[at + lag], 1)
    out += out.T
    often = np.flatnonzero(df >= FREQUENT)
    number = np.full(len(df), -1, dtype=np.int64)
    number[often] = np.arange(len(often))
    e, o = number[column[~rare]], owner[~rare]
    for k in range(0, len(often), COLUMNS):  # e is in order
        lo, hi = np.searchsorted(e, [k, k + COLUMNS])
        dense = np.zeros((m, COLUMNS), dtype=np.float32)
        dense[o[lo:hi], e[lo:hi] - k] = 1
        out += dense @ dense.T
    return out


def _matched(rows: pd.DataFrame, pivot: int, lo: int, hi: int) -> np.ndarray:
    """Which sets of a block (or of one block and another) are linked, as a symmetric matrix, of the pairs that belong to this pivot."""
    m = len(rows)
    n, block = (rows[c].to_numpy() for c in ("n", "block"))
    hashes = [h.view(np.uint64) for h in rows["hashes"]]
    out = np.zeros((m, m), dtype=bool)
    may = (5 * np.minimum.outer(n, n) >= 4 * np.maximum.outer(n, n)) & np.triu(np.ones((m, m), dtype=bool), 1)
    if lo != hi:
        may &= np.not_equal.outer(block, block)
    before = [p[p < pivot] for p in rows["pivots"]]
    if sum(len(p) > 0 for p in before) > 1:
        may &= _overlaps(before) == 0
    x, y = _filtered(n, hashes, *np.nonzero(may))
    if not len(x):
        return out
    if len(x) <= 4 * m:
        common = np.array([_common(hashes[a], hashes[b]) for a, b in zip(x, y, strict=True)])
    else:
        common = _overlaps(hashes)[x, y]
    found = links(n[x], n[y], common)
    out[x[found], y[found]] = True
    return out | out.T


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that make the same groups as all of a matrix."""
    out, new = [], linked.any(axis=1)
    for start in np.flatnonzero(new):
        if not new[start]:
            continue
        new[start] = False
        front = np.array([start])
        while len(front):
            reached = np.flatnonzero(linked[front].any(axis=0) & new)
            out += zip(front[np.argmax(linked[np.ix_(front, reached)], axis=0)].tolist() if len(reached) else [], reached.tolist(), strict=True)
            new[reached] = False
            front = reached
    return out


def _linked(blocks: DataFrame) -> DataFrame:
    """blocks (pivot, lo, hi, block, s, n, own, copies, pivots, hashes) -> links (a, b) that make the groups; and, with a null b,
    how many rows (w) of other sets the set a is linked with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (pivot, lo, hi), rows in runs(batches, ["pivot", "lo", "hi"]):
            linked = _matched(rows, int(pivot), int(lo), int(hi))
            keys, copies = rows["s"].to_numpy(), rows["copies"].to_numpy()
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                edges = _spanning(linked)
                a, b = (keys[[e[k] for e in edges]] for k in (0, 1))
                nulls = lambda n: pd.array([pd.NA] * n, dtype="Int64")
                counts = [int(copies[linked[k]].sum()) for k in some]
                yield pd.DataFrame({"a": np.concatenate([a, keys[some]]), "b": [*pd.array(b, dtype="Int64"), *nulls(len(some))], "w": [*nulls(len(a)), *counts]}).astype({"b": "Int64", "w": "Int64"})

    return blocks.repartition("pivot", "lo", "hi").sortWithinPartitions("pivot", "lo", "hi").mapInPandas(run, "a long, b long, w long")


def components(edges: DataFrame) -> DataFrame:
    """(s, root) of every vertex of edges (a, b): in each round a vertex goes to its least neighbour, and edges follow.

    Keys are hashes, so about half of the vertices go each round; the loop ends when no edge is left.
    """
    edges = written(edges.where("a != b").distinct(), "join-edges")
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("s"), F.least("a", "m").alias("root")), "join-step")
        if label is None:
            label = step
        else:
            to = step.select(F.col("s").alias("root"), F.col("root").alias("next"))
            label = written(label.join(to, "root", "left").select("s", F.coalesce("next", "root").alias("root")), "join-label")
        sides = [step.select(F.col("s").alias(c), F.col("root").alias(f"r{c}")) for c in ("a", "b")]
        moved = edges.join(sides[0], "a").join(sides[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        edges = written(moved.where("a != b").distinct(), "join-edges")
    return edges.select(F.col("a").alias("s"), F.col("b").alias("root")) if label is None else label


class _Classes(NamedTuple):
    """members: id, t, s and n of every row. sets: s, root, copies, links and component of the sets that have copies or links."""

    members: DataFrame
    sets: DataFrame


def _small(df: DataFrame, most: int = BROADCAST_IDS // 4) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _classes(docs: DataFrame, id_col: str, text_col: str) -> _Classes:
    docs = in_small_batches(docs)
    sketch = written(_sketch(docs, id_col, text_col), "join-sketch")
    kept = written(_kept(sketch), "join-kept")
    met = written(_meetings(kept), "join-met")
    members = written(sketch.select("id", "t", "s", "n"), "join-members")
    dropped(sketch, kept)
    copies = written(members.where("s is not null").groupBy("s").agg(F.count("*").alias("copies"), F.min("id").alias("least")), "join-copies")
    hashes = _hashes(docs, copies, met, id_col, text_col)
    about = met.groupBy("s").agg(F.array_sort(F.collect_set("pivot")).alias("pivots"), F.first("n").alias("n"), F.first("own").alias("own"))
    sets = hashes.join(about, "s").join(copies.select("s", "copies"), "s")
    many = met.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = met.select("pivot", "s").join(many, "pivot", "left").select("pivot", "s", F.pmod(F.xxhash64("s"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("pivot", "s", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = written(_linked(placed.join(sets, "s")), "join-links")
    roots = components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("s")).agg(F.sum("w").alias("links"))
    sets = written(copies.join(counts, "s", "left").where("copies > 1 or links is not null").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")), "join-sets")
    # Only classes of several sets need the least id of all; that table is small, or else a join that Spark can split.
    least = written(sets.where("links is not null").groupBy("root").agg(F.min("least").alias("component")), "join-least")
    sets = sets.join(_small(least), "root", "left").select("s", "root", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "least").alias("component"))
    return _Classes(members, written(sets, "join-classes"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (the least id reachable by links, its own included) and n_links of every row.

    Two rows link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more (compared in integers);
    n_links is the number of other rows that a row links with. Rows with equal sets are one set throughout. Null and empty
    texts, and such without a word, have an empty set and link with nothing, not even each other. Repeated rows each get their
    row and link; a null id counts as larger than all others; other columns are not returned; an empty table gives no rows.
    """
    members, sets = _classes(docs, id_col, text_col)
    out = members.join(_small(sets.drop("root")), "s", "left")
    n_links = F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), n_links.alias("n_links"))


def _hashes(docs: DataFrame, copies: DataFrame, met: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(s, hashes) of the sets that meet others, from one row of each; only those texts are read again."""
    wanted = met.select("s").distinct()
    heads = written(copies.join(wanted, "s").select("s", F.col("least").alias("id")), "join-heads")
    ids = heads.select("id")
    ids = F.broadcast(ids) if heads.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).alias("d").join(ids.alias("i"), F.expr("d.id <=> i.id"), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            found = [h for h in (shingles(t, known) for t in batch["text"]) if len(h)]
            yield pd.DataFrame({"s": np.array([set_key(h) for h in found], dtype=np.int64), "hashes": [h.view(np.int64) for h in found]})

    again = rows.mapInPandas(run, "s long, hashes array<long>")
    return written(again.join(heads.select("s"), "s", "left_semi").dropDuplicates(["s"]), "join-hashes")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which no group has more than one: that of the least id stays (null last), of
    one id that whose text has the least hash, and of repeated rows one.

    Rows without words belong to no group and stay.
    """
    members, sets = _classes(docs, id_col, text_col)
    grouped = written(members.join(_small(sets.select("s", "root")), "s").select("root", "id", "t"), "join-grouped")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "t")
    first = grouped.groupBy("root").agg(F.min(rank).alias("f"))
    rows = grouped.groupBy("root", "id", "t").agg(F.count("*").alias("c")).join(first, "root")
    stays = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("t") == F.col("f.t"))
    # Rows that go, and rows that stay but are repeated.
    listed = written(rows.withColumn("stays", stays).where("not stays or c > 1").select(F.col("id").alias("_id"), F.col("t").alias("_t"), "stays"), "join-listed")
    same = docs[id_col].cast("long").eqNullSafe(listed["_id"]) & (F.xxhash64(docs[text_col]) == listed["_t"])
    out = docs.join(_small(listed), same, "left_anti")
    repeated = listed.where("stays")
    if repeated.isEmpty():
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    again = docs.join(_small(repeated), same, "left_semi").select(F.struct(*columns).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"))
    return out.unionByName(again.groupBy("i", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))
