"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages. Words of the benchmark get TF-IDF weights from all passages of the corpus, and a
randomised SVD of the passages' weights, summed over the tasks, gives a latent space. Passages whose latent vector is near that
of (a part of) a benchmark item are candidates; each is verified on the words themselves: the longest common subsequence with
the item, and for looser matches (paraphrases) whether the item's answer, its last sentence, stands there too.

The benchmark is a stated query set. It is taken in blocks of bounded size, which is all that is ever sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, summed_arrays, written
from .hashing import word_batches, word_hashes

#: Words of a passage and from one to the next; benchmark items are cut alike.
WIDTH, STRIDE, ITEM_STRIDE = 32, 16, 16
#: Items in a block, and distinct words that a block's items are told apart by (more share them by a hash).
ITEMS, FEATURES = 2000, 8192
#: Latent dimensions, and more for the random start.
RANK, MORE = 192, 8
#: Words in more than this share of the passages carry no weight, but for the LEAST_WORDS rarest of each item.
COMMON, LEAST_WORDS = 0.02, 5
#: Candidates: least cosine in the latent space, and least share of the weight of a part of an item there.
COSINE, SHARE = 0.38, 0.33
#: Leaks: share of the item's words in common order; less is enough where the answer's words stand there too.
WHOLE, PARAPHRASE, ANSWER = 0.75, 0.5, 0.8
#: Documents with candidates are broadcast up to this number (some ten bytes each, and eight for each candidate); beyond it they
#: are joined by a shuffle.
BROADCAST_KEYS = 500_000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; all that isn't ASCII counts as letters."""
    return _WORD.findall((text or "").lower().encode("utf-8", "surrogatepass"))


_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by one machine word operation a word of b."""
    at: dict = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        u = row & at.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[bytes]:
    """The last sentence of an item, or its last five words if that has fewer than three."""
    last = next((w for w in (words_of(s) for s in reversed(re.split(r"[.?!\n]+", text))) if w), [])
    return last if len(last) >= 3 else words_of(text)[-5:]


def matched(found: list, item: list, answer: list, start: int) -> float | None:
    """Share of the item that stands around a passage in common order, or None if that is no leak."""
    n, best, ends, words = len(item), 0, 0, set(item)
    first = max(0, start - n)
    known = np.cumsum([0] + [w in words for w in found[first : start + WIDTH + n + n // 2 + 1]])
    for a in range(first, start + WIDTH, max(1, n // 4)):
        b = a + n + n // 2 + 1
        # No more words than these are in common order.
        if known[min(b - first, len(known) - 1)] - known[min(a - first, len(known) - 1)] < PARAPHRASE * n:
            continue
        common = lcs(item, found[a:b])
        if common > best:
            best, ends = common, a
    if best >= WHOLE * n:
        return best / n
    if best >= PARAPHRASE * n and lcs(answer, found[ends : ends + 2 * n]) >= ANSWER * len(answer):
        return best / n
    return None


class Block:
    """A block of benchmark items: the numbers of their words, and which words belong to which part of which item."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, words_of(t), answer_of(t)) for i, t in items]
        hashes = [word_hashes(b" ".join(ws)) for _, ws, _ in self.items]
        every = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.hashes = every
        self.numbers = (np.arange(len(every)) if len(every) <= FEATURES else every % np.uint64(FEATURES)).astype(np.int32)
        self.size = min(len(every), FEATURES)
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(every >> np.uint64(48)).astype(np.int64)] = True
        self.words = [self.numbers[np.searchsorted(every, h)] for h in hashes]
        self.answers = [self.numbers[np.searchsorted(every, word_hashes(b" ".join(a)))] for _, _, a in self.items]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places, among some words, of those that occur in the block, and their numbers there."""
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        return at[hit], self.numbers[k[hit]]

    def weigh(self, df: np.ndarray, n: float) -> np.ndarray:
        """Inverse document frequency of each word; 0 for common ones that no item needs."""
        idf = np.log((n + 1) / (df + 1))
        kept = df <= COMMON * n
        for w in map(np.unique, self.words):
            kept[w[np.argsort(df[w], kind="stable")[:LEAST_WORDS]]] = True
        return np.where(kept, np.maximum(idf, 1e-3), 0.0)

    def queries(self, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, latent vector and squared weight of each part of each item."""
        owner, vectors, mass = [], [], []
        for k, w in enumerate(self.words):
            for a in range(0, max(1, len(w) - WIDTH + ITEM_STRIDE), ITEM_STRIDE):
                part, times = np.unique(w[a : a + WIDTH], return_counts=True)
                x = weight[part] * times
                owner.append(k)
                vectors.append(x @ basis[part])
                mass.append(float(x @ x))
        return np.array(owner, dtype=np.int64), np.array(vectors).reshape(len(owner), -1), np.array(mass)


def _places(n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text, and place in it, of each place in the words of texts that have n words each."""
    ends = np.cumsum(n)
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - n)[text]


UNITS = "key long, passages long, unit array<int>, word array<short>"


def _units(docs: DataFrame, block: Block) -> DataFrame:
    """For each document: its number of passages (not overlapping ones), and each of the block's words that stands in it, with its
    unit of STRIDE words. A passage is two units. This is the only pass over the texts but for the candidates'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units, words, passages = [], [], []
            for h, n in word_batches(batch["text"], _prepared):
                at, f = block.find(h)
                text, place = _places(n, at)
                ends = np.searchsorted(text, np.arange(1, len(n)))
                units += np.split((place // STRIDE).astype(np.int32), ends)
                words += np.split(f.astype(np.int16), ends)
                passages.append(-(-n // WIDTH))
            yield pd.DataFrame({"key": batch["key"], "passages": np.concatenate(passages), "unit": units, "word": words})

    return written(docs.select("key", "text").mapInPandas(run, UNITS), "leak-units")


class _Entries(NamedTuple):
    """The block's words in some hundred documents: line tells apart units (those of different documents are far from each other)."""

    part: pd.DataFrame
    line: np.ndarray
    word: np.ndarray

    def only(self, kept: np.ndarray) -> _Entries:
        return _Entries(self.part, self.line[kept], self.word[kept])


#: Numbers of line between the first units of two documents.
APART = 1 << 25
#: Pairs of a passage and an item that are counted at a time, and what rounding may take from a bound.
PAIRS, SLACK = 1 << 13, 1e-9


def _entries(batches: Iterator[pd.DataFrame], weight: np.ndarray | None = None) -> Iterator[_Entries]:
    """The entries of the units, some hundred documents at a time; only words that carry weight, if that is given."""
    for batch in batches:
        for k in range(0, len(batch), 256):
            part = batch.iloc[k : k + 256]
            n = np.array([len(w) for w in part["word"]], dtype=np.int64)
            line = np.repeat(np.arange(len(part), dtype=np.int64) * APART, n) + np.concatenate(part["unit"].to_list())
            found = _Entries(part, line, np.concatenate(part["word"].to_list()).astype(np.int64))
            found = found if weight is None else found.only(weight[found.word] > 0)
            if len(found.word):
                yield found


def _counted(units: DataFrame, block: Block) -> tuple[np.ndarray, float]:
    """Passages with each word of the block, and all passages; passages don't overlap here."""

    def partial(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out = np.zeros(block.size)
        for e in _entries(batches):
            out += np.bincount(np.unique(e.line // 2 * FEATURES + e.word) % FEATURES, minlength=block.size)
        return out

    found = summed_arrays(units.select("unit", "word"), partial)
    n = units.agg(F.sum("passages")).first()[0] or 0
    return np.zeros(block.size) if found is None else found, float(n)


def latent_basis(units: DataFrame, block: Block, weight: np.ndarray, rank: int = RANK, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (words by rank) and singular values of the TF-IDF matrix A of all passages, by a randomised SVD.

    A'A times a random matrix is summed over all passages; its orthonormal basis Q is then rotated by the eigenvectors of
    Q'A'AQ, again summed over all passages. A task adds up its own passages' part of A'A by pairs of words that stand
    together, and sends only the product, so both sums are of fixed size.
    """
    size, wide = block.size, min(block.size, rank + MORE)
    start = np.random.default_rng(seed).normal(size=(size, wide)).astype(np.float32)
    entries = units.select("unit", "word")

    def spread(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        return _gram_times(batches, weight, start).ravel()

    summed = summed_arrays(entries, spread)
    q = np.linalg.qr(np.zeros((size, wide)) if summed is None else summed.reshape(size, wide))[0].astype(np.float32)

    def inner(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        return (q.T @ _gram_times(batches, weight, q)).ravel()

    gram = summed_arrays(entries, inner)
    values, vectors = np.linalg.eigh(np.zeros((wide, wide)) if gram is None else gram.reshape(wide, wide))
    top = np.argsort(-values)[:rank]
    return (q @ vectors[:, top]).astype(np.float32), np.sqrt(np.maximum(values[top], 0))


def _gram_times(batches: Iterator[pd.DataFrame], weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'A x for the passages of a task."""
    size = len(weight)
    own, pairs = np.zeros(size), np.zeros(size * size, dtype=np.float32)
    for e in _entries(batches, weight):
        value = weight[e.word].astype(np.float32)
        both = np.where(e.line % APART > 0, 2, 1).astype(np.float32)  # a unit is in two passages, but for the first one
        own += np.bincount(e.word, both * value * value, size)
        for lag in range(1, len(value)):
            gap = e.line[lag:] - e.line[:-lag]
            at = np.flatnonzero(gap <= 1)
            if not len(at):
                break
            np.add.at(pairs, e.word[at] * size + e.word[at + lag], np.where(gap[at] == 0, both[at], 1) * value[at] * value[at + lag])
    pairs = pairs.reshape(size, size)
    return pairs @ x + pairs.T @ x + own[:, None].astype(np.float32) * x


def _summed(vectors: np.ndarray, row: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x times the rows of vectors, for runs that begin at first: the k-th of every run at once."""
    n = np.diff(np.append(first, len(row)))
    out = vectors[row[first]] * x[first, None]
    for k in range(1, n.max()):
        more = np.flatnonzero(n > k)
        at = first[more] + k
        out[more] += vectors[row[at]] * x[at, None]
    return out


def _candidates(units: DataFrame, block: Block, weight: np.ndarray, basis: np.ndarray, queries: tuple) -> DataFrame:
    """(key, item, passage) of the passages near a part of an item, by cosine in the latent space.

    Pairs that can't be a leak by the number of the item's (and its answer's) words around the passage are left out at once.
    """
    owner, vectors, _ = queries
    norms = np.linalg.norm(vectors, axis=1)
    seen = norms > 1e-9
    owner, norms = owner[seen], norms[seen]
    toward = (vectors[seen] / norms[:, None]).astype(np.float32).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        possible = _Possible(block, weight)
        for every in _entries(batches):
            e = every.only(weight[every.word] > 0)
            if not len(owner) or not len(e.word):
                continue
            first = np.flatnonzero(np.diff(e.line, prepend=-1))
            line = e.line[first]
            z = _summed(basis, e.word, weight[e.word].astype(np.float32), first)
            # A passage is a unit and the next one; one that starts a unit earlier, where no weighted word stands, is that unit alone.
            alone = np.flatnonzero((np.diff(line, prepend=-2) > 1) & (line % APART > 0))
            follows = np.flatnonzero(np.diff(line) == 1)
            single = z[alone]
            z[follows] += z[follows + 1]
            z = np.concatenate([z, single])
            line = np.concatenate([line, line[alone] - 1])
            length = np.linalg.norm(z, axis=1)
            heavy = np.flatnonzero(length >= SHARE * norms.min())  # no passage of less weight passes the test on shares below
            cosine = z[heavy] @ toward
            row, query = np.nonzero(cosine >= COSINE * length[heavy][:, None])
            enough = cosine[row, query] >= SHARE * norms[query]
            pair = np.unique(heavy[row[enough]] * len(block.items) + owner[query[enough]])
            passage, item = np.divmod(pair, len(block.items))
            at = line[passage]
            kept = possible.by_weighted(e, at, item)
            at, item = at[kept], item[kept]
            kept = possible.by_all(every, at, item)
            at, item = at[kept], item[kept]
            keys = e.part["key"].to_numpy()
            yield pd.DataFrame({"key": keys[at // APART], "item": item.astype(np.int32), "passage": (at % APART).astype(np.int32)})

    return units.select("key", "unit", "word").mapInPandas(run, "key long, item int, passage int")


class _Possible:
    """Whether a passage can hold a leak of an item: true bounds of what matched() accepts, from the words around the passage.

    A leak leaves out at most a share of the item's words (and of its answer's), hence at most so many of the weighted ones.
    Those are counted first, by place; what is left is counted again over all words, each at most as often as the item has it.
    """

    def __init__(self, block: Block, weight: np.ndarray) -> None:
        shape = len(block.items), block.size
        self.words, self.answers = np.zeros(shape, dtype=np.int16), np.zeros(shape, dtype=np.int16)
        for k, (w, a) in enumerate(zip(block.words, block.answers, strict=True)):
            np.add.at(self.words[k], w, 1)
            np.add.at(self.answers[k], a, 1)
        held = weight > 0
        self.n = np.array([len(w) for w in block.words])
        weighted = self.words[:, held].sum(axis=1)
        self.whole, self.half = weighted - (1 - WHOLE) * self.n, weighted - (1 - PARAPHRASE) * self.n
        self.in_answer = np.array([len(a) for a in block.answers])
        self.answer = self.answers[:, held].sum(axis=1) - (1 - ANSWER) * self.in_answer

    def _around(self, e: _Entries, line: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries around each passage that a match may reach, and which passage each is for."""
        lo = np.searchsorted(e.line, line - -(-self.n[item] // STRIDE) - 1)
        hi = np.searchsorted(e.line, line + 3 + -(-(2 * self.n[item] + 1) // STRIDE))
        many = hi - lo
        return np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()), np.repeat(np.arange(len(item)), many)

    def by_weighted(self, e: _Entries, line: np.ndarray, item: np.ndarray) -> np.ndarray:
        out = np.zeros(len(item), dtype=bool)
        for k in range(0, len(item), PAIRS):
            i = item[k : k + PAIRS]
            at, owner = self._around(e, line[k : k + PAIRS], i)
            common = np.bincount(owner[self.words[i[owner], e.word[at]] > 0], minlength=len(i))
            answer = np.bincount(owner[self.answers[i[owner], e.word[at]] > 0], minlength=len(i))
            out[k : k + PAIRS] = (common >= self.whole[i] - SLACK) | ((common >= self.half[i] - SLACK) & (answer >= self.answer[i] - SLACK))
        return out

    def by_all(self, e: _Entries, line: np.ndarray, item: np.ndarray) -> np.ndarray:
        out, size = np.zeros(len(item), dtype=bool), self.words.shape[1]
        for k in range(0, len(item), PAIRS):
            i = item[k : k + PAIRS]
            at, owner = self._around(e, line[k : k + PAIRS], i)
            both, times = np.unique(owner * size + e.word[at], return_counts=True)
            owner, word = np.divmod(both, size)
            common = np.bincount(owner, np.minimum(times, self.words[i[owner], word]), len(i))
            answer = np.bincount(owner, np.minimum(times, self.answers[i[owner], word]), len(i))
            out[k : k + PAIRS] = (common >= WHOLE * self.n[i] - SLACK) | ((common >= PARAPHRASE * self.n[i] - SLACK) & (answer >= ANSWER * self.in_answer[i] - SLACK))
        return out


def _verified(docs: DataFrame, near: DataFrame, block: Block) -> DataFrame:
    items = block.items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, key, text, pairs in zip(batch["id"].astype("object").where(batch["id"].notna(), None), batch["key"], batch["text"], batch["near"], strict=True):
                found, best = words_of(text), {}
                for pair in pairs:
                    item_id, item, answer = items[pair["item"]]
                    share = matched(found, item, answer, pair["passage"] * STRIDE)
                    if share is not None:
                        best[item_id] = max(share, best.get(item_id, 0))
                out += [(id_, key, i, s) for i, s in best.items()]
            frame = pd.DataFrame(out, columns=["id", "key", "item_id", "overlap"])
            yield frame.astype({"id": "Int64", "key": "int64", "item_id": "Int64"})

    near = written(near.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("item", "passage"))).alias("near")), "leak-near")
    rows = docs.join(F.broadcast(near) if near.count() <= BROADCAST_KEYS else near, "key")
    return rows.select("id", "key", "text", "near").mapInPandas(run, "id long, key long, item_id long, overlap double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, item_id and overlap (share of the item's words that stand in the document in common order) of every leak.

    A pair appears once, repeated rows or not; documents without a leak don't appear. Items and documents that are null, empty
    or without a word match nothing. A null document id is kept, as one; other columns are not returned. If either table is
    empty there are no rows.
    """
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col)
    return found.groupBy("id", "item_id").agg(F.max("overlap").alias("overlap")).withColumnRenamed("id", id_col)


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, key (of the id and the text), item_id and overlap of every leak."""
    spark = docs.sparkSession
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), _key(id_col, text_col).alias("key")).where("text is not null")
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    out = spark.createDataFrame([], "id long, key long, item_id long, overlap double")
    for part in _blocks(items):
        block = Block(part)
        units = _units(rows, block)
        weight = block.weigh(*_counted(units, block))
        basis, _ = latent_basis(units, block, weight)
        near = _candidates(units, block, weight, basis, block.queries(weight, basis))
        out = out.unionByName(_verified(rows, near, block))
    return out


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items with a word, ITEMS at a time; the driver holds one block."""
    held = []
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if words_of(r["text"]):
            held.append((r["item_id"], r["text"]))
        if len(held) == ITEMS:
            yield held
            held = []
    if held:
        yield held


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no benchmark item was found."""
    leaks = written(_leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("_leak"), F.col("key").alias("_key")).distinct(), "leak-ids")
    return docs.join(leaks, docs[id_col].cast("long").eqNullSafe(leaks["_leak"]) & (F.xxhash64(docs[id_col], docs[text_col]) == leaks["_key"]), "left_anti")
