"""Masked pseudo-likelihood: every word is predicted from the words on both sides; the log-probabilities add up to a score.

Words are numbered by a vocabulary that is counted over all documents: words above a count that grows with the root of the
corpus each get a number, all others share numbers (buckets) by a hash. The counts of the latter stay a table, however many
they are; such a word's log-probability is that of its bucket, by the network, plus the log of its share of the bucket's count.
The more frequent of them are looked up in the tasks, the rest by a join; that only divides the work.

The network has an embedding of the words at each place of the window, one hidden layer, and an output in two steps (a class of
words, then the word within it), so that a prediction costs far less than a number for each word. It is written in numpy. It is
trained in rounds: each round has a share of the documents, and every task trains on those it reads, from the weights that the
tasks of the round before came to, averaged by the words that each saw in a shuffle. All rounds together read every document once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, summed_arrays, written
from .hashing import word_batches

#: Places of the window; hidden units; the least number of classes, which grows with the vocabulary, and numbers in a class.
PLACES, HIDDEN, CLASSES, MEMBERS = (-2, -1, 1, 2), 16, 32, 64
SIZE = CLASSES * MEMBERS
#: A vocabulary of up to so many words gets a number for each. In a larger one, words that occur at least LEAST times the root of
#: the number of all words have one; the network has twice as many numbers as that or more, and the others share the rest.
KNOWN, LEAST = SIZE // 2, 1.0
BATCH, RATE, ROUNDS = 4096, 0.2, 4
#: Counts of at most so many other words are held in the tasks (16 bytes each); the rest are joined.
HELD = 1_000_000
#: Blocks that the weights are averaged in.
BLOCKS = 64


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): how often each word occurs in all documents; each task sums its own before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [h for h, _ in word_batches(batch["text"])]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """Sorted hashes of the words with a number of their own, those numbers (0 for the most frequent), and (h, n) of the others."""

    h: np.ndarray
    number: np.ndarray
    others: DataFrame | None = None


def _arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """h, as unsigned numbers in order, and n."""
    found = counts.select("h", "n").toArrow()
    h, n = (found[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], n[order]


def vocabulary(docs: DataFrame, text_col: str = "text") -> Vocabulary:
    """The words of all documents; those without a number of their own stay a table, however many they are."""
    counts = written(count_words(docs, text_col), "lm-words")
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = 1 if distinct <= KNOWN else LEAST * total**0.5
    h, n = _arrays(counts.where(F.col("n") >= least))
    number = np.empty(len(h), dtype=np.int64)
    number[np.lexsort((h.view(np.int64), -n))] = np.arange(len(h))
    return Vocabulary(h, number, counts.where(F.col("n") < least))


def _held(others: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The counts of the more frequent of the other words, at most HELD, and the least count among them."""
    least = 2
    while others.where(F.col("n") >= least).count() > HELD:
        least *= 2
    return *_arrays(others.where(F.col("n") >= least)), least


def classes_for(words: tuple) -> int:
    return max(CLASSES, -(-2 * len(words[0]) // MEMBERS))


def _buckets(words: tuple) -> tuple[int, int]:
    """The first bucket's number, and how many there are."""
    size = classes_for(words) * MEMBERS
    return size // 2, size - size // 2


def _numbered(h: np.ndarray, words: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, and whether it is its own."""
    first, n = _buckets(words)
    other = first + (h % np.uint64(n)).astype(np.int64)
    if not len(words[0]):
        return other, np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(words[0], h), len(words[0]) - 1)
    own = words[0][at] == h
    return np.where(own, words[1][at], other), own


def numbers(h: np.ndarray, words: tuple) -> np.ndarray:
    return _numbered(h, words)[0]


def _bucket(h: Column, n: int) -> Column:
    """h % n, for h as an unsigned number."""
    return (F.shiftrightunsigned(h, 1) % n * 2 + h.bitwiseAND(F.lit(1))) % n


class Network:
    """Weights in one flat array: an embedding for each place of the window, and the two output layers."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 7, classes: int = CLASSES, squares: np.ndarray | None = None) -> None:
        if flat is not None:  # all but the last term grow with the classes
            classes = (len(flat) - HIDDEN * (len(PLACES) + MEMBERS)) // (len(PLACES) * MEMBERS * HIDDEN + HIDDEN + 1 + MEMBERS)
        self.classes, self.size = classes, classes * MEMBERS
        shapes = {"e": (len(PLACES), self.size + 1, HIDDEN), "w": (HIDDEN, classes + MEMBERS), "c": (classes,), "m": (classes, MEMBERS)}
        n = sum(int(np.prod(s)) for s in shapes.values())
        if flat is None:
            flat = np.zeros(n, dtype=np.float32)
            rng = np.random.default_rng(seed)
            flat[: int(np.prod(shapes["e"]))] = rng.normal(0, 0.3, int(np.prod(shapes["e"])))
        self.flat, self.squares, at = flat, np.full(n, 0.1, dtype=np.float32) if squares is None else squares, 0
        for name, shape in shapes.items():
            k = int(np.prod(shape))
            setattr(self, name, flat[at : at + k].reshape(shape))
            setattr(self, name + "_squares", self.squares[at : at + k].reshape(shape))
            at += k

    def windows(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words around each word, by place; outside of its own text a word of its own stands."""
        pad = max(PLACES)
        places = np.arange(len(ids)) + pad * (1 + np.repeat(np.arange(len(counts)), counts))
        line = np.full(len(ids) + pad * (len(counts) + 1), self.size, dtype=np.int64)
        line[places] = ids
        return np.stack([line[places + k] for k in PLACES]), ids

    def predicted(self, around: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Log-probability of each word, and what training needs."""
        hidden = self.e[0][around[0]]
        for k in range(1, len(PLACES)):
            hidden += self.e[k][around[k]]
        np.tanh(hidden, out=hidden)
        c, m = np.divmod(ids, MEMBERS)
        z = hidden @ self.w
        z[:, : self.classes] += self.c
        z[:, self.classes :] += self.m[c]
        row = np.arange(len(ids))
        picked = z[row, c] + z[row, self.classes + m]
        np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        a, b = z[:, : self.classes].sum(axis=1), z[:, self.classes :].sum(axis=1)
        return picked - np.log(a) - np.log(b), (hidden, z, a, b, c, m, row)

    def step(self, around: np.ndarray, ids: np.ndarray) -> None:
        """One step of gradient ascent with a rate for each weight that falls with its squared gradients (Adagrad)."""
        _, (hidden, z, a, b, c, m, row) = self.predicted(around, ids)
        k = self.classes
        z[:, :k] /= -a[:, None]
        z[:, k:] /= -b[:, None]
        z[row, c] += 1
        z[row, k + m] += 1
        z /= np.float32(len(ids))
        back = (z @ self.w.T) * (1 - hidden * hidden)
        seen, at = np.unique(c, return_inverse=True)
        onto = np.zeros((len(seen), len(ids)), dtype=np.float32)
        onto[at, row] = 1
        self._climb("w", slice(None), hidden.T @ z, len(ids))
        self._climb("c", slice(None), z[:, :k].sum(axis=0), len(ids))
        self._climb("m", seen, onto @ z[:, k:], len(ids))
        units = np.arange(HIDDEN)
        for p in range(len(PLACES)):  # only the words that occur change
            seen, at = np.unique(around[p], return_inverse=True)
            grad = np.bincount((at[:, None] * HIDDEN + units).ravel(), back.ravel(), len(seen) * HIDDEN).reshape(-1, HIDDEN)
            self._climb("e", (p, seen), grad.astype(np.float32), len(ids))

    def _climb(self, name: str, rows: object, grad: np.ndarray, n: int) -> None:
        squares = getattr(self, name + "_squares")
        squares[rows] += grad * grad * np.float32(n)
        getattr(self, name)[rows] += np.float32(RATE) * grad * np.sqrt(np.float32(n)) / np.sqrt(squares[rows])


def train(docs: DataFrame, words: tuple, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """The weights after one pass over all windows, averaged over the tasks after each of the rounds.

    Texts are dealt to the rounds by a hash. The sums of squared gradients, which set the rates, are averaged and kept too.
    """
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    classes, words, start = classes_for(words), tuple(words[:2]), None
    for k in range(rounds):

        def partial(batches: Iterator[pd.DataFrame]) -> np.ndarray | None:
            net = Network(classes=classes) if start is None else Network(start[0].copy(), squares=start[1].copy())  # noqa: B023
            seen = 0
            for batch in batches:
                for h, counts in word_batches(batch["text"]):
                    around, ids = net.windows(numbers(h, words), counts)
                    for k in range(0, len(ids), BATCH):
                        net.step(around[:, k : k + BATCH], ids[k : k + BATCH])
                    seen += len(ids)
            return np.concatenate([net.flat.astype(np.float64) * seen, net.squares.astype(np.float64) * seen, [seen]]) if seen else None

        found = summed_arrays(texts.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), partial, BLOCKS)
        if found is not None:
            start = np.split((found[:-1] / found[-1]).astype(np.float32), 2)
    return Network(classes=classes).flat if start is None else start[0]


SCORED = "row long, id long, n_tokens long, s double, others array<long>"


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None, words: tuple | None = None) -> DataFrame:
    """id_col, n_tokens, log_likelihood (the sum over all words) and mean_log_likelihood of every row.

    Vocabulary and network come from all the documents themselves unless given. Null and empty texts, and such without a word,
    have 0 tokens, the sum 0 and a null mean. Repeated rows each get their row and train each; other columns are not returned;
    an empty table gives no rows. A word that a given vocabulary hasn't counts as one that occurred once more in its bucket.
    """
    docs = in_small_batches(docs)
    words = vocabulary(docs, text_col) if words is None else words
    weights = train(docs, words, text_col) if weights is None else weights
    (first, n_buckets), others = _buckets(words), words[2] if len(words) > 2 else None
    if others is None:
        others = docs.sparkSession.createDataFrame([], "h long, n long")
    words, (held, held_n, least) = tuple(words[:2]), _held(others)
    in_bucket = np.zeros(n_buckets, dtype=np.int64)
    for r in others.groupBy(_bucket(F.col("h"), n_buckets).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        in_bucket[r["bucket"]] = r["n"]
    in_bucket = np.log(in_bucket + 1)
    held_n = np.log(held_n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, done = Network(weights.copy()), TaskContext.get().partitionId() << 40
        for batch in batches:
            counts, sums, others = [], [], []
            for h, n in word_batches(batch["text"]):
                number, own = _numbered(h, words)
                around, ids = net.windows(number, n)
                got = [net.predicted(around[:, k : k + BATCH], ids[k : k + BATCH])[0] for k in range(0, len(ids), BATCH)]
                each = np.concatenate([*got, np.zeros(0)]).astype(np.float64)
                other = np.flatnonzero(~own)
                each[other] -= in_bucket[number[other] - first]
                if len(held):
                    at = np.minimum(np.searchsorted(held, h[other]), len(held) - 1)
                    hit = held[at] == h[other]
                    each[other[hit]] += held_n[at[hit]]
                    other = other[~hit]
                total, ends = np.concatenate([[0.0], np.cumsum(each)]), np.cumsum(n)
                counts.append(n)
                sums.append(total[ends] - total[ends - n])
                others += np.split(h[other].view(np.int64), np.searchsorted(other, ends)[:-1])
            n, s = np.concatenate(counts), np.concatenate(sums)
            s[n == 0] = 0.0
            yield pd.DataFrame({"row": done + np.arange(len(n)), "id": batch["id"], "n_tokens": n, "s": s, "others": others})
            done += len(n)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(run, SCORED)
    total = F.col("s")
    if least > 2:  # words between once, whose logarithm is 0, and the least count that is held
        scored = written(scored, "lm-scored")
        rest = others.where(F.col("n").between(2, least - 1)).select("h", F.log("n").alias("share"))
        shares = scored.select("row", F.explode("others").alias("h")).join(rest, "h").groupBy("row").agg(F.sum("share").alias("share"))
        scored, total = scored.join(shares, "row", "left"), total + F.coalesce("share", F.lit(0.0))
    return scored.select(F.col("id").alias(id_col), "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_likelihood"))
