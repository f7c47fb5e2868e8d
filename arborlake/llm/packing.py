"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Bounded-space online best-fit: a fixed number of bins is open at a time. A bitset has a bit for each amount of free space that
some open bin has, so the bin that fits a piece best is the lowest bit at or above the piece's length. When too many bins are
open, the fullest closes. Each task packs the documents it reads; what ends in bins that aren't nearly full then is packed
again together with the like of the other tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, written

CAPACITY, END_ID = 2048, 0
OPEN_BINS = 4096
#: Bins with less free space than this share of the capacity at a task's end are done; the pieces of the others go on.
NEARLY_FULL = 1 / 64
#: Pieces that one task of the second level packs.
PIECES_PER_TASK = 200_000
#: Chunks of text whose ids a task remembers.
REMEMBERED = 600_000
SECOND_LEVEL = 1 << 61

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, done boolean"


def _byte_characters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it shows, else the next above 255."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


class _Chunks(dict):
    """Numbers of chunks of text; a new one gets the next number."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        number = self[chunk] = len(self)
        self.new.append(chunk)
        return number


class Encoder:
    """Token ids of whole texts. Where a vocabulary drops white space and ends its words there, texts are encoded by chunks
    between spaces, and chunks are remembered; ids are the same as those of the whole text at once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunks = self._drops_space()
        self.characters = _byte_characters()
        self.marks = {m: self.tokenizer.encode(m.decode(), add_special_tokens=False).ids for m in (b",", b".")}
        self._forget()

    def _drops_space(self) -> bool:
        plain = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        joined = [i for x in ("ab", ",", "cd", "\u00e9a") for i in plain(x)]
        return joined == plain("AB, CD \u00c9a") == plain("ab \n\t, cd  \u00e9a") and plain("cd") == self._word(b"cd") != []

    def _word(self, letters: bytes) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(letters.decode("ascii"))]

    def _forget(self) -> None:
        self.known = _Chunks()
        self.at = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def _ids(self, chunk: bytes) -> list[int]:
        """A run of plain Latin letters is one word of the vocabulary's model, a lone comma or full stop after it another; anything
        else takes the whole way."""
        word, mark = (chunk[:-1], self.marks[chunk[-1:]]) if chunk[-1:] in self.marks else (chunk, [])
        model = self.tokenizer.model
        if word.isalpha() and word.islower():
            return [t.id for t in model.tokenize(word.decode("ascii"))] + mark
        text = word.decode("utf-8")
        if text.isalpha() and max(text) < "\u0180" and text == text.lower():
            return [t.id for t in model.tokenize("".join(self.characters[b] for b in word))] + mark
        return self.tokenizer.encode(chunk.decode("utf-8"), add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        clean = [(t or "").encode("utf-8", "replace") for t in texts]
        if not self.by_chunks:
            return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch([c.decode("utf-8") for c in clean], add_special_tokens=False)]
        if len(self.known) > REMEMBERED:
            self._forget()
        codes = []
        for text in clean:
            chunks = self._chunks(text)
            codes.append(np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks)))
        if self.known.new:
            ids = [self._ids(c) for c in self.known.new]
            self.known.new = []
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([len(i) for i in ids], dtype=np.int64)])
            self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], dtype=np.uint32)])
        return [self._gather(c) for c in codes]

    @staticmethod
    def _chunks(text: bytes) -> list[bytes]:
        """Chunks between ASCII white space, A-Z in lower case. Control tokens are written in lower case, so texts with such are
        left as they are."""
        return (text if b"<|" in text else text.lower()).split()

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        start = self.at[codes]
        n = self.at[codes + 1] - start
        ends = np.cumsum(n)
        return self.flat[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class OpenBins:
    """Bounded-space best-fit: add() returns the number of the bin that a piece goes to and the place in it."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f: some open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # numbers of the open bins by free space
        self.n = self.open = 0

    def add(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.n
            self.n += 1
            self.open += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            if self.open > self.most:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.bins[space].pop(0)
        if not self.bins[space]:
            self.free &= ~(1 << space)
        return number

    def unfilled(self, least: int) -> set[int]:
        """Open bins with at least so much free space."""
        return {b for space in range(least, self.capacity + 1) for b in self.bins[space]}


def pieces_of(ids: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or cut at the capacity if longer."""
    return [(a, min(capacity, len(ids) - a)) for a in range(0, len(ids), capacity)]


def _encoded(texts, vocabulary: str) -> list[np.ndarray]:
    end = np.array([END_ID], dtype=np.uint32)
    return [np.concatenate([ids, end]) for ids in encoder(vocabulary)(list(texts))]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _first_level(docs: DataFrame, vocabulary: str, capacity: int, open_bins: int) -> DataFrame:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                for doc_id, ids in zip(part["doc_id"].astype("object").where(part["doc_id"].notna(), None), _encoded(part["text"], vocabulary), strict=True):
                    for k, (start, length) in enumerate(pieces_of(ids, capacity)):
                        number, offset = bins.add(length)
                        held.append((doc_id, k, start, length, _crc(ids[start : start + length]), base + number, offset))
        # a task's pieces are a few numbers each, far smaller than the text that it has read
        open_ = bins.unfilled(max(1, int(capacity * NEARLY_FULL)))
        rows = pd.DataFrame([(*x, x[5] - base not in open_) for x in held], columns=names)
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        yield rows

    return docs.mapInPandas(run, SCHEMA)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Where each piece of each document goes: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and END_ID; a null or empty text is END_ID alone. Documents longer than capacity are cut into
    pieces of that length, others stay whole. ids_crc32 is over a piece's ids as little-endian unsigned 32-bit numbers.
    Repeated rows, null ids included, are packed each; other columns are not returned; an empty table gives no rows. Tasks read
    their rows in the order of the files and nothing depends on which executor runs them, so a task that is run again packs
    alike.
    """
    vocabulary = vocabulary or default_vocabulary()
    rows = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(_first_level(rows, vocabulary, capacity, open_bins), "pack-first")
    left = first.where("not done")
    tasks = max(1, left.count() // PIECES_PER_TASK)
    # No group is larger than a task's share: pieces are dealt by a hash of their bin and place, which no two have in common.
    dealt = left.repartition(tasks, F.xxhash64("bin", "offset")).sortWithinPartitions(F.xxhash64("offset", "bin"), "bin", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), SECOND_LEVEL + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            at = [bins.add(n) for n in batch["length"]]
            yield batch.assign(bin=[base + b for b, _ in at], offset=[o for _, o in at])

    both = first.where("done").unionByName(dealt.mapInPandas(run, SCHEMA))
    return both.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def sequences(docs: DataFrame, placed: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (at most capacity) and doc_ids with the place where each begins.

    placed: what pack_documents(docs) returned. ids must not repeat among the documents here.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.iloc[i : i + 512]
                out = [(d, k, ids[a : a + n].astype(np.int32)) for d, ids in zip(part["doc_id"], _encoded(part["text"], vocabulary), strict=True) for k, (a, n) in enumerate(pieces_of(ids, capacity))]
                yield pd.DataFrame(out, columns=["doc_id", "piece", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInPandas(run, "doc_id long, piece int, ids array<int>")
    at = placed.select(F.col(id_col).alias("doc_id"), "piece", "sequence_id", "offset")
    joined = pieces.join(at, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return joined.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["offset"].alias("offset"))).alias("documents"))
