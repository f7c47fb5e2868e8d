"""Vector bin packing of examples into sequences, under limits on tokens, segments and loss-bearing tokens at once.

A sequence is open at a time in a task, beside a bounded pool of examples. The next piece is the one of the pool whose size has
the greatest dot product with the room left (both as shares of the limits), among those that fit in every respect. Where none
fits whole, the one with the greatest product is cut to what is left, and its rest goes back into the pool. A sequence that
closes short of the token limit is cut at a power of two of tokens, and what is beyond goes back, so no sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches
from .packing import default_vocabulary, encoder

END_ID = 2
#: Examples that a task chooses from.
POOL = 1024
EMPTY = 1 << 62  # size of a place in the pool that holds none


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


#: For instruction data: at most half of a sequence's tokens bear loss.
INSTRUCTION = Limits(4096, 32, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


@dataclass
class Example:
    """Ids of an example and, where not all of them bear loss, how many of the first n do (n from 0 to all)."""

    key: object
    ids: np.ndarray
    loss_before: np.ndarray | None = None

    def loss(self, start: int, end: int) -> int:
        return end - start if self.loss_before is None else int(self.loss_before[end] - self.loss_before[start])

    def prefix(self, start: int, end: int, tokens: int, loss: int) -> int:
        """The end of the longest piece from start, not beyond end, within these limits."""
        end = min(end, start + tokens)
        if self.loss_before is None:
            return min(end, start + loss)
        return min(end, int(np.searchsorted(self.loss_before, self.loss_before[start] + loss, side="right")) - 1)


Piece = tuple[Example, int, int]


class Packer:
    """add() examples; closed sequences come out as lists of (example, start, end)."""

    def __init__(self, limits: Limits, pool: int = POOL) -> None:
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits are at least 1")
        self.limits, self.pool = limits, pool
        self.items: list[Piece | None] = []
        self.tokens, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Sizes as shares of the limits, at most one, over the limits once more: times the room they add up to the dot product.
        self.shares = np.zeros((2, 0))
        self.free: list[int] = []
        self.n = 0
        self._grow(pool + 2)
        self._open()

    def _grow(self, by: int) -> None:
        self.free = list(range(len(self.items) + by - 1, len(self.items) - 1, -1))
        self.items += [None] * by
        self.tokens, self.loss = (np.concatenate([x, np.full(by, EMPTY)]) for x in (self.tokens, self.loss))
        self.shares = np.concatenate([self.shares, np.zeros((2, by))], axis=1)

    def _open(self) -> None:
        self.pieces: list[Piece] = []
        self.room, self.loss_room = self.limits.tokens, self.limits.loss

    def _put(self, example: Example, start: int, end: int) -> None:
        if not self.free:
            self._grow(max(16, len(self.items) // 4))
        i = self.free.pop()
        self.items[i] = (example, start, end)
        tokens, loss, limits = end - start, example.loss(start, end), self.limits
        self.tokens[i], self.loss[i] = tokens, loss
        self.shares[:, i] = min(tokens, limits.tokens) / limits.tokens**2, min(loss, limits.loss) / limits.loss**2
        self.n += 1

    def _choose(self) -> int | None:
        """The slot with the greatest dot product of size and room; sizes beyond a limit count as the limit. None: nothing fits."""
        product = self.shares[0] * self.room
        product += self.shares[1] * self.loss_room  # one segment each: the same for all
        if self.pieces:
            whole = self.tokens <= self.room
            whole &= self.loss <= self.loss_room
            i = int(np.where(whole, product, -1.0).argmax())
            if whole[i]:
                return i
        for i in np.argsort(np.where(self.tokens < EMPTY, -product, 1.0), kind="stable")[: self.n]:
            example, start, end = self.items[i]
            if example.prefix(start, end, self.room, self.loss_room) > start:
                return int(i)
        return None

    def _place(self) -> list[Piece] | None:
        """Puts one piece into the open sequence; what closes, if anything."""
        full = not self.room or len(self.pieces) == self.limits.segments
        i = None if full else self._choose()
        if i is None:
            return self._close()
        example, start, last = self.items[i]
        end = example.prefix(start, last, self.room, self.loss_room)
        self.items[i], self.tokens[i], self.loss[i] = None, EMPTY, EMPTY
        self.free.append(i)
        self.n -= 1
        if end < last:
            self._put(example, end, last)
        self.pieces.append((example, start, end))
        self.room -= end - start
        self.loss_room -= example.loss(start, end)
        return None

    def _close(self) -> list[Piece]:
        pieces, length = self.pieces, self.limits.tokens - self.room
        keep = length if not self.room else 1 << length.bit_length() - 1
        self._open()
        kept, at = [], 0
        for example, start, end in pieces:
            cut = min(end, start + keep - at)
            if cut > start:
                kept.append((example, start, cut))
                at += cut - start
            if cut < end:
                self._put(example, max(cut, start), end)
        return kept

    def add(self, example: Example) -> Iterator[list[Piece]]:
        self._put(example, 0, len(example.ids))
        while self.n > self.pool:
            done = self._place()
            if done:
                yield done

    def finish(self) -> Iterator[list[Piece]]:
        while self.n or self.pieces:
            done = self._place()
            if done:
                yield done


def pack_examples(rows: DataFrame, id_col: str = "doc_id", parts_col: str = "parts", vocabulary: str | None = None, limits: Limits = Limits(), end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Where each piece of each example goes: id_col, start, length, ids_crc32, doc_tokens, loss_tokens, sequence_id, offset.

    parts_col: array of (text, loss). An example is the ids of its texts, one after the other, and end_id, which bears loss if
    the last part does; nulls are empty texts, a null loss is none, a null or empty array is end_id alone, without loss. Each id
    lies in exactly one piece. A sequence has at most limits.tokens tokens, limits.segments pieces and limits.loss tokens that
    bear loss, and as many tokens as the limit or a power of two. ids_crc32 is over the piece's ids as little-endian unsigned
    32-bit numbers, loss_tokens those of the piece, doc_tokens the length of the whole example.

    Repeated rows and null ids are packed each; other columns are not returned; an empty table gives no rows. A task packs the
    rows that it reads, in their order, and holds the ids of its pool's examples and one batch; nothing is shuffled. A task that
    is run again packs alike.
    """
    vocabulary = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base, n = Packer(limits, pool), TaskContext.get().partitionId() << 40, 0

        def table(closed: list[list[Piece]]) -> pd.DataFrame:
            nonlocal n
            out = []
            for pieces in closed:
                at = 0
                for x, a, b in pieces:
                    out.append((x.key[0], a, b - a, zlib.crc32(x.ids[a:b].astype("<u4").tobytes()), x.key[1], x.loss(a, b), base + n, at))
                    at += b - a
                n += 1
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for batch in batches:
            closed = []
            for example in _examples(batch, vocabulary, end_id):
                closed.extend(packer.add(example))
            yield table(closed)
        yield table(list(packer.finish()))

    given = in_small_batches(rows).select(F.col(id_col).cast("long").alias("doc_id"), F.transform(parts_col, lambda p: p["text"]).alias("texts"), F.transform(parts_col, lambda p: p["loss"]).alias("loss"))
    return given.mapInPandas(run, SCHEMA).withColumnRenamed("doc_id", id_col)


def _examples(batch: pd.DataFrame, vocabulary: str, end_id: int, at_once: int = 256) -> Iterator[Example]:
    keys = batch["doc_id"].astype("object").where(batch["doc_id"].notna(), None)
    for i in range(0, len(batch), at_once):
        texts = [[] if t is None else list(t) for t in batch["texts"].iloc[i : i + at_once]]
        loss = [[] if t is None else [bool(x) for x in t] for t in batch["loss"].iloc[i : i + at_once]]
        found = iter(encoder(vocabulary)([t for x in texts for t in x]))
        for key, own, bears in zip(keys.iloc[i : i + at_once], texts, loss, strict=True):
            parts = [next(found) for _ in own] + [np.array([end_id], np.uint32)]
            bears = [*bears, bears[-1] if bears else False]
            ids = np.concatenate(parts)
            before = None if all(bears) else np.concatenate([[0], np.cumsum(np.repeat(bears, [len(p) for p in parts]))])
            yield Example((key, len(ids)), ids, before)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limits: Limits = Limits(), pool: int = POOL) -> DataFrame:
    """pack_examples() of plain texts, all of whose ids bear loss."""
    parts = F.array(F.struct(F.col(text_col).alias("text"), F.lit(True).alias("loss")))
    return pack_examples(docs.select(F.col(id_col), parts.alias("parts")), id_col, "parts", vocabulary, limits, pool=pool)


def pack_conversations(turns: DataFrame, vocabulary: str | None = None, limits: Limits = INSTRUCTION, trained: str = "assistant", pool: int = POOL) -> DataFrame:
    """pack_examples() of conversations (conv_id, turn, role, text): one example each, loss on the turns of one role.

    Turns go by number, then role and text. A row without conv_id is a conversation of its own, so no task gets all of them.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    alone = turns.where("conv_id IS NULL").select("conv_id", F.array(row).alias("t"))
    parts = F.transform("t", lambda x: F.struct(x["text"].alias("text"), (x["role"] == trained).alias("loss")))
    return pack_examples(known.unionByName(alone).select("conv_id", parts.alias("parts")), "conv_id", "parts", vocabulary, limits, pool=pool)
