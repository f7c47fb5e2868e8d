"""64-bit hashes of the words of texts, many at a time, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Bytes of text that are read at a time.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of an odd number modulo 2 ** 64, and their inverses, by place in a chunk."""

    up = down = np.ones(0, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            cls.up = np.cumprod(np.full(n, _ODD, dtype=np.uint64))
            cls.down = np.cumprod(np.full(n, inverse, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space) of a text, in order.

    Texts are read in chunks of about CHUNK bytes that end at white space, or of a word that is longer.
    """
    out, at = [], 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in _SPACES)
            end = cut if cut > at else min((k for c in _SPACES if (k := text.find(c, end)) >= 0), default=len(text))
        b = np.frombuffer(text[at:end], dtype=np.uint8)
        at = end
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        if not len(first):
            continue
        up, down = _Powers.upto(max(len(b), 1))
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up)])
        h = (sums[last] - sums[first]) * down[first]
        h ^= h >> np.uint64(32)
        h *= _ODD
        out.append(h ^ (h >> np.uint64(29)))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def ascii_lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def word_batches(texts, prepare: Callable[[str], bytes] = ascii_lower) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, number of words of each text) of a few texts at a time; null texts have no words."""
    held, n = [], 0
    for text in texts:
        raw = prepare(text or "")
        held.append(word_hashes(raw))
        n += len(raw)
        if n >= CHUNK:
            yield np.concatenate(held), np.array([len(h) for h in held], dtype=np.int64)
            held, n = [], 0
    if held:
        yield np.concatenate(held), np.array([len(h) for h in held], dtype=np.int64)
