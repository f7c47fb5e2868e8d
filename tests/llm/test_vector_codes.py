import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, id int"


def plain(rows, entries=256, parts=4, rounds=4):
    """The definition, one vector and entry after the other, in Python's whole numbers."""
    kept = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    whole = [(i, [math.floor(1024 * x) for x in v] + [0] * (dim - len(v)), label) for i, v, label in kept]
    w = dim // parts
    cut = lambda v, p: tuple(v[p * w : (p + 1) * w])
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        found = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return found.index(min(found)), min(found)

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(cut(v, p), books[p])[0] for _, v, _ in whole]
            for e in range(len(first)):
                own = [cut(v, p) for (_, v, _), k in zip(whole, at, strict=True) if k == e]
                if own:
                    books[p][e] = tuple(sum(xs) // len(own) for xs in zip(*own, strict=True))
    out, sums = [], {}
    for i, v, label in whole:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
        sums[label] = sums.get(label, 0) + out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr((*r, sums[r[1]], digest)) for r in out))


def vectors(n, dim=12, seed=1):
    rng = random.Random(seed)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)], rng.choice([1, 1, 1, 2, None, i])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0, None] + [0.0] * (dim - 2), 1), (n + 2, [math.nan] * dim, None), (n + 3, [math.inf] + [0.0] * (dim - 1), 2), (n + 4, [-math.inf] * dim, 2)]
    rows += [(-5, rows[3][1], 9), (-5, rows[4][1], 9), (None, rows[4][1], 9), (None, rows[5][1], None)] + rows[10:14] * 3
    return [(*r, "c", 1, 2) for r in rows]


@pytest.mark.parametrize("entries", [1, 7, 256])
def test_equals_the_definition(table, entries):
    rows = vectors(300)
    got = vector_codes.compress(table(rows, SCHEMA), entries=entries)
    assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows, entries)


def test_ragged_and_empty_vectors(table):
    rows = [(1, [0.5] * 6, 1, "", 0, 0), (2, [], 1, "", 0, 0), (3, [0.25, -0.25], None, "", 0, 0), (4, [-1.0] * 5, 2, "", 0, 0)]
    assert sorted(repr(tuple(r)) for r in vector_codes.compress(table(rows, SCHEMA), entries=2).collect()) == plain(rows, 2)
    only = vector_codes.compress(table([(1, [], 1, "", 0, 0)], SCHEMA)).collect()
    assert [(r["code"], r["error"]) for r in only] == [("00000000", 0)]


def test_empty_tables(table):
    assert vector_codes.compress(table([], SCHEMA)).collect() == []
    assert vector_codes.compress(table([(1, None, 1, "", 0, 0)], SCHEMA)).collect() == []


def test_huge_numbers_are_bounded(table):
    rows = [(i, [(-1.0) ** i * 3e38] * 8, 1, "", 0, 0) for i in range(40)]
    got = vector_codes.compress(table(rows, SCHEMA), entries=1).collect()
    assert len(got) == 40 and all(0 <= r["error"] < 2**63 for r in got) and got[0]["label_error"] == 2**63 - 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), max_size=30), st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=8))
def test_nearest_takes_the_first_least(xs, book):
    at, best = vector_codes.nearest(np.array(xs, np.int64).reshape(-1, 3), np.array(book, np.int64))
    for x, k, d in zip(xs, at, best, strict=True):
        found = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        assert (k, d) == (found.index(min(found)), min(found))


@pytest.mark.parametrize("share", [0.0, 0.1, 2.0])
def test_label_sums_by_broadcast_and_by_shuffle(table, share):
    rows = [(i, None if i % 4 == 0 else i % 7, "00", i) for i in range(100)]
    want = {}
    for _, label, _, e in rows:
        want[label] = want.get(label, 0) + e
    got = vector_codes.with_label_sums(table(rows, "id long, label int, code string, error long"), 100, share).collect()
    assert len(got) == 100 and all(r["label_error"] == want[r["label"]] for r in got)
