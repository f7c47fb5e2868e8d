import random
import zlib

import numpy as np
import pytest

from arborlake.llm import packing

ODD = [
    "", None, "A,b", "a , b", "a, b. c... d.. e ., f", "it's IT'S don't. ' s 's", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>. A", "Ünḯ café,   \x1c z\x85q", "ΑΣ ΟΔΟΣ. Σ",
    "İI", "3.14, 2. 5", "́a b", "１２ ２", "a.\nb,\tc", "<|endoftext|>, . x", "ñandú, ÑANDÚ. \U0001f600  x", "éa é",
]


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


def test_chunks_give_the_ids_of_whole_texts():
    encoder = packing.encoder(packing.default_vocabulary())
    assert encoder.by_chunks
    for text in ODD:
        assert encoder([text])[0].tolist() + [0] == plain(text), text


def docs(n=300):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgéñ.,") for _ in range(rng.randrange(1, 9)))
    rows = [(i, " ".join(word() for _ in range(int(rng.lognormvariate(5, 1.3))))) for i in range(n)]
    return rows + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (5000, "word " * 5000), (5001, "word " * 2047), (5002, "word " * 2048)]


def test_round_trip_and_fill(spark):
    rows = docs()
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        ids, pieces = plain(text), sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(bins) <= 1.05 * total / 2048 + 2


def test_sequences_hold_the_ids(spark):
    rows = [(i, t) for i, t in docs(40) if i is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    placed = packing.pack_documents(frame)
    out = {r["sequence_id"]: r for r in packing.sequences(frame, placed).collect()}
    texts = dict(rows)
    for r in placed.collect():
        ids = out[r["sequence_id"]]["ids"]
        assert ids[r["offset"] : r["offset"] + r["length"]] == plain(texts[r["doc_id"]])[r["start"] : r["start"] + r["length"]]


@pytest.mark.parametrize("most", [1, 3, 50])
def test_open_bins_are_bounded_and_best_fit(most):
    rng, bins, held = random.Random(most), packing.OpenBins(100, most), {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        free_before = {b: 100 - f for b, f in held.items()}
        open_ = {b for space in range(101) for b in bins.bins[space]}
        number, offset = bins.add(n)
        fitting = [free_before[b] for b in open_ if free_before[b] >= n]
        assert (100 - offset) == (min(fitting) if fitting else 100)
        held[number] = offset + n
        assert held[number] <= 100
        assert sum(map(len, bins.bins)) == bins.open <= most


def test_empty_table_and_clashing_columns(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    frame = spark.createDataFrame([(1, "a", 2, True), (1, "a", 2, True)], "doc_id long, text string, bin int, done boolean")
    assert sorted(r["offset"] for r in packing.pack_documents(frame.coalesce(1)).collect()) == [0, 2]
