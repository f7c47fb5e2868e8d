import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from arborlake.llm import packing, vector_packing
from arborlake.llm.vector_packing import Example, Limits, Packer


@lru_cache(1)
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def plain(parts):
    t = tokenizer()
    ids, loss = [], []
    for text, bears in parts:
        own = t.encode(text or "", add_special_tokens=False).ids
        ids += own
        loss += [bool(bears)] * len(own)
    return ids + [2], loss + [bool(parts and parts[-1][1])]


def held(rows, examples, limits):
    """Each id in exactly one piece, limits kept, no padding; the number of sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == {k for k, _ in examples}
    for key, parts in examples:
        ids, loss = plain(parts)
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], dtype="<u4").tobytes())
            assert r["loss_tokens"] == sum(loss[r["start"] : at])
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == limits.tokens or at.bit_count() == 1 and at < limits.tokens
        assert len(parts) <= limits.segments and sum(r["loss_tokens"] for r in parts) <= limits.loss
    return len(by_sequence)


def documents(n=250):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgéñ.,") for _ in range(rng.randrange(1, 9)))
    texts = [" ".join(word() for _ in range(int(rng.lognormvariate(4.5, 1.5)))) for _ in range(n)]
    return list(enumerate([*texts, None, "", " ", "x<|endoftext|>y", "word " * 30000, "word " * 4095, "word " * 4096, *[None] * 300]))


@pytest.mark.parametrize(("limits", "pool"), [(Limits(), 1024), (Limits(512, 3, 300), 16), (Limits(64, 64, 1), 1)])
def test_round_trip_of_documents(spark, limits, pool):
    docs = documents(250 if limits.tokens > 64 else 12)
    if limits.tokens == 64:
        docs = docs[:12]
    frame = spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, start int, parts int").repartition(3)
    got = vector_packing.pack_documents(frame, limits=limits, pool=pool)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]
    rows = got.collect()
    n = held(rows, [(k, [(t, True)]) for k, t in docs], limits)
    if limits.tokens == 4096:
        assert n <= sum(r["length"] for r in rows) / 4096 + 3 * 13 + 300 / 128
        whole = sum(r["start"] == 0 and r["length"] == r["doc_tokens"] for r in rows)
        assert whole > 0.9 * len(docs)  # few are cut


def test_conversations_bear_loss_on_one_role(spark):
    rng = random.Random(8)
    turns = [(c, t, "assistant" if t % 2 else "user", "so it is, " * rng.randrange(0, 200)) for c in range(60) for t in range(rng.randrange(1, 7))]
    turns += [(70, 0, None, None), (71, 0, "assistant", "ha ha " * 5000)]
    limits = vector_packing.INSTRUCTION
    got = vector_packing.pack_conversations(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(2)).collect()
    by_conv = {}
    for c, _, role, text in turns:
        by_conv.setdefault(c, []).append((text, role == "assistant"))
    held(got, list(by_conv.items()), limits)
    alone = vector_packing.pack_conversations(spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn int, role string, text string")).collect()
    assert sorted((r["conv_id"], r["doc_tokens"]) for r in alone) == [(None, 2), (None, 2)]


def test_null_parts_and_repeated_rows(spark):
    rows = [(1, None, 0), (1, [], 0), (None, [(None, None)], 0), (None, [("a b", None), ("c", True)], 0)] * 2
    got = vector_packing.pack_examples(spark.createDataFrame(rows, "doc_id long, parts array<struct<text: string, loss: boolean>>, n int").coalesce(1)).collect()
    assert sorted(r["length"] for r in got) == [1] * 6 + [4, 4] and sum(r["loss_tokens"] for r in got) == 4
    assert vector_packing.pack_examples(spark.createDataFrame([], "doc_id long, parts array<struct<text: string, loss: boolean>>")).collect() == []


def test_the_piece_with_the_greatest_dot_product_comes_next():
    """Sizes in tokens and loss; the open sequence has no room left for loss, so the larger example that bears none wins."""
    packer = Packer(Limits(100, 10, 40), 100)
    sizes = {"a": (50, 40), "b": (30, 0), "c": (20, 10), "d": (20, 0)}
    for key, (n, loss) in sizes.items():
        list(packer.add(Example(key, np.zeros(n, np.uint32), np.minimum(np.arange(n + 1), loss))))
    first = [(x.key, b - a) for x, a, b in next(packer.finish())]
    assert first == [("a", 50), ("b", 30), ("d", 20)]


def test_every_choice_is_the_best_of_a_plain_scan():
    rng = random.Random(2)
    limits = Limits(256, 6, 120)
    packer = Packer(limits, 40)
    choose, seen = packer._choose, []

    def checked():
        i = choose()
        score = lambda t, n: min(t, 256) * packer.room / 256**2 + min(n, 120) * packer.loss_room / 120**2
        live = [(score(b - a, x.loss(a, b)), b - a, x.loss(a, b), x.prefix(a, b, packer.room, packer.loss_room) > a) for x, a, b in filter(None, packer.items)]
        whole = [s for s, t, n, _ in live if t <= packer.room and n <= packer.loss_room] if packer.pieces else []
        able = whole or [s for s, _, _, some in live if some]
        if i is None:
            assert not able
        else:
            x, a, b = packer.items[i]
            assert score(b - a, x.loss(a, b)) == pytest.approx(max(able))
        seen.append(i)
        return i

    packer._choose = checked
    done = []
    for k in range(400):
        n = rng.randrange(1, 400)
        bears = np.array([rng.random() < 0.5 for _ in range(n)])
        done += packer.add(Example(k, np.arange(n), None if k % 3 else np.concatenate([[0], np.cumsum(bears)])))
        assert packer.n <= 41
    done += packer.finish()
    assert len(seen) > 400 and sum(b - a for p in done for _, a, b in p) == sum(len({i}) for i in range(0)) + sum(len(x.ids) for x in {id(x): x for p in done for x, _, _ in p}.values())
    for pieces in done:
        n = sum(b - a for _, a, b in pieces)
        assert n == 256 or n.bit_count() == 1


def test_limits_are_positive():
    with pytest.raises(ValueError):
        Packer(Limits(4, 0, 4))
