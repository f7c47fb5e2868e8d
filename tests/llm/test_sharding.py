import random
import zlib

import pytest

from arborlake.llm import sharding


def made(seed, n):
    rng = random.Random(seed)
    texts = ["", None, "é" * 10, *("t" * rng.randrange(1, 400) + str(k) for k in range(max(1, n // 3)))]
    return [(i, "hot text" if rng.random() < 0.3 else rng.choice(texts)) for i in range(n)]


def needed(groups, capacity):
    """Shards that greedy filling of the ordered groups takes."""
    shards, room = 0, 0
    for g in groups:
        if g > room:
            shards, room = shards + 1, capacity
        room -= g
    return shards


@pytest.mark.parametrize(("seed", "n", "probes"), [(1, 300, 24), (2, 40, 3), (3, 8, 2), (4, 1, 24)])
def test_largest_shard_is_minimal_over_contiguous_groups(spark, seed, n, probes):
    rows = made(seed, n)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), probes=probes).collect()
    texts = dict(rows)
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    import hashlib

    sizes, shard_of, load = {}, {}, {}
    for r in got:
        text = texts[r["doc_id"]]
        raw = (text or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        key = "" if text is None else hashlib.sha256(raw).hexdigest()
        sizes[key] = sizes.get(key, 0) + r["size"]
        assert shard_of.setdefault(key, r["shard"]) == r["shard"]
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
    order = sorted(sizes)
    assert [shard_of[k] for k in order] == sorted(shard_of[k] for k in order)
    groups = [sizes[k] for k in order]
    low, high = max(groups), sum(groups)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(groups, mid) <= 8 else (mid + 1, high)
    assert max(load.values()) == low
    for shard in load:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_repeated_rows_nulls_and_empty(spark):
    frame = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, "a", 3), (None, None, 3)], "doc_id long, text string, shard int")
    got = sharding.shard_documents(frame).collect()
    assert len(got) == 4 and len({(r["shard"], r["slot"]) for r in got}) == 4
    assert sharding.shard_documents(frame.limit(0)).collect() == []
