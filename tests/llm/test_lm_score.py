import random

import numpy as np

from arborlake.llm import hashing, lm_score


def rows(n=120):
    rng = random.Random(4)
    left, right = [f"l{k}" for k in range(30)], [f"r{k}" for k in range(30)]
    out = [(i, " ".join(rng.choice(left if i % 2 else right) for _ in range(rng.randrange(1, 200)))) for i in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "alone"), (None, "l1 l2 l3")]


def slow_words(text):
    return (text or "").encode().lower().split()


def test_word_hashes_tell_words_apart_and_cross_chunks(monkeypatch):
    texts = ["", " a", "A b\tc\x0bd\x0c e\r\n", "ñ Ñ é", "a\tb\x0cc\rd\x0be " * 9, "x" * 50 + " y " + "x" * 50, "a a a"]
    known = {}
    for size in (1 << 20, 16):
        monkeypatch.setattr(hashing, "CHUNK", size)
        for t in texts:
            w = [x for x in slow_words(t)]
            h = hashing.word_hashes(t.encode().lower()).tolist()
            assert len(h) == len(w)
            for a, b in zip(w, h, strict=True):
                assert known.setdefault(a, b) == b
    assert len(set(known.values())) == len(known)


def test_probabilities_sum_to_one():
    net = lm_score.Network()
    net.flat += np.random.default_rng(1).normal(0, 0.2, len(net.flat)).astype(np.float32)
    around = np.tile(np.array([[5], [7], [2000], [lm_score.SIZE]]), (1, lm_score.SIZE))
    logp, _ = net.predicted(around, np.arange(lm_score.SIZE))
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-3


def test_step_follows_the_gradient():
    rng = np.random.default_rng(2)
    net, ids = lm_score.Network(), rng.integers(0, lm_score.SIZE, 40)
    net.flat += rng.normal(0, 0.2, len(net.flat)).astype(np.float32)
    around = rng.integers(0, lm_score.SIZE, (4, 40))
    before = net.flat.copy()
    base = net.predicted(around, ids)[0].astype(float).mean()
    net.step(around, ids)
    moved = np.flatnonzero(net.flat != before)
    for k in rng.choice(moved, 25):
        flat = before.copy()
        flat[k] += 1e-2
        up = lm_score.Network(flat).predicted(around, ids)[0].astype(float).mean()
        if abs(up - base) > 2e-6:
            assert (up > base) == (net.flat[k] > before[k])


def test_scores_sum_over_words_and_know_context(spark):
    data = rows()
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    words = lm_score.vocabulary(frame)
    weights = lm_score.train(frame, words)
    got = {r["doc_id"]: r for r in lm_score.score_documents(frame, weights=weights, words=words).collect()}
    net = lm_score.Network(weights)
    for doc_id, text in data:
        h = hashing.word_hashes((text or "").encode().lower())
        ids, pad = lm_score.numbers(h, words), lm_score.SIZE
        total = 0.0
        for k in range(len(ids)):
            around = np.array([[ids[k + p] if 0 <= k + p < len(ids) else pad] for p in lm_score.PLACES])
            total += float(net.predicted(around, ids[k : k + 1])[0][0])
        r = got[doc_id]
        assert r["n_tokens"] == len(slow_words(text))
        assert abs(r["log_likelihood"] - total) < 1e-3 * max(1, abs(total))
        assert (r["mean_log_likelihood"] is None) == (len(ids) == 0)
    same = spark.createDataFrame([(1, "l1 l2 l3 l4 l5 l6 l7 l8"), (2, "l1 r2 l3 r4 l5 r6 l7 r8")], "doc_id long, text string")
    a, b = (r["log_likelihood"] for r in lm_score.score_documents(same, weights=weights, words=words).orderBy("doc_id").collect())
    assert a > b


def test_counts_cover_all_documents(spark):
    data = rows()
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    expected = {}
    for _, t in data:
        for w in slow_words(t):
            h = hashing.word_hashes(w).view(np.int64)[0]
            expected[h] = expected.get(h, 0) + 1
    assert {r["h"]: r["n"] for r in lm_score.count_words(frame).collect()} == expected


def test_empty_table(spark):
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id long, text string, n_tokens int")).collect() == []


def test_rare_words_are_scored_by_their_own_counts(spark):
    rng = random.Random(6)
    texts = ["often " * 50 + " ".join(f"w{rng.randrange(60) ** 2 + rng.randrange(40)}" for _ in range(60)) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate([*texts, "unheard", ""])), "doc_id long, text string").repartition(3)
    words = lm_score.vocabulary(frame)
    weights = lm_score.train(frame, words)
    counts = {}
    for t in [*texts, "unheard"]:
        for w in slow_words(t):
            counts[w] = counts.get(w, 0) + 1
    assert len(counts) > lm_score.KNOWN
    hashes = {w: hashing.word_hashes(w) for w in counts}
    own = {w for w, h in hashes.items() if h[0] in words.h}
    assert own == {w for w, n in counts.items() if n >= lm_score.LEAST * sum(counts.values()) ** 0.5}
    number = {w: int(lm_score.numbers(h, words)[0]) for w, h in hashes.items()}
    bucket = {}
    for w in counts.keys() - own:
        bucket[number[w]] = bucket.get(number[w], 0) + counts[w]
    net, pad = lm_score.Network(weights), lm_score.classes_for(words) * lm_score.MEMBERS
    some = sorted(counts.keys() - own, key=number.get)[:40] + [b"often"]
    single = spark.createDataFrame([(i, w.decode()) for i, w in enumerate([*some, b"neverseen"])], "doc_id long, text string")
    got = [r["log_likelihood"] for r in lm_score.score_documents(single, weights=weights, words=words).orderBy("doc_id").collect()]
    for w, x in zip([*some, b"neverseen"], got, strict=True):
        k = int(lm_score.numbers(hashing.word_hashes(w), words)[0])
        expected = float(net.predicted(np.full((4, 1), pad), np.array([k]))[0][0])
        if w not in own:
            expected += np.log(counts.get(w, 1)) - np.log(bucket.get(k, 0) + 1)
        assert abs(x - expected) < 1e-4 * abs(expected)


def test_classes_grow_with_the_vocabulary():
    words = (np.arange(5000, dtype=np.uint64), np.arange(5000))
    net = lm_score.Network(classes=lm_score.classes_for(words))
    assert net.size >= 10000 and lm_score.Network(net.flat).size == net.size
    found = lm_score.numbers(np.arange(20000, dtype=np.uint64), words)
    assert found[:5000].tolist() == list(range(5000)) and found[5000:].min() >= 5000 and found.max() < net.size


def test_words_that_are_joined_score_like_those_held_in_the_tasks(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(f"w{int(1.002 ** rng.randrange(4500))}" for _ in range(rng.randrange(80))) for _ in range(120)]
    frame = spark.createDataFrame([*enumerate(texts), (500, None)], "doc_id long, text string").repartition(3)
    words = lm_score.vocabulary(frame)
    weights = lm_score.train(frame, words)
    score = lambda: [r["log_likelihood"] for r in lm_score.score_documents(frame, weights=weights, words=words).orderBy("doc_id").collect()]
    held = score()
    monkeypatch.setattr(lm_score, "HELD", 20)
    assert lm_score._held(words.others)[2] > 2
    assert np.allclose(held, score(), rtol=1e-6, atol=1e-6)


def test_words_of_the_corpus_score_above_strange_ones(spark):
    rng = random.Random(9)
    twice = [" ".join(f"t{k}x{j}" for j in range(40)) for k in range(30)]
    once = [" ".join(f"o{rng.randrange(10**9)}" for _ in range(40)) for _ in range(60)]
    common = [" ".join(f"c{rng.randrange(50)}" for _ in range(100)) for _ in range(200)]
    rows = [*enumerate(twice), *enumerate(twice, 100), *enumerate(once, 200), *enumerate(common, 300)]
    got = {r["doc_id"]: r["mean_log_likelihood"] for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    mean = lambda low, high: float(np.mean([s for i, s in got.items() if low <= i < high]))
    assert mean(0, 130) > mean(200, 260) + 0.4 and mean(300, 500) > mean(0, 130) + 2


def test_rounds_go_on_from_the_averaged_weights(spark):
    frame = spark.createDataFrame(rows(400), "doc_id long, text string").repartition(4)
    words = lm_score.vocabulary(frame)
    mean = lambda n: lm_score.score_documents(frame, weights=lm_score.train(frame, words, rounds=n), words=words).selectExpr("avg(mean_log_likelihood)").first()[0]
    assert mean(4) > mean(1)
