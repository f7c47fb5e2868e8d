import random

import numpy as np

from arborlake.llm import decontaminate as d
from arborlake.llm import hashing


def made():
    rng = random.Random(8)
    common = [f"the{k}" for k in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else "wé" + str(rng.randrange(3000))
    items = [(i, " ".join(word() for _ in range(rng.choice([10, 14, 25, 40, 60]))) + ".") for i in range(30)]
    docs, leaks = [], set()
    for i in range(250):
        text = [word() for _ in range(rng.choice([3, 12, 50, 200, 700]))]
        if rng.random() < 0.3:
            k, t = rng.choice(items)
            part = t.split()
            if rng.random() < 0.5:  # a paraphrase: one word in eight replaced, case and marks changed
                part = [word() if n % 8 == 3 else w.upper() + "," for n, w in enumerate(part)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
            leaks.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, items, leaks


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_lcs_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 80))] for _ in range(2))
        assert d.lcs(a, b) == slow_lcs(a, b)


def test_planted_leaks_are_found_and_nothing_else(spark):
    docs, items, leaks = made()
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == leaks


def test_basis_matches_a_dense_svd(spark):
    docs, items, _ = made()
    rows = spark.createDataFrame([(i, t, i) for i, t in docs], "id long, text string, key long").repartition(3)
    block = d.Block(items)
    units = d._units(rows, block)
    weight = block.weigh(*d._counted(units, block))
    basis, values = d.latent_basis(units, block, weight, rank=60)
    number = dict(zip(block.hashes.tolist(), block.numbers.tolist(), strict=True))
    dense = []
    for _, text in docs:
        words = [number.get(h, -1) for h in hashing.word_hashes(b" ".join(d.words_of(text))).tolist()]
        for start in range(0, len(words), d.STRIDE):
            x = np.zeros(block.size)
            for f in words[start : start + d.WIDTH]:
                if f >= 0:
                    x[f] += weight[f]
            dense.append(x)
    exact = np.linalg.svd(np.array(dense), compute_uv=False)
    assert np.allclose(values[:5], exact[:5], rtol=0.1)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-6)


def test_hashed_words_are_the_words():
    for text in ("", None, "A,b  c.\nÉÑé don't x_y 3.14 İ \x1c z", "é" * 50):
        h, n = next(hashing.word_batches([text], d._prepared))
        assert n.tolist() == [len(d.words_of(text))]
        assert h.tolist() == hashing.word_hashes(b" ".join(d.words_of(text))).tolist()


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs, items, leaks = made()
    monkeypatch.setattr(d, "ITEMS", 13)
    got = d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == leaks


def test_nulls_repeats_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, None, 1), (3, "", 1), (None, "x " + item, 1), (4, "clean", 1)], "doc_id long, text string, key int")
    bench = spark.createDataFrame([(7, item, 0), (8, None, 0), (9, " ", 0), (None, item, 0)], "item_id long, text string, id int")
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, bench).collect()}
    assert got == {(1, 7), (None, 7), (1, None), (None, None)}
    kept = d.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert d.find_leaks(empty, bench).collect() == []
    assert d.find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_loose_paraphrases_are_found(spark):
    rng = random.Random(3)
    zipf = lambda: "z" + str(int(1.0003 ** (rng.random() * 25000)))
    items = [(i, " ".join([zipf() for _ in range(rng.choice([16, 24, 30]))]) + ". " + " ".join(zipf() for _ in range(5)) + ".") for i in range(40)]
    docs = []
    for i in range(300):
        text = [zipf() for _ in range(rng.choice([40, 200]))]
        words = d.words_of(items[i % 40][1])
        gone = set(rng.sample(range(len(words) - 5), int(len(words) * rng.uniform(0.25, 0.5))))
        at = rng.randrange(len(text))
        text[at:at] = [f"q{rng.randrange(10**6)}" if k in gone else w.decode() for k, w in enumerate(words)]
        docs.append((i, " ".join(text)))
    expected = set()
    for i, text in docs:
        words, (item_id, item) = d.words_of(text), items[i % 40]
        want, answer = d.words_of(item), d.answer_of(item)
        if any(d.lcs(want, words[a : a + len(want)]) >= d.PARAPHRASE * len(want) and d.lcs(answer, words[a : a + len(want)]) == len(answer) for a in range(len(words))):
            expected.add((i, item_id))
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    print("recall", len(got & expected), len(expected))
    assert len(expected) > 200 and len(got & expected) >= 0.9 * len(expected)


def test_other_documents_of_a_leaks_id_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(None, item), (None, "clean one"), (1, item), (1, "clean two")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r["text"] for r in d.without_leaks(docs, bench).collect()) == ["clean one", "clean two"]
