import random

import numpy as np
import pytest

from arborlake.llm import ngram_join


def brute(rows):
    """component_id and n_links by comparing all pairs of word sets."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))
    n_links = [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                parent[find(x)] = find(y)
                n_links[x] += 1
                n_links[y] += 1
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted((i, len(sets[k]), min(groups[find(k)]), n_links[k]) for k, (i, _) in enumerate(rows))


def made(seed, n=220):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randrange(60))
    shared = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice([3, 5, 6, 9, 12, 20, 60, 150]))] for _ in range(25)]
    rows = []
    for i in range(n):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            text[rng.randrange(len(text))] = word()
        if rng.random() < 0.2:
            text += shared
        if rng.random() < 0.1:
            text = text[: rng.randrange(1, len(text) + 1)]
        rows.append((i * 3, " ".join(text) if rng.random() < 0.5 else "\n ".join(text).upper()))
    return rows + [(1, None), (2, ""), (4, " \t\n"), (5, "one"), (7, "ONE"), (8, "x " * 4000), (9, "x " * 3000)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block", [1024, 7])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = made(seed)
    got = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_repeated_rows_clashing_columns_and_nulls(spark):
    rows = [(1, "a b c d e f", 5, 9), (1, "a b c d e f", 5, 9), (None, "a b c d e f", 1, 1), (None, None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s long, component_id long")
    got = sorted(map(tuple, ngram_join.jaccard_groups(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, 2), (1, 2, 1, 2), (None, 2, 1, 2), (None, 0, None, 0)], key=str)
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "a b c d e f", 5, 9), (None, None, 1, 1)], key=str)


def test_one_row_of_each_group_stays(spark):
    near = "p q r s t u v w x y z a b c d e f g h i j k l m n o"
    rows = [(5, "a b c d e f"), (1, "one two"), (5, near), (2, near + " again"), (None, near), (None, "lone words here"), (None, "lone  words here"), (7, None), (7, ""), (8, "one two"), (8, "three four"), (8, "three four")]
    kept = ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r["doc_id"], r["text"].split() if r["text"] else r["text"]) for r in kept), key=str) == sorted(
        [(5, "a b c d e f".split()), (1, ["one", "two"]), (2, (near + " again").split()), (None, "lone words here".split()), (7, None), (7, ""), (8, ["three", "four"])], key=str
    )


def test_filters_drop_no_link_and_overlaps_are_exact():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([base[rng.random(300) < rng.choice([0.5, 0.9, 0.97])], rng.integers(0, 2**64, int(rng.integers(0, 60)), dtype=np.uint64)])) for _ in range(60)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngram_join._overlaps(sets)
    assert (got[~np.eye(60, dtype=bool)] == exact[~np.eye(60, dtype=bool)]).all()
    n = np.array([len(a) for a in sets])
    x, y = np.triu_indices(60, 1)
    kept = set(zip(*ngram_join._filtered(n, sets, x, y), strict=True))
    linked = {(a, b) for a, b in zip(x, y, strict=True) if ngram_join.links(n[a], n[b], exact[a, b])}
    assert linked <= kept and 0 < len(linked) < len(kept) < len(x)


def test_empty_table(spark):
    assert ngram_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefixes_of_linked_sets_meet():
    """The claim that the join rests on, for random sets and a random frequency order."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = rng.choice(10**6, n, replace=False)
        b = a.copy()
        for k in rng.choice(n, int(rng.integers(0, n // 5 + 1)), replace=False):
            b[k] = rng.integers(10**6, 2 * 10**6)
        b = np.unique(np.concatenate([b, rng.integers(2 * 10**6, 3 * 10**6, int(rng.integers(0, n // 4 + 1)))]))
        if not ngram_join.links(len(a), len(b), len(np.intersect1d(a, b))):
            continue
        rank = lambda x: (x * 7919 % 1000003) % 5 * 10**7 + x
        order = lambda x: x * 104729 % 3000017
        kept = []
        for x in (a, b):
            part = x[np.argsort(order(x))][: 2 * (len(x) // 5) + 2]
            kept.append(set(part[np.argsort(rank(part))][: len(x) // 5 + 2].tolist()))
        assert kept[0] & kept[1]
