import random
import re

import numpy as np

from arborlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    seen, covered = {}, set()
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + i for p in places for i in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


def made(n=400):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
        text = " ".join(word() for _ in range(rng.choice([5, 30, 80, 300])))
        if i % 10 == 1:
            text += "\n" + "\n".join(["same line here"] * rng.randrange(1, 4)) + "\t x\x0by \x0c"
        if i % 10 == 2:
            text += " a b c d e f g a b c d e f g" * rng.randrange(1, 9)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["s0", "s1", None])))
    return rows + [(n, None, "en", "s0"), (n + 1, "", "en", "s0"), (n + 2, "a " * 5000, "en", "s0"), (n + 3, "x y", None, None), (None, "p q r s t u v w x y z", "en", "s0")]


def test_statistics_equal_a_plain_version(spark):
    rows = made()
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)).collect()
    want = {i: slow(t) for i, t, _, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(300)), "en", f"s{i % 2}") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "#$%" for _ in range(300)), "en", f"s{i % 2}") for i in range(15)]
    rows += [(2000 + i, " ".join(word() * 6 for _ in range(300)), "en", f"s{i % 2}") for i in range(15)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400))
    assert not any(got[i] for i in got if i >= 1000)


def test_estimates_equal_numpy(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([0, 1, 2, 3], np.diag([1, 2, 3, 4]) + 0.5, 1500)
    bad = rng.normal(30, 1, (150, 4))
    rows = [("g", *map(float, x)) for x in np.vstack([good, bad])]
    est = quality.covariance_estimates(spark.createDataFrame(rows, "grp string, x1 double, x2 double, x3 double, x4 double")).collect()[0]
    assert np.allclose([est[f"m{i}"] for i in range(1, 5)], good.mean(axis=0), atol=0.25)
    low = np.array([[est[f"l{i}{j}"] if j <= i else 0.0 for j in range(1, 5)] for i in range(1, 5)])
    assert np.allclose(low @ low.T, np.cov(good.T), atol=1.0)


def plain_mcd(x, starts):
    """Means and covariance of the best subset by concentration from each start, then of the rows near it."""
    floors, best = np.diag(np.square(quality.FLOORS)), (np.inf, None, None)
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    estimate = lambda y: (y.mean(axis=0), np.cov(y.T, bias=True) + floors)
    for m, c in starts:
        last = np.inf
        while True:
            m, c = estimate(x[np.argsort(far(m, c), kind="stable")[: int(np.ceil(quality.SHARE * len(x)))]])
            det = np.linalg.slogdet(c)[1]
            if last - det <= quality.STILL:
                break
            last = det
        best = min(best, (det, m, c), key=lambda b: b[0])
    return best[0], *estimate(x[far(*best[1:]) <= quality.REWEIGHT_AT * quality.RAW_FACTOR])


def test_estimates_are_those_of_a_plain_mcd(spark):
    rng = np.random.default_rng(5)
    groups = {}
    for k, share in enumerate((0.0, 0.1, 0.24)):
        good = rng.multivariate_normal([0, 1, 2, 3], [[4, 1, 0, 1], [1, 3, 1, 0], [0, 1, 2, 1], [1, 0, 1, 2]], 800)
        bad = rng.multivariate_normal([8, -6, 7, 1], np.eye(4), int(800 * share / (1 - share)))
        groups[f"g{k}"] = np.vstack([good, bad])
    rows = [(g, *map(float, x)) for g, xs in groups.items() for x in xs]
    got = quality.covariance_estimates(spark.createDataFrame(rows, "grp string, x1 double, x2 double, x3 double, x4 double").repartition(4))
    for est in got.collect():
        x = groups[est["grp"]]
        floors = np.diag(np.square(quality.FLOORS))
        mid = np.median(x, axis=0)
        mad = np.sqrt((1.4826 * np.median(np.abs(x - mid), axis=0)) ** 2 + np.diag(floors))
        drawn = np.clip(x, mid - quality.DRAWN_IN * mad, mid + quality.DRAWN_IN * mad)
        starts = [(mid, np.diag(mad**2)), (x.mean(axis=0), np.cov(x.T, bias=True) + floors), (drawn.mean(axis=0), np.cov(drawn.T, bias=True) + floors)]
        det, m, c = plain_mcd(x, starts)
        low = np.array([[est[f"l{i}{j}"] if j <= i else 0.0 for j in range(1, 5)] for i in range(1, 5)])
        assert np.allclose([est[f"m{i}"] for i in range(1, 5)], m, atol=1e-3)
        assert np.allclose(low @ low.T, c, atol=1e-2)
        chosen = [x[rng.choice(len(x), 5, replace=False)] for _ in range(100)]
        assert det <= plain_mcd(x, [(y.mean(axis=0), np.cov(y.T, bias=True) + floors) for y in chosen])[0] + 1e-3


def test_small_sources_are_judged_with_their_whole_language(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = [(i, " ".join(word() for _ in range(200)), "en", "large") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "#$%" for _ in range(200)), "en", "small") for i in range(40)]
    rows += [(2000 + i, " ".join(word() + "#$%" for _ in range(200)), "xx", None) for i in range(20)]
    rows += [(3000 + i, " ".join(word() for _ in range(200)), "yy", "s") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in got if i < 1000 or i >= 3000) and not any(got[i] for i in got if 1000 <= i < 2000)


def test_repeated_rows_clashing_columns_and_empty(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g h i j k", "en", "s", 1.0)] * 2, "doc_id long, text string, lang string, source string, kept double")
    assert [r["kept"] for r in quality.quality_rules(frame).collect()] == [True, True]
    assert quality.quality_rules(frame.limit(0)).collect() == []


def test_main_path_is_native(spark):
    frame = spark.createDataFrame(made(50), "doc_id long, text string, lang string, source string")
    plan = quality.quality_rules(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_null_and_empty_groups_are_told_apart(spark):
    """Texts of one language have many symbols; only against texts of the other they stand out."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9)))
    rows = [(i, " ".join(word() for _ in range(200)), None, None) for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "#$%" for _ in range(200)), "", "") for i in range(70)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[1000 + i] for i in range(70)) > 65 and sum(got[i] for i in range(300)) > 290


def test_groups_at_the_edge_of_their_least_size(spark):
    """A source of one row less than LEAST_ROWS is judged with its language, of that number or one more by itself; no row is lost."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(3, 9)))
    text = lambda more: " ".join(word() + more for _ in range(200))
    sizes = {"a": quality.LEAST_ROWS - 1, "b": quality.LEAST_ROWS, "c": quality.LEAST_ROWS + 1}
    rows = [(10_000 + k, text(""), "en", "big") for k in range(1200)]  # so that the others are fewer than what an estimate leaves out
    rows += [(1000 * (j + 1) + k, text("#$%"), "en", name) for j, (name, n) in enumerate(sizes.items()) for k in range(n)]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    kept = {name: sum(got[1000 * (j + 1) + k] for k in range(n)) / n for j, (name, n) in enumerate(sizes.items())}
    assert len(got) == len(rows) and kept["b"] > 0.9 and kept["c"] > 0.9 and kept["a"] < 0.1
