import random
import re

from pyspark.sql import functions as F

from arborlake.llm import url_filter as u


def slow(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    fits = []
    for verdict, rule in u.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def made(n=600):
    rng = random.Random(6)
    hosts = ["example.com", "www.EXAMPLE.com", "a.example.com", "notcom", "x.net", "net", "spam.net", "b.org", "É.org", "com", "good.com"]
    paths = ["", "/", "/en/", "/en", "/EN/a", "/es/p1", "/fr/x.html", "/de/1?x=://y&z=2", "#://frag", "?q", "/fr/#a"]
    rows = [(i, rng.choice(["http://", "https://", "", "ftp:"]) + rng.choice(hosts) + rng.choice(paths)) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "://"), (n + 3, "http://a\nb/c"), (None, "http://x.net/es/"), (n + 4, "x" * 5000), (n + 4, "x" * 5000)]


def test_rules_equal_a_plain_version(spark):
    rows = made()
    got = sorted(map(tuple, u.filter_urls(spark.createDataFrame(rows, "page_id long, url string").repartition(3)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    want = sorted(((i, *slow(x)) for i, x in rows), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] in ("allow", "block") and (w[4] is None or g[4] == w[4])


def test_trees_learn_what_sets_blocked_urls_apart(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 50}.{'net' if i % 2 else 'com'}/{'es' if i % 2 else 'ok'}/{rng.randrange(10**6) if i % 2 else 'page'}") for i in range(800)]
    rows += [(1000 + i, f"http://g{i % 50}.org/{'es' if i % 2 else 'ok'}/{rng.randrange(10**6) if i % 2 else 'page'}") for i in range(200)]
    got = u.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null").collect()
    assert len(got) == 200
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in got) >= 190


def test_one_kind_of_label_and_empty(spark):
    one = spark.createDataFrame([(1, "http://a.net/es/", 1), (2, "http://b.org/", 1)], "page_id long, url string, host int")
    assert {r["page_id"]: r["verdict"] for r in u.filter_urls(one).collect()} == {1: "block", 2: "block"}
    assert u.filter_urls(one.limit(0)).collect() == []


def test_entropy(spark):
    df = spark.createDataFrame([("aabb", "", ""), ("", "", "")], "_url string, host string, path string")
    assert [r["e"] for r in u.lexical(df).select(F.round("entropy", 6).alias("e")).collect()] == [1.0, 0.0]


def test_no_labelled_row_is_given_its_own_label(spark):
    rows = [(k, f"k{k}", float(k % 2), k % u.FOLDS) for k in range(40)] + [(100 + k, "hot", 1.0, k % u.FOLDS) for k in range(50)] + [(200, "hot", None, 0), (201, "k3", None, 1), (202, "new", None, 2)]
    got = {r["_id"]: r for r in u._with_rates(spark.createDataFrame(rows, "_id long, key string, _label double, _fold long"), "key", "x").collect()}
    assert len(got) == len(rows)
    assert all(got[k]["x_rate"] == 0.5 and got[k]["x_weight"] == 0 for k in [*range(40), 202])
    for k in range(50):  # forty rows of the other folds, or none in fold 0
        assert abs(got[100 + k]["x_rate"] - (50 / 60 if k % u.FOLDS else 0.5)) < 1e-9
    assert abs(got[200]["x_rate"] - 60 / 70) < 1e-9 and abs(got[201]["x_rate"] - 11 / 21) < 1e-9


def test_trees_judge_suffixes_that_no_rule_knows(spark):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    clean, bad = (lambda s: f"https://{word(6)}.{s}/{word(5)}"), (lambda s: f"http://{word(6)}.{s}/es/{'/'.join(str(rng.randrange(10**6)) for _ in range(5))}?a=1&b=2&c={rng.randrange(10**9)}")
    rows = [clean("com") for _ in range(300)] + [bad("net") for _ in range(300)]
    rows += [clean("org") for _ in range(60)] + [bad("info") for _ in range(60)]
    got = {r["page_id"]: r["verdict"] for r in u.filter_urls(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()}
    right = sum(got[k] == "allow" for k in range(600, 660)) + sum(got[k] == "block" for k in range(660, 720))
    assert right >= 108


def test_a_small_sample_has_both_verdicts(spark):
    rows = [(i, f"http://a{i}.com/x") for i in range(40)] + [(100, "http://x.net/es/1"), (100, "http://x.net/es/1"), (200, "http://other.org/" + "y" * 20000)]
    frame = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "page_id long, url string, host string, _label double")
    got = u.filter_urls(frame, train_rows=0).collect()
    assert len(got) == len(rows) and all(r["verdict"] in ("allow", "block") for r in got)
    assert [r["verdict"] for r in got if r["page_id"] == 100] == ["block", "block"]
