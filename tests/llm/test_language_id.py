import random
import zlib

import numpy as np

from arborlake.llm import language_id as l

LETTERS = {"aa": "aeioulmn", "bb": "krtszpvg", "cc": "éèñçôaei"}


def made(n=240):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(LETTERS))
        words = ("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.choice([2, 10, 60])))
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None))
    return rows + [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 34 !?", "aa"), (None, "aeiou lmn", None)]


def test_held_out_accuracy_and_rows(spark):
    rows = made()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in l.identify(frame).collect()}
    assert len(got) == len(rows)
    right = total = 0
    for i, text, lang in rows:
        r = got[i]
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        if r["held_out"] and lang and r["lang_pred"] != "und":
            total += 1
            right += r["lang_pred"] == lang
    assert total > 40 and right / total > 0.95


def test_held_out_labels_and_sources_change_nothing(spark):
    rows = made()
    other = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in rows]
    a, b = (sorted(map(tuple, l.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()), key=str) for x in (rows, other))
    assert a == b


def test_profile_is_bound_rotated_letters():
    """Against the definition, letter by letter."""
    letters = np.random.default_rng(20240229).choice(np.array([-1, 1], dtype=np.int8), size=(l.SYMBOLS, l.DIM))
    text = " abc  de"
    s = [26, 0, 1, 2, 26, 3, 4, 26]
    total = np.zeros(l.DIM)
    for a, b, c in zip(s, s[1:], s[2:]):
        total += np.roll(letters[a], 2).astype(float) * np.roll(letters[b], 1) * letters[c]
    assert np.allclose(l.profile(text), total / np.linalg.norm(total))


def test_long_texts_are_read_whole(monkeypatch):
    text = "abc déf " * 500
    whole = l.profile(text)
    monkeypatch.setattr(l, "CHUNK", 97)
    assert np.allclose(whole, l.profile(text))


def test_empty_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "abc", "aa", 5), (1, "abc", "aa", 5)], "doc_id long, text string, lang string, score int")
    assert len(l.identify(frame).collect()) == 2
    assert l.identify(frame.limit(0)).collect() == []
    assert l.known_language(frame).columns == frame.columns


def test_letters_of_all_planes_and_nothing_else_count(spark):
    rows = [(1, "aeiou lmn aeiou", "aa"), (3, "krt szp vgk", "bb"), (10, "\U0001f916 \U0001f916", None), (11, "\U00020000\U00020001", None), (12, "\U0001d400 \U0001f600", None), (13, "\u4e2d\u6587", None), (14, "\U0001f600a", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in l.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[10] == "und" and all(got[i] != "und" for i in (11, 12, 13, 14))
    every = np.array([ord(c) for c in "aZ\u00e9\u4e2d\U00010428 9\U0001f916\U00020000"], dtype=np.uint32)
    assert [x == l.GAP for x in l.symbols(every)] == [not chr(c).isalpha() for c in every]
    assert l.symbols(np.array([0x10400, 0x10428])).tolist()[0] == l.symbols(np.array([0x10428]))[0]


def test_what_is_asked_grows_with_length(spark):
    rng = random.Random(2)
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, text("aeioulmn", 60), "aa") for i in range(30)] + [(100, "ae", "aa"), (101, "12 34", "aa"), (102, None, "aa"), (103, text("qxyw", 300), None), (104, text("aeioulmn", 1), None)]
    kept = {r["doc_id"] for r in l.known_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {*range(30), 100, 104}


def test_a_column_of_the_inner_name_stays(spark):
    frame = spark.createDataFrame([(1, "hello there", "mine"), (2, None, "too")], f"doc_id long, text string, {l.GUESS} string")
    got = l.predict(frame, {"en": np.ones(l.DIM) / np.sqrt(l.DIM)}).collect()
    assert {r[l.GUESS] for r in got} == {"mine", "too"} and {r["lang_pred"] for r in got} == {"en", l.UNKNOWN}
