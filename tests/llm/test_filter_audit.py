import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from arborlake.llm import filter_audit

DOCS = "doc_id long, text string, source string, removed boolean, good string, n long"


def plain_failures(docs, labels):
    texts = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            texts[text or ""] = min(texts.get(text or "", doc_id), doc_id)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = []
    for doc_id, text, source, *_ in docs:
        text = text or ""
        ws = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
        fails = (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), doc_id is not None and texts[text] < doc_id)
        out.append((source or "", fails, doc_id in good, doc_id in toxic))
    return out


def plain_audit(rows, names):
    """Every order is run by itself."""
    parts, out = sorted({r[0] for r in rows}), {}
    for part in parts:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys(range(len(names)), 0)
        for order in permutations(range(len(names))):
            left = own
            for step, f in enumerate(order, 1):
                gone, kept = [r for r in left if r[1][f]], [r for r in left if not r[1][f]]
                before = [r for r in own if r[1][f] and not any(r is x for x in left)]
                alone = sum(sum(r[1]) == 1 and r[1][f] for r in own)
                out[part, "".join(names[i] for i in order), step] = [len(kept), len(gone), len(before), alone, sum(r[2] for r in gone), sum(r[3] for r in gone), f]
                shapley[f] += len(gone)
                left = kept
        for (p, order, step), x in out.items():
            if p == part:
                x[6] = shapley[x[6]]
    return {k: tuple(v) for k, v in out.items()}


def documents():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 30) + rng.choice(["", "", "", "", "é", "Q"])
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 150, 199, 200, 201, 400]))) for _ in range(30)]
    texts += ["$ " + t for t in texts[:5]] + [None, "", " \t\n", "A", "x\x0by\x0cz", "\x1f \x85  ", "word " * 30000]
    docs = [(i, rng.choice(texts), rng.choice(["a", "a", "a", "b", None, ""]), True, "x", 1) for i in range(90)]
    return docs + [(None, texts[7], "a", None, None, None), (3, texts[7], "a", None, None, None), (None, texts[7], "c", None, None, None)]


def test_equals_running_every_order(table):
    docs = documents()
    labels = [(i, i % 2, i % 3 // 2) for i in range(0, 80, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (7000, 1, 1)]
    got = filter_audit.audit_documents(table(docs, DOCS), table(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = plain_audit(plain_failures(docs, labels), "ABCDE")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == want
    assert len(want) == 600 * 4


def test_states_are_visited_once_and_let_go(table, spark):
    rows = table([("p", i % 2 == 0, i % 3 == 0, None if i % 5 else True) for i in range(60)], "part string, X boolean, Y boolean, Z boolean")
    found = filter_audit.edges(rows, ["X", "Y", "Z"])
    at = {(r["state"], r["filter"]): (r["n"], r["removed"]) for r in found.collect()}
    assert len(at) == found.count() == 3 * 2**2  # an edge for each state and filter left, each once
    assert at[0, "X"] == (60, 30) and at[1, "Y"] == (30, 10) and at[3, "Z"] == (20, 4) and at[6, "X"] == (32, 16)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_steps_without_survivors_are_zeros(table):
    rows = table([(None, True, True), (None, True, False), ("", False, False)], "part string, X boolean, Y boolean")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(rows, ["X", "Y"]).collect()}
    assert got[None, "XY", 2] == (0, 0, 1, 0, 1) and got[None, "YX", 2] == (0, 1, 1, 1, 3) and got["", "XY", 2] == (1, 0, 0, 0, 0)


def test_empty_tables_and_no_labels(table):
    assert filter_audit.audit_documents(table([], DOCS)).collect() == []
    got = filter_audit.audit_documents(table([(1, "a", "s", None, None, None)], DOCS))
    assert got.count() == 600 and got.agg(F.sum("good_lost")).first()[0] == 0


def test_too_many_filters(table):
    with pytest.raises(ValueError):
        filter_audit.edges(table([], "part string"), list("ABCDEFGH"))
