import zlib
from pathlib import Path

import numpy as np
import pytest

from arborlake.llm import decontaminate, language_id, packing, secret_scan

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the test data")


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline
    from arborlake.llm.common import table, written

    docs = table(spark, SMALL, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_return_the_columns_of_documents(steps):
    for df in steps[1:-1]:
        assert df.dtypes == steps[0].dtypes


def test_language_keeps_what_the_prototypes_know(steps):
    before, after = rows(steps[0]), rows(steps[1])
    sums = {}
    for r in before.values():
        v = language_id.profile(r["text"])
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and v is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v
    best = {}
    for i, r in before.items():
        v = language_id.profile(r["text"])
        best[i] = None if v is None else max(float(v @ s) / np.linalg.norm(s) for s in sums.values())
    asked = lambda n: language_id.LEAST_COSINE * max(n - language_id.FEW, 0) / (n + language_id.SHORT)
    kept = {i for i, b in best.items() if b is not None and max(b, 0) >= asked(len(before[i]["text"]))}
    assert set(after) == kept
    assert all(after[i] == before[i] for i in after)
    assert len(kept) > 0.9 * len(before)


def test_one_of_each_group_stays(steps):
    from test_ngram_join import brute

    before, after = rows(steps[1]), rows(steps[2])
    groups = brute([(i, r["text"]) for i, r in before.items()])
    assert set(after) == {i for i, _, least, _ in groups if i == least}
    assert all(after[i] == before[i] for i in after)


def test_documents_with_a_benchmark_item_go(spark, steps):
    before, after = rows(steps[2]), rows(steps[3])
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontaminate.words_of(text)
        for item in filter(None, items):
            n = len(item)
            for a in range(0, max(1, len(words)), max(1, n // 4)):
                if decontaminate.lcs(item, words[a : a + n + n // 2 + 1]) >= decontaminate.WHOLE * n:
                    return True
        return False

    assert set(after) == {i for i, r in before.items() if not leaks(r["text"])}


def test_secrets_are_replaced_and_nothing_else_changes(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i]["text"] == secret_scan.redact(r["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])
        assert not secret_scan.scan(after[i]["text"].replace(secret_scan.REDACTED, "\n"))


def test_packing_holds_every_token(steps):
    texts = {i: r["text"] for i, r in rows(steps[4]).items()}
    encode = packing.encoder(packing.default_vocabulary())
    pieces = {}
    for r in steps[5].collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for i, text in texts.items():
        ids = np.append(encode([text])[0], 0).astype("<u4")
        assert sum(r["length"] for r in pieces[i]) == len(ids)
        for r in pieces[i]:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    """Every stage keeps rows as they are, takes null and empty texts, and gives no rows for none."""
    import corpus_pipeline

    base = "the quick brown fox jumps over the lazy dog and runs away from the old grey wolf near a river"
    found = [(1, base, "en", "s", 5, 1, "x"), (1, base, "en", "s", 5, 1, "x"), (2, base, None, None, None, 2, None), (None, base + " too", "en", "s", 1, 3, "y"), (3, None, "en", "s", 0, 4, "z"), (4, "", "en", "s", 0, 5, "z"), (5, "password = abcdef123456 while the lazy river runs over the old dog and the grey fox jumps away from a quick brown wolf", "en", "s", 9, 6, "k")]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long, key long, row string")
    for frame, kept in ((docs, {1, 5}), (docs.limit(0), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SMALL)
            assert frame.dtypes == docs.dtypes
        rows_ = frame.collect()
        assert {r["doc_id"] for r in rows_} == kept and len(rows_) == len(kept)
        assert not any("abcdef123456" in r["text"] for r in rows_)
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, SMALL).collect()
        assert {r["doc_id"] for r in packed} == kept
