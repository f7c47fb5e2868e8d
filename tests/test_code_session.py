import random

import pytest

from arborlake.operators import delta
from arborlake.sources import code
from arborlake.streaming.code_session import CHANGES, Session

FIRST = {"a.py": "from b import f\ndef g(): f()\n", "b.py": "def f(): pass\n", "c/d.py": "def h(): pass\n"}
STEPS = [
    {"a.py": "from b import f\ndef g():\n  # more\n  f()\n"},  # moved: no operation
    {"b.py": "def f(): pass\ndef f(x): pass\n"},  # two of a name: the call from a.py isn't resolved any more
    {"b.py": "def f(): pass\n", "c/d.py": None, "e.py": "import a\nclass K:\n  def m(self): self.m()\n"},
    {"e.py": "import a\nclass K:\n  def m(self): self.m()\n"},  # the same text again
]


def history():
    """(path, version, text) of all changes, by step, and the files after all."""
    files, steps, version = dict(FIRST), [[(p, 1, t) for p, t in FIRST.items()]], 1
    for step in STEPS:
        version += 1
        steps.append([(p, version, t) for p, t in step.items()])
        files |= step
    return steps, {p: t for p, t in files.items() if t is not None}


def run(spark, folder, steps):
    """The session after the steps came as one file of changes each."""
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{folder}/in/{k}")
    session = Session(spark, f"{folder}/session")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/in/*")
    session.watch(stream, availableNow=True).awaitTermination()
    return session


def same(a, b):
    return code.diff_modulo_spans(a, b).isEmpty()


def test_streamed_edits_equal_a_fresh_ingest(spark, tmp_path):
    steps, files = history()
    session = run(spark, f"file://{tmp_path}", steps)
    fresh = code.code_document(code.modules(spark.createDataFrame(list(files.items()), "path string, text string")))
    assert same(session.document(), fresh)
    ops = {b: sorted((r["t"], r["key"]) for r in session.operations(b).collect()) for b in session.published()}
    assert len(ops) == 4 and ops[1] == []
    assert ("edge:remove", None) in ops[2] and ("node:attr", "code:calls-resolved") in ops[2]
    space = Session(spark, f"file://{tmp_path}/none").document()
    for b in session.published():
        space = delta.apply(space, session.operations(b))
    assert same(space, fresh)


@pytest.mark.parametrize("seed", [1])
def test_any_order_of_arrival(spark, tmp_path, seed):
    steps, files = history()
    rows = [r for step in steps for r in step]
    random.Random(seed).shuffle(rows)
    rows += rows[:3]  # some come twice
    session = run(spark, f"file://{tmp_path}", [rows[:5], rows[5:]])
    fresh = code.code_document(code.modules(spark.createDataFrame(list(files.items()), "path string, text string")))
    assert same(session.document(), fresh)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    session = Session(spark, f"file://{tmp_path}/s")
    first = spark.createDataFrame([(p, 1, t) for p, t in FIRST.items()], CHANGES)
    second = spark.createDataFrame([("b.py", 2, None)], CHANGES)
    session.take(first, 0)
    session.take(second, 1)
    once = sorted(map(str, session.operations(1).collect()))
    session.take(second, 1)
    session.take(spark.createDataFrame([], CHANGES), 2)
    assert sorted(map(str, session.operations(1).collect())) == once and session.published() == [0, 1]
