import hashlib
import random

import pytest

from arborlake.llm import chat_format as c


def test_escape_is_reversible_and_hides_control_strings():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "<|", "<\\", "im_end|>", "a", "\n"]) for _ in range(rng.randrange(12)))
        assert c.unescape(c.escape(text)) == text
        assert "<|" not in c.escape(text)
        assert c.read_turn(c.chat_markup([("user", text)])) == ("user", text)


def expected(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(c.chat_markup(turns))


def test_digests_are_read_back(spark):
    rng = random.Random(3)
    talks = {i: [(rng.choice(["user", "assistant", "system", None]), rng.choice(["", None, "<|im_end|>", "ñ é\n", "x" * 300, "<\\|"])) for _ in range(rng.choice([1, 2, 7, 200]))] for i in range(25)}
    talks[None] = [("assistant", "lost")]
    rows = [(i, k, r, t, "x") for i, turns in talks.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, span string").repartition(4)
    got = {r[0]: tuple(r)[1:6] for r in c.format_conversations(frame).collect()}
    assert got == {i: expected(t) for i, t in talks.items()}
    spans = {}
    for r in sorted(c.render_turns(frame).where("conv_id is not null").collect(), key=lambda r: (r["conv_id"], r["n"])):
        assert r["start"] == len(spans.get(r["conv_id"], ""))
        spans[r["conv_id"]] = spans.get(r["conv_id"], "") + r["span"]
    assert all(spans[i] == c.chat_markup([(r or "", t or "") for r, t in talks[i]]) for i in spans)


#: A template that hides all texts but the last.
ONLY_LAST = lambda turns: "".join(f"[{r}:{t if k == len(turns) - 1 else ''}]" for k, (r, t) in enumerate(turns))


@pytest.mark.parametrize(("template", "rewrites"), [(ONLY_LAST, True), (lambda t: "".join(f"{r}{x}\n" for r, x in t), False), (lambda t: f"{len(t)}" + "".join(x for _, x in t), True)])
def test_templates_that_rewrite_history_are_noticed(spark, template, rewrites):
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert (c.spans(turns, template) is None) == rewrites
    frame = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = c.format_conversations(frame, template, lambda span: None).collect()[0]
    assert row["rewrites"] == rewrites and row["loss_chars"] == 0 and row["formatted_chars"] == len(template(turns))
    marked = sorted(c.render_turns(frame, template).collect(), key=lambda r: r["n"])
    assert "".join(r["span"] or "" for r in marked) == template(turns)
    assert any(r["in_loss"] for r in marked) != rewrites


def numbered():
    """A template that numbers its turns, and takes none but those of user and assistant in turn."""

    def template(turns):
        assert all(r == ("user", "assistant")[k % 2] for k, (r, _) in enumerate(turns))
        return "<s>" + "".join(f"[{k}] {r}: {t}\n" for k, (r, t) in enumerate(turns))

    return template


@pytest.mark.parametrize(("template", "rewrites"), [(numbered(), False), (lambda t: "".join(x for _, x in t[-100:]), True), (lambda t: "".join(f"{x}|" for _, x in t) if len(t) < 150 else "".join(f"{x};" for _, x in t), True)])
def test_long_conversations_are_rendered_whole_at_every_turn(spark, template, rewrites):
    turns = [(("user", "assistant")[k % 2], f"t{k}") for k in range(180)]
    frame = spark.createDataFrame([(k % 2, k // 2, r, t) for k, (r, t) in enumerate([x for t in turns for x in (t, t)])], "conv_id long, turn long, role string, text string")
    for conv in (0, 1):
        got = sorted(c.render_turns(frame.where(f"conv_id = {conv}"), template).collect(), key=lambda r: r["n"])
        assert "".join(r["span"] or "" for r in got) == template(turns) and len(got) == 180
        assert all(r["rewrites"] == rewrites and r["in_loss"] == (not rewrites and r["role"] == "assistant") for r in got)
        if not rewrites:
            assert got[75]["span"] == "[75] assistant: t75\n" and got[0]["span"] == "<s>[0] user: t0\n"


def test_ties_repeats_and_empty(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = c.format_conversations(frame).collect()[0]
    assert got["turns_sha256"] == expected([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])[1]
    assert c.format_conversations(frame.limit(0)).collect() == []
