"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. It is rendered on every prefix of a conversation, whole; where an
output merely extends the one before, the added part is that turn's span. A template whose later output changes what it wrote
before rewrites history: no span can be trusted, so the conversation's text is given whole and gets no loss mask.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END, ESCAPE = "<|im_start|>", "<|im_end|>", "<|"
#: Inside a text "<|" becomes "<\\|", and "<\\" becomes "<\\\\", so that no control string can occur there.
SHIELDED = "<\\"
TURNS = "conv_id long, n int, role string, span string, start long, in_loss boolean, rewrites boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def escape(text: str) -> str:
    return text.replace(SHIELDED, SHIELDED + "\\").replace(ESCAPE, SHIELDED + "|")


def unescape(text: str) -> str:
    """The inverse of escape(); reads from left to right, so doubled shields are not read twice."""
    out, at = [], 0
    while (k := text.find(SHIELDED, at)) >= 0 and k + 2 < len(text):
        out += [text[at:k], ESCAPE if text[k + 2] == "|" else SHIELDED]
        at = k + 3
    return "".join(out) + text[at:]


@lru_cache(4096)
def _marked(role: str, text: str) -> str:
    return f"{START}{escape(role)}\n{escape(text)}{END}\n"


def chat_markup(turns: list[Turn]) -> str:
    """The production template: every turn between a start and an end mark."""
    return "".join([_marked(role, text) for role, text in turns])


def read_turn(span: str) -> Turn | None:
    """Role and text back from a turn's span of chat_markup(); None if it isn't one whole turn."""
    if not span.startswith(START) or not span.endswith(f"{END}\n") or span.count(START) != 1 or span.count(END) != 1:
        return None
    role, _, text = span[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


def spans(conversation: list[Turn], template: Template = chat_markup) -> list[tuple[int, int]] | None:
    """Start and end of each turn in template(conversation); None if the template rewrites history."""
    out, before = [], template([])
    for k in range(1, len(conversation) + 1):
        after = template(conversation[:k])
        if not after.startswith(before):
            return None
        out.append((len(before), len(after)))
        before = after
    return out


def render_turns(conversations: DataFrame, template: Template = chat_markup) -> DataFrame:
    """One row for each turn: conv_id, n (from 0), role, its span of the formatted text and where that starts, and whether it
    is under the loss mask (an assistant's turn). Where the template writes something before the first turn, that belongs to
    the first span. If it changes what it wrote before, at whatever turn, rewrites is true in all the conversation's rows,
    nothing is under the mask, and the formatted text stands whole in the first row (n 0); the others' span and start are null.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are taken by turn (null first), equal ones by
    role and text; repeated rows are turns of their own. A null role or text is empty; rows of a null conv_id form one
    conversation. An empty table gives no rows. The formatted text of a conversation is its spans, one after the other.

    Turns are dealt by conversation and sorted; a task holds one conversation at a time, which a template needs whole. All
    prefixes are rendered, so the work grows with the square of a conversation's length.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def rendered(conv_id: object, talk: list[Turn]) -> Iterator[tuple]:
        found, whole = spans(talk, template), template(talk)
        for n, (role, _) in enumerate(talk):
            if found is None:
                yield conv_id, n, role, None if n else whole, None if n else 0, False, True
            else:
                start, end = found[n] if n else (0, found[0][1])
                yield conv_id, n, role, whole[start:end], start, role == "assistant", False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, talk = object(), []
        for batch in batches:
            out = []
            for conv_id, role, text in zip(_ids(batch), batch["role"], batch["text"], strict=True):
                if talk and conv_id != current:
                    out += rendered(current, talk)
                    talk = []
                current = conv_id
                talk.append((role, text))
            if out:
                yield _frame(out, TURNS)
        if talk:
            yield _frame(list(rendered(current, talk)), TURNS)

    return ordered.mapInPandas(run, TURNS)


def digests(turns: DataFrame, read: Callable[[str], Turn | None] = read_turn) -> DataFrame:
    """One row for each conversation of render_turns(), with what can be read back from its spans.

    turns must come as render_turns() deals them: a conversation's turns in one task, in order. loss_* cover every text under
    the mask once. Where the template rewrites history, turns_sha256 is null, nothing is under the mask, and formatted_chars is
    that of the whole text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), None
        for batch in batches:
            done = []
            for conv_id, span, in_loss, rewrites in zip(_ids(batch), batch["span"], batch["in_loss"], batch["rewrites"], strict=True):
                if held is None or conv_id != current:
                    if held is not None:
                        done.append(held.row(current))
                    current, held = conv_id, _Digest()
                held.add(None if rewrites else read(span), in_loss, len(span or ""), rewrites)
            if done:
                yield _frame(done, DIGESTS)
        if held is not None:
            yield _frame([held.row(current)], DIGESTS)

    return turns.mapInPandas(run, DIGESTS)


class _Digest:
    def __init__(self) -> None:
        self.n = self.chars = self.loss_chars = 0
        self.rewrites = False
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, turn: Turn | None, in_loss: bool, chars: int, rewrites: bool) -> None:
        self.n += 1
        self.chars += chars
        self.rewrites |= bool(rewrites)
        if turn is not None:
            self.turns.update(f"{turn[0]}\n{turn[1]}\n".encode("utf-8", "surrogatepass"))
            if in_loss:
                self.loss_chars += len(turn[1])
                self.loss.update(turn[1].encode("utf-8", "surrogatepass"))

    def row(self, conv_id: object) -> tuple:
        if self.rewrites:
            return conv_id, self.n, None, 0, hashlib.sha256().hexdigest(), self.chars, True
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, False


def _ids(batch: pd.DataFrame) -> pd.Series:
    return batch["conv_id"].astype("object").where(batch["conv_id"].notna(), None)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = dict(x.split() for x in schema.split(", "))
    out = pd.DataFrame(rows, columns=list(kinds))
    return out.astype({c: "Int64" for c, kind in kinds.items() if kind in ("long", "int")})


def format_conversations(conversations: DataFrame, template: Template = chat_markup, read: Callable[[str], Turn | None] = read_turn) -> DataFrame:
    """digests() of render_turns(). A conversation's digest is sequential by nature, hence one task reads it."""
    return digests(render_turns(conversations, template), read)
