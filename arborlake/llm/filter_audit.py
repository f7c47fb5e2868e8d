"""Interaction audit of corpus filters: what each filter removes in every order of application.

The orders form a trie of permutations. It is walked depth first; a prefix of an order leaves the same survivors in whatever
order its filters ran, so each set of applied filters is one state, visited once. A state holds its survivors as a persisted
DataFrame, made by applying one filter to the survivors of the state before, and counts what each remaining filter removes
from them: the edges. All orders are then read off the edges.
"""

from __future__ import annotations

import json
import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, words, written

#: Orders grow with the factorial of the filters; states with a power of two.
MOST_FILTERS = 7
FILTERS = ["A", "B", "C", "D"]
REPEATED = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails A (under 200 words), B (under half its words distinct), C (over 2 % of characters A-Z), D (a symbol)."""
    ws = words(text)
    n = F.size(ws)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(ws)).cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each document: part, whether it fails A to E, and whether it is labelled good and toxic.

    A null text is empty, a null part the empty string. E: the text is that of a smaller id, anywhere in the table; a row
    without an id has no smaller one and is smaller than none. Repeated rows count each; labels of one id are merged (any
    that says so), labels of null ids are nobody's.

    The texts are read once and give a digest each. One row for each text holds its smallest id, and a document is that first
    one if it meets it by digest and id, so a text that a third of all rows have is met by one row, not by each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    checks = text_filters(text)
    rows = written(
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_digest"), *[c.alias(n) for n, c in checks.items()]),
        "audit-texts",
    )
    firsts = rows.where("_id IS NOT NULL").groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    found = rows.join(firsts, ["_id", "_digest"], "left").withColumn(REPEATED, F.col("_id").isNotNull() & F.col("_first").isNull())
    good = toxic = F.lit(False)
    if labels is not None:
        said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
        found = found.join(said, "_id", "left")
        good, toxic = F.coalesce("_good", F.lit(False)), F.coalesce("_toxic", F.lit(False))
    return written(found.select("part", *FILTERS, REPEATED, good.alias("good"), toxic.alias("toxic")), "audit-failures")


def edges(rows: DataFrame, filters: list[str], tallies: list[str] = (), part: str = "part") -> DataFrame:
    """Counted edges of the trie: state (bits of the filters applied before), filter, part, n (survivors before), removed, and
    removed_<tally> for each boolean column in tallies. Parts without survivors have no row.

    rows: a boolean column for each filter (true: the row fails; null: it doesn't). At most as many states are persisted at a
    time as there are filters; each is let go when all that follow it are counted. A lost executor's part of a state is made
    again from the states before and the table that rows reads.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    path, seen = f"{shared_dir(rows.sparkSession)}/arborlake/audit-edges-{uuid.uuid4().hex}", set()
    fails = [F.col("_fails").bitwiseAND(1 << i) != 0 for i in range(len(filters))]
    removed = [F.struct(F.lit(f).alias("filter"), F.count_if(c).alias("removed"), *[F.count_if(c & F.col(t)).alias(f"removed_{t}") for t in tallies]) for f, c in zip(filters, fails, strict=True)]

    def visit(state: int, survivors: DataFrame) -> None:
        """All states run the same expressions, so the code that Spark makes for one serves all; a filter that ran removes nothing."""
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        survivors.groupBy(part).agg(F.count("*").alias("n"), F.array(*removed).alias("e")).select(F.col(part).alias("part"), "n", F.inline("e")).write.parquet(f"{path}/state={state}")
        for i, c in enumerate(fails):
            after = state | 1 << i
            if after != state and after not in seen and after + 1 < 1 << len(filters):
                seen.add(after)
                visit(after, survivors.where(~c))
        survivors.unpersist()

    bits = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    visit(0, rows.select(part, bits.cast("int").alias("_fails"), *tallies))
    ran = F.coalesce(*[F.when(F.col("filter") == f, F.col("state").bitwiseAND(1 << i) != 0) for i, f in enumerate(filters)])
    return rows.sparkSession.read.parquet(path).where(~ran).select(F.col("state").cast("int").alias("state"), "filter", "part", "n", "removed", *[f"removed_{t}" for t in tallies])


def audit(rows: DataFrame, filters: list[str], tallies: list[str] = (), part: str = "part") -> DataFrame:
    """For each part, order of all filters and step: kept, removed, redundant, unique_fails, lost_<tally> and shapley.

    redundant: fail this filter and were removed before; unique_fails: fail no other filter; shapley: what this filter
    removes, summed over all orders. Steps count from 1. Parts come from the rows, so an empty table gives no rows; a step that
    finds no survivors is a row of zeros. Null parts are a part of their own.
    """
    k = len(filters)
    found = edges(rows, filters, tallies, part)
    value = F.struct("n", "removed", *[f"removed_{t}" for t in tallies])
    # A part has at most 2 ** (k - 1) * k edges.
    by_part = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "state", "filter"), value))).alias("m"))
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "filter": f, "state": sum(1 << filters.index(g) for g in order[:i])}
        for order in permutations(filters)
        for i, f in enumerate(order)
    ]
    shape = "array<struct<filter_order:string,step:int,filter:string,state:int>>"
    def edge(state: Column, filter_: Column) -> Column:
        return F.try_element_at("m", F.concat_ws(" ", state, filter_))

    def count(state: Column, filter_: Column, name: str) -> Column:
        return F.coalesce(edge(state, filter_)[name], F.lit(0).cast("long"))

    here, all_states = (F.col("state"), F.col("filter")), list(range(1 << k))
    own = {f: 1 << i for i, f in enumerate(filters)}
    others = F.coalesce(*[F.when(F.col("filter") == f, F.lit((1 << k) - 1 - bit)) for f, bit in own.items()])
    by_filter = F.map_from_entries(
        F.array(*[
            F.struct(F.lit(f), sum((count(F.lit(s), F.lit(f), "removed") * (factorial(s.bit_count()) * factorial(k - 1 - s.bit_count())) for s in all_states if not s & bit), F.lit(0).cast("long")))
            for f, bit in own.items()
        ])
    )
    out = by_part.select("part", "m", by_filter.alias("shares")).select("part", "m", "shares", F.inline(F.from_json(F.lit(json.dumps(steps)), shape)))
    return out.select(
        "part", "filter_order", "step",
        (count(*here, "n") - count(*here, "removed")).alias("kept"),
        count(*here, "removed").alias("removed"),
        (count(F.lit(0), F.col("filter"), "removed") - count(*here, "removed")).alias("redundant"),
        count(others, F.col("filter"), "removed").alias("unique_fails"),
        *[count(*here, f"removed_{t}").alias(f"lost_{t}") for t in tallies],
        F.col("shares")[F.col("filter")].alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """audit() of filters A to E by source: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    found = audit(failures(docs, labels), [*FILTERS, REPEATED], ["good", "toxic"])
    return found.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})
