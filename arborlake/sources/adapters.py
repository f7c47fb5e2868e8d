"""Adapters: sources as graph rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, slug

SENTENCE = r"[^.!?]*(?:[.!?]+(?=\s|$)|[.!?]+|$)"


def exchanges(turns: DataFrame) -> DataFrame:
    """conv_id, turn, exchange of turns (conv_id, turn, role): a new exchange begins at each user turn but the first of all turns."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    first = F.row_number().over(order) == 1
    begins = turns.select("conv_id", "turn", "role", F.when((F.col("role") == "user") & ~first, 1).otherwise(0).alias("begins"))
    return begins.select("conv_id", "turn", "role", F.sum("begins").over(order).cast("long").alias("exchange"))


def replies(turns: DataFrame) -> DataFrame:
    """conv_id, src, dst: each turn replies to the one before it in the same exchange."""
    grouped = exchanges(turns)
    before = F.lag("turn").over(Window.partitionBy("conv_id", "exchange").orderBy("turn"))
    return grouped.select("conv_id", F.col("turn").alias("src"), before.alias("dst")).where("dst is not null")


def conversation_document(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (session > exchange > message) and reply edges of conversations (conv_id, turn, role, text)."""
    text = lambda prefix, *c: F.concat_ws("-", F.lit(prefix), *[F.col(x).cast("string") for x in c])
    grouped = exchanges(turns).join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    none = F.lit(None).cast("string")
    sessions = turns.select("conv_id").distinct().select(F.lit("conversations").alias("graph_id"), text("s", "conv_id").alias("id"), F.lit("conv:session").alias("kind"), F.col("conv_id").cast("string").alias("label"), text("gs", "conv_id").alias("detail_graph"))
    parts = grouped.groupBy("conv_id", "exchange").agg(F.min_by("text", "turn").alias("text")).select(text("gs", "conv_id").alias("graph_id"), text("x", "conv_id", "exchange").alias("id"), F.lit("conv:exchange").alias("kind"), excerpt(F.col("text")).alias("label"), text("gx", "conv_id", "exchange").alias("detail_graph"))
    messages = grouped.select(text("gx", "conv_id", "exchange").alias("graph_id"), text("m", "conv_id", "turn").alias("id"), F.concat(F.lit("conv:"), "role").alias("kind"), excerpt(F.col("text")).alias("label"), none.alias("detail_graph"))
    edges = replies(turns).join(exchanges(turns).select("conv_id", F.col("turn").alias("src"), "exchange"), ["conv_id", "src"])
    edges = edges.select(text("gx", "conv_id", "exchange").alias("graph_id"), text("r", "conv_id", "src").alias("id"), text("m", "conv_id", "src").alias("src"), text("m", "conv_id", "dst").alias("dst"), F.lit("conv:replies-to").alias("kind"))
    return sessions.unionByName(parts).unionByName(messages), edges


def sentences(text: Column) -> Column:
    """Sentences of a text, in order and as they stand: ended by marks before a space or the end."""
    return F.split(text, r"(?<=[.!?])\s+")


def essay(docs: DataFrame) -> DataFrame:
    """doc_id, n, start, length, sentence of essays (doc_id, text): where each sentence stands, in code points.

    Positions come from a running sum over the array, so no row leaves its task.
    """
    parts = sentences(F.col("text"))
    gaps = F.regexp_extract_all("text", F.lit(r"((?<=[.!?])\s+)"), 1)
    step = lambda a, x: F.struct((a["at"] + F.length(x["s"]) + F.coalesce(F.length(x["g"]), F.lit(0))).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), F.length(x["s"]).alias("length"), x["s"].alias("sentence")))).alias("out"))
    zipped = F.transform(F.arrays_zip(parts.alias("s"), gaps.alias("g")), lambda x: F.struct(x["s"].alias("s"), x["g"].alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,sentence:string>>").alias("out"))
    rows = docs.where("text <> ''").select("doc_id", F.posexplode(F.aggregate(zipped, start, step, lambda a: a["out"])).alias("n", "s"))
    return rows.where("s.length > 0").select("doc_id", F.col("n").cast("long").alias("n"), F.col("s.start").cast("long").alias("start"), F.col("s.length").cast("long").alias("length"), F.col("s.sentence").alias("sentence"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line, level, title, slug, parent_line of ATX headings in Markdown (doc_id, text), outside of fenced code.

    A heading's parent is the last one before it with a lower level; repeated slugs are numbered.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    order = Window.partitionBy("doc_id").orderBy("line")
    fenced = F.sum(F.col("raw").rlike(r"^ {0,3}(```|~~~)").cast("int")).over(order) % 2
    heads = lines.withColumn("fenced", fenced).where((F.col("fenced") == 0) & F.col("raw").rlike(r"^ {0,3}#{1,6}(\s|$)"))
    heads = heads.select("doc_id", "line", F.length(F.regexp_extract("raw", r"^ {0,3}(#{1,6})", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace("raw", r"^ {0,3}#{1,6}\s*", ""), r"\s+#+\s*$", "")).alias("title"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parents = F.array(*[F.struct(F.max(F.when(F.col("level") == k, F.col("line"))).over(before).alias("line"), F.lit(k).alias("k")) for k in range(1, 7)])
    parent = F.array_max(F.transform(F.filter(parents, lambda p: p["k"] < F.col("level")), lambda p: p["line"]))
    again = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("line")) - 1
    named = heads.withColumn("base", slug(F.col("title"))).withColumn("again", again)
    named = named.withColumn("slug", F.when(F.col("again") == 0, F.col("base")).otherwise(F.concat_ws("-", "base", "again")))
    return named.select("doc_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "title", "slug", parent.cast("long").alias("parent_line"))


def python_code(files: DataFrame) -> DataFrame:
    """path, qualified, kind (class or function), line, calls of Python sources (path, text); files that don't parse give none.

    Syntax needs a parser, so each file is read by one in Python; nothing is kept between files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    work = [((), node) for node in ast.parse(text).body]
                except (SyntaxError, ValueError, RecursionError):
                    continue
                while work:
                    scope, node = work.pop()
                    if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                        name = (*scope, node.name)
                        calls = sorted({c.func.id for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)})
                        out.append((path, ".".join(name), "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, calls))
                        work += [(name, inner) for inner in node.body]
            yield pd.DataFrame(out, columns=["path", "qualified", "kind", "line", "calls"])

    return files.select("path", "text").mapInPandas(run, "path string, qualified string, kind string, line long, calls array<string>")


def call_edges(symbols: DataFrame) -> DataFrame:
    """path, src, dst: calls that name exactly one function or class of the same file."""
    names = symbols.select("path", F.col("qualified").alias("dst"), F.element_at(F.split("qualified", r"\."), -1).alias("name"))
    one = names.groupBy("path", "name").agg(F.count("*").alias("n"), F.min("dst").alias("dst")).where("n = 1")
    return symbols.select("path", F.col("qualified").alias("src"), F.explode("calls").alias("name")).join(one, ["path", "name"]).where("src <> dst").select("path", "src", "dst")
