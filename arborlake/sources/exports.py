"""Chat exports, organization logs, projects of code, and which parser reads a source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "doc string, conversation string, place long, id string, parent string, role string, text string"


def arbitrate(scores: DataFrame) -> DataFrame:
    """uri, parser, code of sniffed scores (uri, parser, score): the best one; ambiguous-source on a tie, no-parser without any."""
    clamped = scores.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))))
    best = clamped.groupBy("uri").agg(F.max("score").alias("best"))
    top = clamped.join(best, "uri").groupBy("uri", "best").agg(F.count_if(F.col("score") == F.col("best")).alias("n"), F.min(F.when(F.col("score") == F.col("best"), F.col("parser"))).alias("parser"))
    code = F.when(F.col("best") <= 0, "no-parser").when(F.col("n") > 1, "ambiguous-source")
    return top.select("uri", F.when(code.isNull(), F.col("parser")).alias("parser"), code.alias("code"))


def media_type(path, head):
    """Column: a source's kind by its name, or binary if its first bytes hold a zero."""
    name = F.lower(path)
    known = (("md", "markdown"), ("markdown", "markdown"), ("json", "json"), ("py", "python"), ("txt", "text"))
    out = F.lit("text")
    for ending, kind in known:
        out = F.when(name.endswith("." + ending), kind).otherwise(out)
    return F.when(F.instr(head, "\x00") > 0, "binary").otherwise(out)


@F.pandas_udf(T.ArrayType(T.StringType()))
def preorder(keys: pd.Series, parents: pd.Series, children: pd.Series) -> pd.Series:
    """Parents first, children in their order. Roots, by key, are those without a parent or with one that isn't there; what no root
    reaches comes last, by key. Nothing comes twice."""

    def walk(keys: list, parents: list, children: list) -> list[str]:
        below = dict(zip(keys, children, strict=True))
        stack, out = sorted((k for k, p in zip(keys, parents, strict=True) if p not in below), reverse=True), []
        while stack:
            key = stack.pop()
            if key in below:
                out.append(key)
                kids = below.pop(key)
                stack += list(kids if kids is not None else [])[::-1]
        return out + sorted(below)

    return pd.Series([walk(*x) for x in zip(keys, parents, children, strict=True)], dtype=object)


def chat_messages(texts: DataFrame) -> DataFrame:
    """MESSAGES of exports (doc, text): lists of conversations with chat_messages, or trees of messages in a mapping.

    A tree is read parents first; siblings in the order of their ids' places under the parent; roots by id.
    """
    flat = "array<struct<uuid: string, chat_messages: array<struct<uuid: string, sender: string, text: string, parent_message_uuid: string, content: array<struct<type: string, text: string>>>>>>"
    rows = texts.where(F.ltrim("text").startswith("[")).select("doc", F.explode(F.from_json("text", flat)).alias("c")).select("doc", F.col("c.uuid").alias("conversation"), F.posexplode("c.chat_messages").alias("place", "m"))
    blocks = F.array_join(F.transform(F.filter("m.content", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    role = F.when(F.col("m.sender") == "human", "user").otherwise(F.col("m.sender"))
    first = rows.select("doc", "conversation", F.col("place").cast("long").alias("place"), F.col("m.uuid").alias("id"), F.col("m.parent_message_uuid").alias("parent"), role.alias("role"), F.when(F.length(blocks) > 0, blocks).otherwise(F.coalesce("m.text", F.lit(""))).alias("text"))
    tree = "struct<conversation_id: string, mapping: map<string, struct<id: string, parent: string, children: array<string>, message: struct<author: struct<role: string>, content: struct<parts: array<string>>>>>>"
    maps = texts.where(F.ltrim("text").startswith("{")).select("doc", F.from_json("text", tree).alias("c")).where("c.mapping is not null")
    # A tree comes in one row, so it is walked there, however deep; what has no message takes no place.
    values = F.map_values("c.mapping")
    walked = maps.withColumn("order", preorder(F.map_keys("c.mapping"), F.transform(values, lambda m: m["parent"]), F.transform(values, lambda m: m["children"])))
    told = F.filter("order", lambda k: F.element_at("c.mapping", k)["message"].isNotNull())
    out = walked.select("doc", F.col("c.conversation_id").alias("conversation"), "c", F.posexplode(told).alias("place", "key"))
    found = out.select("doc", "conversation", F.col("place").cast("long").alias("place"), "key", F.element_at("c.mapping", F.col("key")).alias("m"))
    second = found.select("doc", "conversation", "place", F.col("key").alias("id"), F.col("m.parent").alias("parent"), F.col("m.message.author.role").alias("role"), F.array_join("m.message.content.parts", "\n").alias("text"))
    return first.unionByName(second)


def assignment_states(events: DataFrame) -> DataFrame:
    """job, state, started, ended of event logs (job, at, ts, kind): the most telling kind decides; times are those of the first and
    the last event in the log's order."""
    rank = [("escalation", "escalated"), ("promotion", "promoted"), ("deliverable", "delivered"), ("question", "waiting")]
    state = F.lit("in_progress")
    for kind, name in reversed(rank):
        state = F.when(F.bool_or(F.col("kind") == kind), name).otherwise(state)
    return events.groupBy("job").agg(state.alias("state"), F.min_by("ts", "at").alias("started"), F.max_by("ts", "at").alias("ended"))


def directories(files: DataFrame) -> DataFrame:
    """path, parent, name of all directories and files of a project (path)."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    every = files.select(F.explode(prefixes).alias("path")).distinct()
    return every.select("path", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), F.substring_index("path", "/", -1).alias("name"))


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, module, target of dotted imports (path, module, level): the first of the files that it can mean, from the importing
    file's directory upwards for relative ones and from the root else; null if none is there."""
    own = F.regexp_replace("path", "(^|/)[^/]*$", "")
    dots = F.array_join(F.split("module", r"\."), "/")
    ups = F.split(own, "/")
    base = F.when(F.col("level") > 0, F.array_join(F.slice(ups, 1, F.greatest(F.size(ups) - F.col("level") + 1, F.lit(0))), "/")).otherwise(F.lit(""))
    stem = F.concat(base, F.when(base == "", "").otherwise("/"), dots)
    asked = imports.select("path", "module", "level", F.posexplode(F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))).alias("at", "candidate"))
    hit = asked.join(files.select(F.col("path").alias("candidate"), F.lit(True).alias("there")), "candidate", "left")
    return hit.groupBy("path", "module", "level").agg(F.min_by("candidate", F.when(F.col("there"), F.col("at"))).alias("target")).select("path", "module", "target")


def segments(names: DataFrame) -> DataFrame:
    """path, name, line, segment of declarations (path, name, signature, line): the name; with the signature where names repeat; and
    with a number where that repeats, too."""
    same = Window.partitionBy("path", "name")
    twin = Window.partitionBy("path", "name", "signature")
    number = F.row_number().over(twin.orderBy("line"))
    out = F.when(F.count("*").over(same) == 1, F.col("name")).when(F.count("*").over(twin) == 1, F.concat_ws("#", "name", "signature")).otherwise(F.concat(F.concat_ws("#", "name", "signature"), F.lit("~"), number.cast("string")))
    return names.select("path", "name", "line", out.alias("segment"))
