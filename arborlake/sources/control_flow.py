"""Control flow of Python functions: basic blocks and the labelled flows between them, and what follows from them.

Syntax needs a parser, so a file's functions are cut into blocks by one in Python, each by itself. All else is over tables:
reach, loops, complexity, and the operations that put a function's blocks below its node.

Blocks are numbered in the order in which they come up: what follows a compound statement first (where branches join, what is
after a loop), then its parts. A return, break, continue or exception that leaves a protected part goes through its finalizer.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import derived_id

BLOCK = "struct<block: string, role: string, first_line: int, last_line: int, statements: int>"
FLOW = "struct<src: string, dst: string, label: string>"
ENTRY, EXIT = "entry", "exit"


class Flow:
    """Blocks and flows of one function's statements."""

    def __init__(self, body: list[ast.stmt]) -> None:
        self.lines: dict[str, list[int]] = {ENTRY: []}
        self.flows: dict[tuple[str, str, str], None] = {}
        #: What encloses the current statement, outermost first: ("loop", head, after), ("handlers", blocks), ("finally", block, labels).
        self.around: list[tuple] = []
        last = self._run(body, ENTRY)
        if last is not None:
            self._flow(last, EXIT, "seq")
        self.lines[EXIT] = []

    def _block(self) -> str:
        key = str(len(self.lines) - 1)
        self.lines[key] = []
        return key

    def _flow(self, src: str, dst: str, label: str) -> None:
        self.flows[src, dst, label] = None

    def _leave(self, src: str, label: str) -> None:
        """A jump out of src: to the first thing around that takes it, else to the exit."""
        for kind, *at in reversed(self.around):
            if kind == "finally":
                self._flow(src, at[0], label)
                at[1].append(label)
                return
            if kind == "handlers" and label == "exception":
                for block in at[0]:
                    self._flow(src, block, label)
                return
            if kind == "loop" and label in ("break", "continue"):
                self._flow(src, at[1] if label == "break" else at[0], label)
                return
        self._flow(src, EXIT, label)

    def _within(self, frame: tuple, body: list[ast.stmt], block: str) -> str | None:
        self.around.append(frame)
        last = self._run(body, block)
        self.around.pop()
        return last

    def _run(self, body: list[ast.stmt], at: str | None) -> str | None:
        """The block in which the statements end; None if control doesn't get there. What is never reached has blocks of its own."""
        for stmt in body:
            if at is None:
                at = self._block()
            match stmt:
                case ast.With() | ast.AsyncWith():
                    at = self._run(stmt.body, at)
                case ast.If():
                    at = self._branch(stmt, at)
                case ast.While() | ast.For() | ast.AsyncFor():
                    at = self._loop(stmt, at)
                case ast.Match():
                    at = self._cases(stmt, at)
                case ast.Try() | ast.TryStar():
                    at = self._protected(stmt, at)
                case _:
                    self.lines[at] += [stmt.lineno, stmt.end_lineno]
                    label = {ast.Return: "return", ast.Break: "break", ast.Continue: "continue", ast.Raise: "exception"}.get(type(stmt))
                    if label:
                        self._leave(at, label)
                        at = None
        return at

    def _join(self, last: str | None, after: str, label: str = "seq") -> None:
        if last is not None:
            self._flow(last, after, label)

    def _branch(self, stmt: ast.If, at: str) -> str:
        after, then = self._block(), self._block()
        self._flow(at, then, "true")
        other = self._block() if stmt.orelse else after
        self._flow(at, other, "false")
        self._join(self._run(stmt.body, then), after)
        if stmt.orelse:
            self._join(self._run(stmt.orelse, other), after)
        return after

    def _loop(self, stmt: ast.While | ast.For | ast.AsyncFor, at: str) -> str:
        """An else part of a loop is left out."""
        head, inner, after = self._block(), self._block(), self._block()
        self._flow(at, head, "seq")
        self._flow(head, inner, "true")
        self._flow(head, after, "false")
        self._join(self._within(("loop", head, after), stmt.body, inner), head, "loop")
        return after

    def _cases(self, stmt: ast.Match, at: str) -> str:
        after, blocks = self._block(), [self._block() for _ in stmt.cases]
        for case, block in zip(stmt.cases, blocks, strict=True):
            self._flow(at, block, "true")
            self._join(self._run(case.body, block), after)
        if not any(isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None and c.pattern.name is None for c in stmt.cases):
            self._flow(at, after, "false")
        return after

    def _protected(self, stmt: ast.Try | ast.TryStar, at: str) -> str:
        after = self._block()
        final = self._block() if stmt.finalbody else None
        body, handlers = self._block(), [self._block() for _ in stmt.handlers]
        pending: list[str] = []
        done, label = (final, "finally") if final else (after, "seq")
        if final:
            self.around.append(("finally", final, pending))
        self._flow(at, body, "seq")
        for block in handlers or [final]:
            self._flow(body, block, "exception")
        last = self._within(("handlers", handlers), stmt.body, body) if handlers else self._run(stmt.body, body)
        if last is not None and stmt.orelse:
            other = self._block()
            self._flow(last, other, "seq")
            last = self._run(stmt.orelse, other)
        self._join(last, done, label)
        for handler, block in zip(stmt.handlers, handlers, strict=True):
            self._join(self._run(handler.body, block), done, label)
        if final:
            self.around.pop()
            last = self._run(stmt.finalbody, final)
            if last is not None:
                for jump in dict.fromkeys(pending):
                    self._leave(last, jump)
                if any(dst == final and how == "finally" for _, dst, how in self.flows):
                    self._flow(last, after, "seq")
        return after

    def blocks(self) -> list[tuple]:
        role = lambda k: k if k in (ENTRY, EXIT) else "block"
        return [(k, role(k), min(x, default=None), max(x, default=None), len(x) // 2) for k, x in self.lines.items()]


def _functions(text: str) -> Iterator[tuple[str, int, int, Flow]]:
    """Name with its scopes, first line, last line and flow of every function and method, nested ones too, in the order of the text."""
    work = [((), node) for node in reversed(ast.parse(text).body)]
    while work:
        scope, node = work.pop()
        inner = (*scope, node.name) if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else scope
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            yield ".".join(inner), node.lineno, node.end_lineno, Flow(node.body)
        work += [(inner, child) for child in reversed(list(ast.iter_child_nodes(node))) if isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case)]


def functions(files: DataFrame) -> DataFrame:
    """path, function, nth, line, end_line, blocks, flows of Python sources (path, text); files that don't parse, and null texts, give none.

    nth counts functions of one qualified name in a file from 0. Other columns are not returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                seen: dict[str, int] = {}
                try:
                    found = list(_functions(text))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for name, line, end, flow in found:
                    out.append((path, name, seen.get(name, 0), line, end, flow.blocks(), list(flow.flows)))
                    seen[name] = seen.get(name, 0) + 1
            yield pd.DataFrame(out, columns=["path", "function", "nth", "line", "end_line", "blocks", "flows"])

    given = files.where("text is not null").select("path", "text")
    return given.mapInPandas(run, f"path string, function string, nth int, line int, end_line int, blocks array<{BLOCK}>, flows array<{FLOW}>")


def blocks(found: DataFrame) -> DataFrame:
    """path, function, nth, block, role, first_line, last_line, statements of functions()."""
    return found.select("path", "function", "nth", F.inline("blocks"))


def flows(found: DataFrame) -> DataFrame:
    """path, function, nth, src, dst, label of functions()."""
    return found.select("path", "function", "nth", F.inline("flows"))


def complexity(found: DataFrame) -> DataFrame:
    """path, function, nth, blocks, flows, loops (flows back to a head), exits, and cyclomatic (flows - blocks + 2), by function."""
    count = lambda test: F.size(F.filter("flows", test)).cast("long")
    n, m = F.size("blocks").cast("long"), F.size("flows").cast("long")
    return found.select("path", "function", "nth", n.alias("blocks"), m.alias("flows"), count(lambda f: f["label"].isin("loop", "continue")).alias("loops"), count(lambda f: f["dst"] == EXIT).alias("exits"), (m - n + 2).alias("cyclomatic"))


def unreached(found: DataFrame) -> DataFrame:
    """path, function, nth, block of blocks that no way from the entry leads to.

    A function's flows are all in its row, so each row is walked by itself, in time linear in its flows, and nothing is shuffled.
    """
    key = ["path", "function", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flows, blocks = batch.column("flows"), batch.column("blocks")
            ends, names = ([x.to_pylist() for x in c.flatten().flatten()] for c in (flows, blocks))
            at, first, out = 0, 0, []
            for n, m in zip(*(pc.fill_null(pc.list_value_length(c), 0).to_pylist() for c in (flows, blocks)), strict=True):
                out.append(_not_reached(ends[0][at : at + n], ends[1][at : at + n], names[0][first : first + m], names[1][first : first + m]))
                at, first = at + n, first + m
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(out, pa.list_(pa.string()))], [*key, "left"])

    slim = lambda c, *fields: F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(c)
    rows = found.select(*key, slim("blocks", "block", "role"), slim("flows", "src", "dst"))
    left = rows.mapInArrow(run, "path string, function string, nth int, left array<string>")
    return left.select(*key, F.explode("left").alias("block"))


def _not_reached(srcs: list[str], dsts: list[str], names: list[str], roles: list[str]) -> list[str]:
    after: dict[str, list[str]] = {}
    for src, dst in zip(srcs, dsts, strict=True):
        after.setdefault(src, []).append(dst)
    work = [name for name, role in zip(names, roles, strict=True) if role == ENTRY]
    reached = set(work)
    while work:
        for block in after.get(work.pop(), ()):
            if block not in reached:
                reached.add(block)
                work.append(block)
    return [name for name, role in zip(names, roles, strict=True) if role == "block" and name not in reached]


def body_operations(found: DataFrame, domain: str = "code") -> DataFrame:
    """path, function, nth and operations (phase, t, graph_id, id, key, prev, next) that put each function's blocks below its node.

    A graph for the function, a node for each block and an edge for each flow; then the function's node gets that graph as its
    detail. Ids are derived from path, scopes and block, so they are the same however often a body is read.
    """
    key = ["path", "function", "nth"]
    scopes = F.split(F.concat("function", F.when(F.col("nth") > 0, F.concat(F.lit("~"), "nth")).otherwise("")), r"\.")
    at = [F.lit(domain), F.col("path"), scopes]
    outer = F.slice(scopes, F.lit(1), F.size(scopes) - 1)
    base = found.select(*key, "blocks", "flows", derived_id("g", *at).alias("graph_id"), derived_id("n", *at).alias("node"), derived_id("g", F.lit(domain), F.col("path"), outer).alias("parent"))
    none = F.lit(None).cast("string")
    block_id = lambda graph, block: derived_id("n", graph, F.lit("block"), block)
    meta = F.to_json(F.struct(F.concat("function", F.lit(" · control-flow")).alias("label"), F.lit(domain).alias("domain"), F.lit("source").alias("origin")))

    # All operations of a function are unfolded from its row at once, so files are parsed once and not for each kind of operation.
    row = lambda t, block=none, role=none, src=none, dst=none, label=none: F.struct(F.lit(t).alias("t"), block.alias("block"), role.alias("role"), src.alias("src"), dst.alias("dst"), label.alias("label"))
    nodes = F.transform("blocks", lambda b: row("node:add", block=b["block"], role=b["role"]))
    edges = F.transform("flows", lambda f: row("edge:add", src=f["src"], dst=f["dst"], label=f["label"]))
    each = base.select(*key, "graph_id", "node", "parent", meta.alias("meta"), F.inline(F.concat(F.array(row("graph:add")), nodes, edges, F.array(row("node:detail")))))
    g, t = F.col("graph_id"), F.col("t")
    by = lambda graph, detail, add, link: F.when(t == "graph:add", graph).when(t == "node:detail", detail).when(t == "node:add", add).otherwise(link)
    edge = t == "edge:add"
    each = each.withColumns({"src": F.when(edge, block_id(g, F.col("src"))), "dst": F.when(edge, block_id(g, F.col("dst")))})
    each = each.withColumn("id", by(g, F.col("node"), block_id(g, F.col("block")), derived_id("e", g, F.lit(f"{domain}:flows-to"), F.col("src"), F.col("dst"), F.col("label"))))
    attrs = F.create_map(F.lit(f"{domain}:block-role"), F.concat(F.lit('"'), "role", F.lit('"')))
    said = F.create_map(F.lit(f"{domain}:flow"), F.concat(F.lit('"'), "label", F.lit('"')))
    node = F.to_json(F.struct("graph_id", "id", F.lit(f"{domain}:block").alias("kind"), F.col("block").alias("label"), attrs.alias("attrs"), F.lit("source").alias("origin")))
    link = F.to_json(F.struct("graph_id", "id", "src", "dst", F.lit(f"{domain}:flows-to").alias("kind"), said.alias("attrs"), F.lit("source").alias("origin")))
    phase = by(F.lit(4), F.lit(7), F.lit(6), F.lit(9))
    holder = F.when(t == "node:detail", F.col("parent")).otherwise(g)
    return each.select(*key, phase.alias("phase"), "t", holder.alias("graph_id"), "id", none.alias("key"), none.alias("prev"), by(F.col("meta"), g, node, link).alias("next"))
