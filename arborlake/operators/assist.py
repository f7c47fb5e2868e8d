"""Recorded model calls as joins, budgets as running sums, and scores of what was extracted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def call_key(calls: DataFrame) -> DataFrame:
    """calls (prompt, version, input) with key: the hash that a recorded answer is found by."""
    return calls.withColumn("key", F.sha2(F.to_json(F.struct("prompt", "version", "input")), 256))


def replayed(calls: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with their recorded answers (key, answer), and the calls that have none."""
    keyed = call_key(calls)
    answers = recorded.groupBy("key").agg(F.min("answer").alias("answer"))
    return keyed.join(answers, "key"), keyed.join(answers, "key", "left_anti")


def budget_status(calls: DataFrame, limit: float, warn: float = 0.8) -> DataFrame:
    """session, seq, spent, status of calls (session, seq, cost): stopped if what was spent before reaches the limit; warned from a
    share of it on. A stopped call costs nothing, which ends the spending of its session."""
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    spent = calls.withColumn("before", F.coalesce(F.sum("cost").over(before), F.lit(0.0)))
    status = F.when(F.col("before") >= limit, "stopped").when(F.col("before") + F.col("cost") >= warn * limit, "warned").otherwise("ok")
    return spent.select("session", "seq", F.col("before").alias("spent"), status.alias("status"))


def sound(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposed nodes (request, at, id) and edges (request, src, dst) without repeated nodes and dangling edges, and request,
    dropped: how many of both went."""
    kept = nodes.groupBy("request", "id").agg(F.min("at").alias("at"))
    good = edges
    for c in ("src", "dst"):
        good = good.join(kept.select("request", F.col("id").alias(c)), ["request", c], "left_semi")
    count = lambda df, n: df.groupBy("request").agg(F.count("*").alias(n))
    lost = count(nodes, "a").join(count(kept, "b"), "request", "full").join(count(edges, "c"), "request", "full").join(count(good, "d"), "request", "full").na.fill(0)
    return kept, good.select("request", "src", "dst"), lost.select("request", (F.col("a") - F.col("b") + F.col("c") - F.col("d")).alias("dropped"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """id, f1 of the bags of words of two texts (id, a, b)."""
    bag = lambda c: pairs.select("id", F.explode(F.split(F.lower(F.col(c)), r"\s+")).alias("w")).where("w <> ''").groupBy("id", "w").agg(F.count("*").alias(c))
    both = bag("a").join(bag("b"), ["id", "w"], "full").na.fill(0, ["a", "b"])
    sums = both.groupBy("id").agg(F.sum(F.least("a", "b")).alias("same"), F.sum("a").alias("n"), F.sum("b").alias("m"))
    return pairs.select("id").join(sums, "id", "left").select("id", F.coalesce(2.0 * F.col("same") / (F.col("n") + F.col("m")), F.lit(0.0)).alias("f1"))


def greedy_match(scores: DataFrame, least: float = 0.4) -> DataFrame:
    """request, a, b, score: the best pairs first, each side used once; a request's pairs are sequential by nature."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, out = set(), set(), []
        for r in rows.sort_values(["score", "a", "b"], ascending=[False, True, True]).itertuples():
            if r.score >= least and r.a not in used_a and r.b not in used_b:
                used_a.add(r.a)
                used_b.add(r.b)
                out.append((r.request, r.a, r.b, r.score))
        return pd.DataFrame(out, columns=["request", "a", "b", "score"])

    return scores.groupBy("request").applyInPandas(run, "request string, a string, b string, score double")


def back_edge_ratio(edges: DataFrame) -> DataFrame:
    """graph_id, ratio: share of edges that a depth-first search in the order of ids finds leading back to an open node; loops count
    neither way, and a graph without other edges has 0. The order of a search is sequential, so each graph's edges are read by one
    task: meant for the edges of a cut, of which there are few (distinct pairs, with their numbers, are all that is sent)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        graph, rows = rows["graph_id"].iloc[0], rows[rows["src"] != rows["dst"]]
        out: dict[str, list[str]] = {}
        times = {(a, b): n for a, b, n in zip(rows["src"], rows["dst"], rows["n"], strict=True)}
        for a, b in sorted(times):
            out.setdefault(a, []).append(b)
        state: dict[str, int] = {}
        back = 0
        for start in sorted(set(rows["src"]) | set(rows["dst"])):
            if start in state:
                continue
            state[start] = 1
            stack: list[tuple[str, Iterator[str]]] = [(start, iter(out.get(start, [])))]
            while stack:
                node, rest = stack[-1]
                for to in rest:
                    if state.get(to) == 1:
                        back += times[node, to]
                    elif to not in state:
                        state[to] = 1
                        stack.append((to, iter(out.get(to, []))))
                        break
                else:
                    state[node] = 2
                    stack.pop()
        return pd.DataFrame([(graph, back / total if (total := sum(times.values())) else 0.0)], columns=["graph_id", "ratio"])

    pairs = edges.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("n"))
    return pairs.groupBy("graph_id").applyInPandas(run, "graph_id string, ratio double")


def layout_choice(shape: DataFrame) -> DataFrame:
    """graph_id, provider by a graph's shape (graph_id, nodes, edges, components, back, degree): grid for one node or no edge, tree for
    a forest, layered if hardly an edge leads back and the mean degree is low, force else."""
    # The share of back edges and the mean degree up to which a graph is layered.
    most_back, most_degree = 0.05, 6
    layered = (F.col("back") <= most_back) & (F.col("degree") <= most_degree)
    choice = F.when((F.col("nodes") <= 1) | (F.col("edges") == 0), "grid").when(F.col("edges") == F.col("nodes") - F.col("components"), "tree").when(layered, "layered").otherwise("force")
    return shape.select("graph_id", choice.alias("provider"))


def label_plan(items: DataFrame, cell: float = 8.0, most: int = 512) -> DataFrame:
    """view, id of the labels that are shown (view, id, rank, leaves, degree, x, y, w, h): in order of rank, then fewer leaves and
    degrees, then id, each if its cells are free. A view's plan is sequential and bounded by what fits on a screen."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for r in rows.sort_values(["rank", "leaves", "degree", "id"], ascending=[True, False, False, True]).itertuples():
            cells = {(i, j) for i in range(int(r.x // cell), int((r.x + r.w) // cell) + 1) for j in range(int(r.y // cell), int((r.y + r.h) // cell) + 1)}
            if len(out) < most and not cells & taken:
                taken |= cells
                out.append((r.view, r.id))
        return pd.DataFrame(out, columns=["view", "id"])

    return items.groupBy("view").applyInPandas(run, "view string, id string")
