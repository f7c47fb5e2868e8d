"""One request for a level of detail: from a zoom to the cut, its edges, what can be done next, and why it is so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Space
from ..plans.scratch import written
from . import cut, forest, induced


@dataclass(frozen=True)
class Request:
    """zoom from 0 (coarsest) to 1; overrides (id, kind), cold (graph_id) and recency (id, recency) are DataFrames or None."""

    zoom: float
    overrides: DataFrame | None = None
    cold: DataFrame | None = None
    focus: str | None = None
    level_before: int | None = None
    max_nodes: int | None = None
    fan_out: int = induced.FAN_OUT
    recency: DataFrame | None = None


@dataclass(frozen=True)
class Resolution:
    level: int
    nominal: int
    levels: list[str]
    #: id, graph_id, depth, reason, covered_leaves
    members: DataFrame
    edges: DataFrame
    capped: DataFrame
    residuals: DataFrame
    frontier: DataFrame
    #: id, kind, reason
    ignored: DataFrame
    #: The cut couldn't be made as small as was asked.
    exceeded: bool


def level_chain(depth: int, declared: list[str] | None = None) -> list[str]:
    """Names of the levels of a forest (depth: of its deepest node, -1 if there is none): the declared ones, if they reach that deep."""
    if declared is not None and len(declared) > depth:
        return list(declared)
    return [f"level-{k}" for k in range(depth + 1)]


def resolve(space: Space, request: Request, declared: list[str] | None = None, steps: list[float] | None = None, tree: DataFrame | None = None) -> Resolution:
    """What a request shows. steps are the zooms at which levels begin (evenly spaced, if not given); tree is the space's forest with
    measures, if it is known.

    The cut follows the overrides (cut.override_cut). If more members are left than max_nodes, the least salient parts are rolled up;
    pins, expanded nodes and the way to the focus stay, even if the cut is too large then (exceeded).
    """
    spark = space.nodes.sparkSession
    tree = written(forest.forest(space), "resolve-forest") if tree is None else tree
    levels = level_chain(forest.max_depth(tree).first()[0], declared)
    steps = cut.thresholds(max(0, len(levels) - 1)) if steps is None else steps
    if any(b <= a for a, b in zip([0.0, *steps], [*steps, 1.0], strict=True)):
        raise ValueError("steps rise between 0 and 1")
    level, nominal = cut.level_for_zoom(min(1.0, max(0.0, request.zoom)), steps[: max(0, len(levels) - 1)], request.level_before)
    overrides = spark.createDataFrame([], "id string, kind string") if request.overrides is None else request.overrides
    marks, ignored = cut.effective_overrides(tree, overrides)
    members = written(cut.override_cut(tree, level, overrides, request.cold), "resolve-members")
    protected = marks.where("override in ('pin', 'expand')").select("id")
    if request.focus is not None:
        protected = protected.unionByName(tree.where(F.col("id") == request.focus).select("id"))
    exceeded = False
    if request.max_nodes is not None:
        members = _within_budget(space, tree, members, request, protected)
        exceeded = members.count() > request.max_nodes
    edges = written(induced.induced_edges(space.edges, induced.node_cover(tree, members)), "resolve-edges")
    capped, residuals = induced.cap_fan_out(edges, request.fan_out)
    return Resolution(level, nominal, levels, members, edges, capped, residuals, cut.frontier(tree, members, protected, request.cold), ignored, exceeded)


def _within_budget(space: Space, tree: DataFrame, members: DataFrame, request: Request, protected: DataFrame) -> DataFrame:
    """Salience is over the members and all nodes above them."""
    everyone = cut._on_the_way(tree, members, True)
    measures = tree.join(everyone, "id", "left_semi").select("id", F.col("leaves").alias("size")).join(forest.incident_degree(space), "id")
    recency = request.recency if request.recency is not None else tree.select("id", F.lit(None).cast("double").alias("recency")).limit(0)
    scores = cut.salience(measures.join(recency.select("id", "recency"), "id", "left"))
    small = cut.budget_cut(tree, members, scores, request.max_nodes, protected)
    known = tree.select("id", "graph_id", F.col("leaves").alias("covered_leaves"))
    reasons = members.select("id", F.col("reason").alias("was"))
    out = small.join(known, "id").join(reasons, "id", "left")
    return written(out.select("id", "graph_id", "depth", F.when(F.col("reason") == "budget", "budget").otherwise(F.col("was")).alias("reason"), "covered_leaves"), "resolve-small")
