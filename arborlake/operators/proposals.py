"""Proposals that regroup nodes under new ones, and simple providers of such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import derived_id
from ..model import Space
from ..plans.scratch import written
from .shape import components, hub_satellites


def by_attribute(space: Space, kind: str, key: str) -> DataFrame:
    """group, label, member, confidence: nodes of a kind in one graph with an equal attribute."""
    value = F.try_element_at("attrs", F.lit(key))
    rows = space.nodes.where((F.col("kind") == kind) & value.isNotNull()).withColumn("value", value)
    return rows.select(derived_id("n", F.lit("group"), F.col("graph_id"), F.col("value")).alias("group"), F.col("value").alias("label"), F.col("id").alias("member"), F.lit(1.0).alias("confidence"))


def by_components(space: Space, graph: str) -> DataFrame:
    """Components of two nodes or more in one graph."""
    label = components(space.edges.where(F.col("graph_id") == graph))
    return label.select(derived_id("n", F.lit("component"), F.col("component")).alias("group"), F.concat(F.lit("around "), "component").alias("label"), F.col("id").alias("member"), F.lit(1.0).alias("confidence"))


def by_hubs(space: Space, graph: str) -> DataFrame:
    """Each hub with its satellites."""
    found = hub_satellites(space.edges.where(F.col("graph_id") == graph))
    both = found.select("hub", F.col("satellite").alias("member")).unionByName(found.select("hub", F.col("hub").alias("member"))).distinct()
    return both.select(derived_id("n", F.lit("hub"), F.col("hub")).alias("group"), F.concat(F.lit("around "), "hub").alias("label"), "member", F.lit(1.0).alias("confidence"))


def refusals(space: Space, proposal: DataFrame) -> DataFrame:
    """group, code: why a group can't be applied: unknown-member, crosses-graphs, member-twice, crosses-boundary (an edge leaves it
    for a node of its graph outside of all groups) or too-small."""
    known = proposal.join(space.nodes.select(F.col("id").alias("member"), "graph_id"), "member", "left")
    sizes = known.groupBy("group").agg(F.count_if(F.col("graph_id").isNull()).alias("lost"), F.countDistinct("graph_id").alias("graphs"), F.countDistinct("member").alias("members"))
    twice = proposal.groupBy("member").agg(F.countDistinct("group").alias("n")).where("n > 1")
    again = proposal.join(twice, "member", "left_semi").select("group", F.lit("member-twice").alias("code")).distinct()
    of = proposal.groupBy("member").agg(F.min("group").alias("g"))
    ends = space.edges.join(of.select(F.col("member").alias("src"), F.col("g").alias("a")), "src", "left").join(of.select(F.col("member").alias("dst"), F.col("g").alias("b")), "dst", "left")
    out = ends.where("not (a <=> b)").select(F.explode(F.array("a", "b")).alias("group")).where("group is not null").distinct().select("group", F.lit("crosses-boundary").alias("code"))
    code = F.when(F.col("lost") > 0, "unknown-member").when(F.col("graphs") > 1, "crosses-graphs").when(F.col("members") < 2, "too-small")
    return sizes.select("group", code.alias("code")).where("code is not null").unionByName(again).unionByName(out)


def operations(space: Space, proposal: DataFrame, least: float = 0.0) -> DataFrame:
    """Operations that put each group's members, and the edges between them, into a new detail graph under a new node. Groups that
    are refused, or with a confidence below least (null counts as none), are left out."""
    proposal = written(proposal, "proposal")
    sure = proposal.groupBy("group").agg(F.min(F.coalesce("confidence", F.lit(-1.0))).alias("c")).where(F.col("c") >= least).select("group")
    good = proposal.join(sure, "group", "left_semi").join(refusals(space, proposal).select("group"), "group", "left_anti").select("group", "label", "member").distinct()
    good = written(good, "proposal-good")
    inside = F.concat(F.lit("g"), F.substring("group", 2, 99))
    members = good.join(space.nodes.withColumnRenamed("label", "name").select("graph_id", F.col("id").alias("member"), "kind", "name", "detail_graph", "attrs", "origin"), "member")
    row = lambda graph: F.to_json(F.struct(graph.alias("graph_id"), F.col("member").alias("id"), "kind", F.col("name").alias("label"), "detail_graph", "attrs", "origin"))
    op = lambda df, phase, t, graph, id_, prev, next_: df.select(F.lit(phase).alias("phase"), F.lit(t).alias("t"), graph.alias("graph_id"), id_.alias("id"), F.lit(None).cast("string").alias("key"), prev.cast("string").alias("prev"), next_.cast("string").alias("next"))
    none = F.lit(None)
    groups = members.groupBy("group").agg(F.min("label").alias("label"), F.min("graph_id").alias("graph_id"))
    new_node = F.to_json(F.struct("graph_id", F.col("group").alias("id"), F.lit("core:group").alias("kind"), "label", inside.alias("detail_graph"), F.lit("ai").alias("origin")))
    edges = space.edges.join(good.select(F.col("member").alias("src"), F.col("group").alias("a")), "src").join(good.select(F.col("member").alias("dst"), F.col("group").alias("b")), "dst").where("a = b").withColumn("group", F.col("a"))
    edge = lambda graph: F.to_json(F.struct(graph.alias("graph_id"), "id", "src", "dst", "kind", "weight", "attrs", "origin"))
    parts = [
        op(edges, 1, "edge:remove", F.col("graph_id"), F.col("id"), edge(F.col("graph_id")), none),
        op(members, 2, "node:remove", F.col("graph_id"), F.col("member"), row(F.col("graph_id")), none),
        op(groups, 4, "graph:add", inside, inside, none, F.to_json(F.struct("label", F.lit("core").alias("domain"), F.lit("ai").alias("origin")))),
        op(groups, 6, "node:add", F.col("graph_id"), F.col("group"), none, new_node),
        op(members, 6, "node:add", inside, F.col("member"), none, row(inside)),
        op(edges, 9, "edge:add", inside, F.col("id"), none, edge(inside)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
