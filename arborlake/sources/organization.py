"""Organizations and their runs as graph rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exports import assignment_states

DEFINITION = "struct<org_id: string, teams: array<struct<id: string, name: string, roles: array<struct<id: string, name: string>>>>, workflow: array<struct<from: string, to: string, kind: string>>, gates: array<struct<from: string, by: string>>>"
RUN = "struct<job_id: string, role: string, events: array<struct<ts: string, kind: string>>>"
BUNDLE = f"struct<schema_version: int, definition: {DEFINITION}, runs: array<{RUN}>>"


def bundles(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed bundles (doc, b), and doc, code of the texts (doc, text) that aren't one: malformed-json or structural."""
    rows = texts.withColumns({"b": F.from_json("text", BUNDLE), "ok": F.try_parse_json("text").isNotNull()})
    code = F.when(~F.col("ok"), "malformed-json").when(F.col("b.definition.org_id").isNull(), "structural")
    rows = rows.select("doc", "b", code.alias("code"))
    return rows.where("code is null").select("doc", "b"), rows.where("code is not null").select("doc", "code")


def document(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, id, kind, label, detail_graph) and edges (graph_id, id, src, dst, kind) of bundles: an organization holds
    teams, a team its roles, a role its assignments, an assignment its events. Runs without a known role belong to a team and role
    that stand for none ("_direct").

    Links of the workflow join roles of one team; between teams they are moved up to the teams, and equal ones are numbered.
    """
    none = F.lit(None).cast("string")
    path = lambda *parts: F.concat_ws("/", *[F.lit(p) if isinstance(p, str) and p.startswith("=") else F.col(p) if isinstance(p, str) else p for p in parts])
    org = parsed.select("doc", F.col("b.definition.org_id").alias("org"), "b")
    teams = org.select("doc", "org", F.explode("b.definition.teams").alias("t")).select("doc", "org", F.col("t.id").alias("team"), F.coalesce("t.name", "t.id").alias("label"), F.col("t.roles").alias("roles"))
    roles = teams.select("doc", "org", "team", F.explode("roles").alias("r")).select("doc", "org", "team", F.col("r.id").alias("role"), F.coalesce("r.name", "r.id").alias("label"))
    runs = org.select("doc", "org", F.explode("b.runs").alias("r")).select("doc", "org", F.col("r.job_id").alias("job"), F.col("r.role").alias("asked"), F.col("r.events").alias("events"))
    known = roles.groupBy("doc", F.col("role").alias("asked")).agg(F.min("team").alias("team"))
    owned = runs.join(known, ["doc", "asked"], "left").withColumns({"role": F.when(F.col("team").isNull(), "_direct").otherwise(F.col("asked")), "team": F.coalesce("team", F.lit("_direct"))})
    direct = owned.where("team = '_direct'").select("doc", "org").distinct()
    teams = teams.select("doc", "org", "team", "label").unionByName(direct.withColumns({"team": F.lit("_direct"), "label": F.lit("direct")}))
    roles = roles.unionByName(direct.withColumns({"team": F.lit("_direct"), "role": F.lit("_direct"), "label": F.lit("direct")}))
    log = owned.select("doc", "org", "team", "role", "job", F.posexplode("events").alias("at", "e"))
    states = assignment_states(log.select(path("doc", "job").alias("job"), "at", F.col("e.ts").alias("ts"), F.col("e.kind").alias("kind"))).withColumnRenamed("job", "key")
    work = owned.withColumn("key", path("doc", "job")).join(states, "key", "left")
    node = lambda df, graph, id_, kind, label, detail: df.select(graph.alias("graph_id"), id_.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), detail.alias("detail_graph"))
    nodes = reduce(
        DataFrame.unionByName,
        [
            node(org, F.lit("organizations"), path("doc", "org"), "org:organization", F.col("org"), F.concat(F.lit("in:"), path("doc", "org"))),
            node(teams, F.concat(F.lit("in:"), path("doc", "org")), path("doc", "org", "team"), "org:team", F.col("label"), F.concat(F.lit("in:"), path("doc", "org", "team"))),
            node(roles, F.concat(F.lit("in:"), path("doc", "org", "team")), path("doc", "org", "team", "role"), "org:role", F.col("label"), F.concat(F.lit("in:"), path("doc", "org", "team", "role"))),
            node(work, F.concat(F.lit("in:"), path("doc", "org", "team", "role")), path("doc", "org", "team", "role", "job"), "org:assignment", F.concat_ws(" ", "job", F.coalesce("state", F.lit("in_progress"))), F.concat(F.lit("in:"), path("doc", "org", "team", "role", "job"))),
            node(log, F.concat(F.lit("in:"), path("doc", "org", "team", "role", "job")), path("doc", "org", "team", "role", "job", F.col("at").cast("string")), "org:event", F.col("e.kind"), none),
        ],
    )
    flows = org.select("doc", "org", F.explode("b.definition.workflow").alias("w")).select("doc", "org", F.col("w.from").alias("a"), F.col("w.to").alias("b"), F.coalesce("w.kind", F.lit("then")).alias("kind"))
    gates = org.select("doc", "org", F.explode("b.definition.gates").alias("w")).select("doc", "org", F.col("w.from").alias("a"), F.col("w.by").alias("b"), F.lit("reviewed-by").alias("kind"))
    ends = flows.unionByName(gates)
    for c in ("a", "b"):
        ends = ends.join(known.select("doc", F.col("asked").alias(c), F.col("team").alias(f"team_{c}")), ["doc", c])
    same = F.col("team_a") == F.col("team_b")
    links = ends.select(
        F.concat(F.lit("in:"), F.when(same, path("doc", "org", "team_a")).otherwise(path("doc", "org"))).alias("graph_id"),
        F.when(same, path("doc", "org", "team_a", "a")).otherwise(path("doc", "org", "team_a")).alias("src"),
        F.when(same, path("doc", "org", "team_b", "b")).otherwise(path("doc", "org", "team_b")).alias("dst"),
        F.concat(F.lit("org:"), "kind").alias("kind"), "a", "b",
    ).where("src <> dst")
    number = F.row_number().over(Window.partitionBy("graph_id", "src", "dst", "kind").orderBy("a", "b"))
    edges = links.select("graph_id", F.concat_ws("|", "kind", "src", "dst", number.cast("string")).alias("id"), "src", "dst", "kind")
    return nodes, edges
