"""Constraint queries: one for each kind of issue, as rows code, graph_id, element_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, nfc
from ..model import Space
from .forest import containment_index, containment_paths, derived_roots

KIND = r"^[a-z][a-z0-9-]*:[a-z][a-z0-9-]*$"  # fixed value
ORIGINS = ["source", "derived", "ai"]  # fixed values
#: Canonical JSON of an attribute's value by its declared type; lists are of scalars of one type, and an empty one fits any.
SCALARS = {"string": r'"(?:[^"\\]++|\\.)*+"', "number": r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?", "boolean": "(?:true|false)"}
TYPES = SCALARS | {"null": "null"} | {f"{t}-array": rf"\[(?:{x}(?:,{x})*+)?\]" for t, x in SCALARS.items()}
VALUE = "^(?:" + "|".join(TYPES.values()) + ")$"


def _issues(df: DataFrame, code: str, graph: Column, element: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), graph.alias("graph_id"), element.alias("element_id"))


def duplicate_ids(space: Space) -> DataFrame:
    """Ids that are used more than once over graphs, nodes and edges; one issue for each use too many."""
    every = space.graphs.select("id").unionByName(space.nodes.select("id")).unionByName(space.edges.select("id"))
    again = every.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return _issues(again.select("id", F.explode(F.sequence(F.lit(2), F.col("n")))), "duplicate-id", F.lit(None).cast("string"), F.col("id"))


def dangling_details(space: Space) -> DataFrame:
    lost = space.nodes.where("detail_graph is not null").join(space.graphs.select(F.col("id").alias("detail_graph")), "detail_graph", "left_anti")
    return _issues(lost, "dangling-detail-ref", F.col("graph_id"), F.col("id"))


def dangling_endpoints(space: Space) -> DataFrame:
    """Edges with an end that isn't a node of the same graph; one issue for each such end."""
    ends = space.edges.select("graph_id", "id", F.explode(F.array("src", "dst")).alias("end"))
    lost = ends.join(space.nodes.select("graph_id", F.col("id").alias("end")), ["graph_id", "end"], "left_anti")
    return _issues(lost, "dangling-edge-endpoint", F.col("graph_id"), F.col("id"))


def multiple_containment(space: Space) -> DataFrame:
    """Nodes that claim a detail graph after the first claimant (by graph and id)."""
    order = F.row_number().over(Window.partitionBy("detail_graph").orderBy("graph_id", "id"))
    return _issues(space.nodes.where("detail_graph is not null").withColumn("n", order).where("n > 1"), "multiple-containment", F.col("graph_id"), F.col("id"))


def containment_cycles(space: Space) -> DataFrame:
    """One issue for each cycle, at its least graph: graphs that no root reaches, less those that only hang on a cycle."""
    steps = containment_index(space).select(F.col("in_graph").alias("a"), F.col("graph").alias("b"))
    left = steps.join(containment_paths(space).select(F.col("graph").alias("b")), "b", "left_anti").select("a", "b")
    while True:  # graphs without anything inside that is still in doubt aren't on a cycle
        fewer = left.join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        if fewer.count() == left.count():
            break
        from ..plans.scratch import written

        left = written(fewer, "cycles")
    from .shape import components

    label = components(left.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return _issues(label.groupBy("component").agg(F.min("id").alias("id")), "containment-cycle", F.col("id"), F.lit(None).cast("string"))


def root_mismatches(space: Space) -> DataFrame:
    """Roots that are stated but not derived, derived but not stated, or stated twice."""
    if space.roots is None:
        return _issues(space.graphs.limit(0), "root-mismatch", F.col("id"), F.col("id"))
    stated = space.roots.groupBy("id").agg(F.count("*").alias("n"))
    both = stated.join(derived_roots(space).withColumn("derived", F.lit(True)), "id", "full")
    return _issues(both.where("n is null or derived is null or n > 1"), "root-mismatch", F.col("id"), F.lit(None).cast("string"))


def bad_kinds(space: Space) -> DataFrame:
    parts = [_issues(df.where(~F.col("kind").rlike(KIND)), "invalid-kind", F.col("graph_id"), F.col("id")) for df in (space.nodes, space.edges)]
    return parts[0].unionByName(parts[1])


def unregistered_kinds(space: Space, vocabulary: DataFrame) -> DataFrame:
    known = vocabulary.select("kind").distinct()
    parts = [_issues(df.where(F.col("kind").rlike(KIND)).join(known, "kind", "left_anti"), "unregistered-kind", F.col("graph_id"), F.col("id")) for df in (space.nodes, space.edges)]
    return parts[0].unionByName(parts[1])


def bad_attrs(space: Space, vocabulary: DataFrame | None = None) -> DataFrame:
    """Attributes of nodes and edges: invalid-attr-key, reserved-core-key, invalid-attr-value, and string-not-nfc of keys and texts. With a
    vocabulary of attributes (key, type: one of TYPES) also unregistered-attr-key (of a namespace that has others),
    unregistered-namespace and attr-type-mismatch. One issue for each attribute and code; a null map has none."""
    rows = [df.where("attrs is not null").select("graph_id", "id", F.explode("attrs").alias("key", "value")) for df in (space.nodes, space.edges)]
    a = rows[0].unionByName(rows[1])
    well, core = F.col("key").rlike(KIND), F.col("key").startswith("core:")
    valid = F.coalesce(F.col("value").rlike(VALUE), F.lit(False))
    name = F.when(~well, "invalid-attr-key").when(core, "reserved-core-key")
    value = F.when(~valid, "invalid-attr-value")
    if vocabulary is not None:
        declared = vocabulary.groupBy("key").agg(F.min("type").alias("type"))
        spaces = vocabulary.select(F.substring_index("key", ":", 1).alias("namespace")).distinct().withColumn("known", F.lit(True))
        a = a.join(declared, "key", "left").withColumn("namespace", F.substring_index("key", ":", 1)).join(spaces, "namespace", "left")
        name = name.when(F.col("type").isNull(), F.when(F.col("known"), "unregistered-attr-key").otherwise("unregistered-namespace"))
        fits = F.coalesce(*[F.when(F.col("type") == t, F.col("value").rlike(f"^{x}$")) for t, x in TYPES.items()], F.lit(True))
        value = value.when(well & ~core & ~fits, "attr-type-mismatch")
    text = F.when(F.col("value").startswith('"'), F.col("value"))
    form = F.when(F.coalesce(nfc(F.col("key")) != F.col("key"), F.lit(False)) | F.coalesce(nfc(text) != text, F.lit(False)), "string-not-nfc")
    found = a.select("graph_id", F.col("id").alias("element_id"), F.explode(F.array_compact(F.array(name, value, form))).alias("code"))
    return found.select("code", "graph_id", "element_id")


def bad_texts(space: Space) -> DataFrame:
    """invalid-id (empty, or with the separator of derived ids), invalid-domain, invalid-provenance, and string-not-nfc of ids, labels and
    domains; one issue for each such text."""
    none = F.lit(None).cast("string")
    parts = []
    for df, graph, element, texts in (
        (space.graphs, F.col("id"), none, ["id", "label", "domain"]),
        (space.nodes, F.col("graph_id"), F.col("id"), ["id", "label"]),
        (space.edges, F.col("graph_id"), F.col("id"), ["id"]),
    ):
        bad_id = F.when(F.col("id").isNull() | (F.col("id") == "") | (F.instr("id", SEPARATOR) > 0), "invalid-id")
        domain = F.when(F.coalesce(F.col("domain"), F.lit("")) == "", "invalid-domain") if "domain" in texts else none
        origin = F.when(~F.coalesce(F.col("origin").isin(ORIGINS), F.lit(False)), "invalid-provenance")
        forms = [F.when(F.coalesce(nfc(F.col(c)) != F.col(c), F.lit(False)), "string-not-nfc") for c in texts]
        parts.append(df.select(F.explode(F.array_compact(F.array(bad_id, domain, origin, *forms))).alias("code"), graph.alias("graph_id"), element.alias("element_id")))
    return reduce(DataFrame.unionByName, parts)


def bad_weights(space: Space) -> DataFrame:
    return _issues(space.edges.where(F.isnan("weight") | (F.abs("weight") == float("inf"))), "invalid-weight", F.col("graph_id"), F.col("id"))


def validate(space: Space, vocabulary: DataFrame | None = None, attributes: DataFrame | None = None) -> DataFrame:
    """All issues; vocabulary has the kinds that are known (kind), attributes the attributes (key, type)."""
    checks = [duplicate_ids, dangling_details, dangling_endpoints, multiple_containment, containment_cycles, root_mismatches, bad_kinds, bad_texts, bad_weights]
    found = [c(space) for c in checks] + [bad_attrs(space, attributes)] + ([unregistered_kinds(space, vocabulary)] if vocabulary is not None else [])
    return reduce(DataFrame.unionByName, found)
