"""Graph documents: JSON texts to tables and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Space

VERSION = 1
_PROVENANCE = "provenance struct<origin: string>"
DOCUMENT = (
    "formatVersion int, roots array<string>, graphs array<struct<id: string, meta: struct<label: string, domain: string, "
    + _PROVENANCE.replace("provenance ", "provenance: ") + ">, "
    "nodes: array<struct<id: string, kind: string, label: string, detail: struct<graph: string>, attrs: variant, provenance: struct<origin: string>>>, "
    "edges: array<struct<id: string, src: string, dst: string, kind: string, weight: double, attrs: variant, provenance: struct<origin: string>>>>>"
)


def parse(texts: DataFrame) -> DataFrame:
    """doc, d (the parsed document, or null) and code (what is wrong with the text as such, or null) of texts (doc, text).

    Texts are judged in this order: not JSON, no version, a version that isn't a whole number, another version.
    """
    version = F.get_json_object("text", "$.formatVersion")
    whole = F.try_parse_json("text")
    rows = texts.withColumn("d", F.from_json("text", DOCUMENT))
    code = (
        F.when(whole.isNull(), "malformed-json")
        .when(version.isNull(), "missing-format-version")
        .when(~version.rlike(r"^\d+$"), "invalid-format-version")
        .when(version.cast("string") != str(VERSION), "unsupported-version")
        .when(F.col("d.graphs").isNull(), "structural")
    )
    return rows.select("doc", "d", code.alias("code"))


def _attrs(c: str):
    """Attributes as canonical JSON texts by key."""
    values = F.variant_get(F.col(c), F.lit("$"), "map<string,variant>")
    return F.when(F.col(c).isNotNull(), F.transform_values(values, lambda k, v: F.to_json(v)))


def decode(texts: DataFrame) -> tuple[Space, DataFrame]:
    """The space of all sound texts (graph, node and edge ids must differ between documents), and doc, code of the others.

    Within a document the first use of a graph, node or edge id stands, later ones are left out.
    """
    parsed = parse(texts)
    good = parsed.where("code is null").select("doc", "d")
    graphs = good.select("doc", "d.roots", F.posexplode("d.graphs").alias("at", "g"))
    first = lambda df, id_, *order: df.groupBy("doc", id_).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")
    g = first(graphs.select("doc", "at", F.col("g.id").alias("id"), F.col("g.meta.label").alias("label"), F.col("g.meta.domain").alias("domain"), F.col("g.meta.provenance.origin").alias("origin")), "id", "at")
    n = graphs.select("doc", "at", F.col("g.id").alias("graph_id"), F.posexplode("g.nodes").alias("place", "x"))
    n = first(n.select("doc", "at", "place", "graph_id", F.col("x.id").alias("id"), F.col("x.kind").alias("kind"), F.col("x.label").alias("label"), F.col("x.detail.graph").alias("detail_graph"), _attrs("x.attrs").alias("attrs"), F.col("x.provenance.origin").alias("origin")), "id", "at", "place")
    e = graphs.select("doc", "at", F.col("g.id").alias("graph_id"), F.posexplode("g.edges").alias("place", "x"))
    e = first(e.select("doc", "at", "place", "graph_id", F.col("x.id").alias("id"), F.col("x.src").alias("src"), F.col("x.dst").alias("dst"), F.col("x.kind").alias("kind"), F.col("x.weight").alias("weight"), _attrs("x.attrs").alias("attrs"), F.col("x.provenance.origin").alias("origin")), "id", "at", "place")
    roots = good.select(F.explode("d.roots").alias("id"))
    return Space(g.drop("doc", "at"), n.drop("doc", "at", "place"), e.drop("doc", "at", "place"), roots), parsed.where("code is not null").select("doc", "code")


def encode(space: Space) -> DataFrame:
    """graph, text: each graph as canonical JSON, nodes, edges and attributes in the order of their ids; null members are left out."""
    sorted_attrs = F.map_from_entries(F.array_sort(F.map_entries("attrs")))
    n = space.nodes.select("graph_id", F.struct("id", "kind", "label", F.when(F.col("detail_graph").isNotNull(), F.struct(F.col("detail_graph").alias("graph"))).alias("detail"), sorted_attrs.alias("attrs"), F.struct("origin").alias("provenance")).alias("x"))
    e = space.edges.select("graph_id", F.struct("id", "src", "dst", "kind", "weight", sorted_attrs.alias("attrs"), F.struct("origin").alias("provenance")).alias("x"))
    texts = lambda df, name: df.select("graph_id", F.col("x.id").alias("id"), F.to_json("x").alias("j")).groupBy("graph_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "j"))), lambda r: r["j"]), ",").alias(name))
    g = space.graphs.select(F.col("id").alias("graph_id"), F.to_json(F.struct("label", "domain", F.struct("origin").alias("provenance"))).alias("meta"))
    joined = g.join(texts(n, "n"), "graph_id", "left").join(texts(e, "e"), "graph_id", "left")
    return joined.select(F.col("graph_id").alias("graph"), F.concat(F.lit('{"id":"'), "graph_id", F.lit('","meta":'), "meta", F.lit(',"nodes":['), F.coalesce("n", F.lit("")), F.lit('],"edges":['), F.coalesce("e", F.lit("")), F.lit("]}")).alias("text"))


def document(space: Space) -> str:
    """One document of a small space, on the driver."""
    from ..operators.forest import derived_roots

    parts = [r["text"] for r in encode(space).orderBy("graph").collect()]
    roots = sorted(r["id"] for r in derived_roots(space).collect())
    return '{"formatVersion":%d,"roots":[%s],"graphs":[%s]}' % (VERSION, ",".join(f'"{r}"' for r in roots), ",".join(parts))


def all_issues(texts: DataFrame) -> DataFrame:
    """code, graph_id, element_id over texts that can't be read and the space of the others."""
    from ..operators.validate import validate

    space, bad = decode(texts)
    return reduce(DataFrame.unionByName, [bad.select("code", F.lit(None).cast("string").alias("graph_id"), F.col("doc").cast("string").alias("element_id")), validate(space)])
