"""Queries over stores and documents of the driver's space, validation of attributes and texts, and text helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import Space
from ..operators import delta, validate
from ..sources import adapters, files
from ..sources.store import Store, salvaged
from . import sql, tables
from .scratch import shared_dir

QUERIES: dict = {}
ORACLES: dict = {}


def registered(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _store(spark, d) -> tuple[Store, Space]:
    """A store of the driver's space with one delta in its log: orders of status F get an attribute and lose their edges."""
    store, space = Store(spark, f"{shared_dir(spark)}/arborlake/store-{uuid.uuid4().hex}"), tables.space(spark, d, links=False)
    store.checkpoint(space)
    before = store.open()
    done = F.coalesce(F.element_at("attrs", "tpch:status") == '{"v":"F"}', F.lit(False))
    nodes = before.nodes.withColumn("attrs", F.when(done, F.map_concat("attrs", F.create_map(F.lit("tpch:done"), F.lit("true")))).otherwise(F.col("attrs")))
    closed = before.nodes.where(done).select(F.col("id").alias("src"))
    edges = before.edges.join(closed, "src", "left_anti").select(before.edges.columns)
    store.append(delta.diff(before, before.with_(nodes=nodes, edges=edges)), 1)
    return store, space


_LATER = "WITH p AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) "


@registered("store_replay", _LATER + "SELECT 'nodes' AS what, count(*)::BIGINT AS n, (count(*) FILTER (WHERE o_orderstatus = 'F'))::BIGINT AS done FROM orders UNION ALL SELECT 'edges', count(*), 0 FROM p WHERE nxt IS NOT NULL AND o_orderstatus <> 'F'")
def _(spark, d):
    """Opened, then compacted, then opened again."""
    store, _ = _store(spark, d)
    store.compact()
    space = store.open()
    orders = space.nodes.where("kind = 'core:order'").agg(F.count("*").alias("n"), F.count_if(F.map_contains_key("attrs", "tpch:done")).alias("done"))
    return orders.select(F.lit("nodes").alias("what"), "n", "done").unionByName(space.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n", F.lit(0).cast("long").alias("done")))


@registered("store_graph", _LATER + "SELECT 'o' || o_orderkey AS id, o_orderstatus = 'F' AS done, CASE WHEN nxt IS NOT NULL AND o_orderstatus <> 'F' THEN 'o' || nxt END AS next FROM p WHERE o_custkey = 7")
def _(spark, d):
    """One graph, read without the others."""
    store, _ = _store(spark, d)
    one = store.graph("gc7")
    nodes = one.nodes.select("id", F.coalesce(F.map_contains_key("attrs", "tpch:done"), F.lit(False)).alias("done"))
    return nodes.join(one.edges.select(F.col("src").alias("id"), F.col("dst").alias("next")), "id", "left")


@registered("store_spine", "SELECT 'node' AS what, 'r' || r_regionkey AS id FROM region UNION ALL SELECT 'shell', 'gr' || r_regionkey FROM region UNION ALL SELECT 'shell', 'gn' || n_nationkey FROM nation UNION ALL SELECT 'shell', 'gc' || c_custkey FROM customer")
def _(spark, d):
    store = Store(spark, f"{shared_dir(spark)}/arborlake/store-{uuid.uuid4().hex}")
    store.checkpoint(tables.space(spark, d, links=False))
    space, shells = store.spine()
    return space.nodes.select(F.lit("node").alias("what"), "id").unionByName(shells.select(F.lit("shell").alias("what"), F.col("graph_id").alias("id")))


_DAMAGE = sql.SPACE + """, kept AS (SELECT * FROM n WHERE graph_id NOT IN (SELECT 'gn' || n_nationkey FROM nation WHERE n_name LIKE '%A')) """


@registered("salvage", _DAMAGE + "SELECT 'graphs' AS what, (SELECT count(*) FROM g WHERE id NOT IN (SELECT 'gn' || n_nationkey FROM nation WHERE n_name LIKE '%A'))::BIGINT AS n UNION ALL SELECT 'nodes', count(*) FROM kept UNION ALL SELECT 'held', count(*) FROM kept WHERE detail_graph IN (SELECT id FROM g) AND detail_graph NOT IN (SELECT 'gn' || n_nationkey FROM nation WHERE n_name LIKE '%A') UNION ALL SELECT 'edges', count(*) FROM e WHERE kind = 'core:precedes'")
def _(spark, d):
    """Some nations' graphs are lost: their customers go, and the nations have no inside; edges to nowhere go too."""
    space = tables.space(spark, d, links=False)
    lost = tables.table(spark, d, "nation").where("n_name like '%A'").select(F.concat(F.lit("gn"), F.col("n_nationkey").cast("string")).alias("id"))
    stray = space.edges.select("graph_id", F.concat(F.lit("x"), "id").alias("id"), "src", F.lit("nowhere").alias("dst"), "kind", "weight", "attrs", "origin")
    damaged = space.with_(graphs=space.graphs.join(lost, "id", "left_anti").select(space.graphs.columns), edges=space.edges.unionByName(stray))
    sound = salvaged(damaged)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(sound.graphs, "graphs").unionByName(count(sound.nodes, "nodes")).unionByName(count(sound.nodes.where("detail_graph is not null"), "held")).unionByName(count(sound.edges, "edges"))


#: (key, value, code without a vocabulary, code with one) by the customer's number.
ATTRIBUTES = [
    ("tpch:segment", '"BUILDING"', None, None), ("Segment", "1", "invalid-attr-key", "invalid-attr-key"), ("core:layers", "1", "reserved-core-key", "reserved-core-key"),
    ("tpch:segment", "{}", "invalid-attr-value", "invalid-attr-value"), ("tpch:segment", "7", None, "attr-type-mismatch"), ("tpch:other", "7", None, "unregistered-attr-key"),
    ("else:where", "7", None, "unregistered-namespace"), ("tpch:sizes", '[1,2.5]', None, None), ("tpch:sizes", '["a"]', None, "attr-type-mismatch"), ("tpch:sizes", "[]", None, None),
    ("tpch:sizes", '[1,"a"]', "invalid-attr-value", "invalid-attr-value"), ("tpch:segment", '"é"', "string-not-nfc", "string-not-nfc"), ("tpch:none", "null", None, None),
]


def _attributes(spark, d) -> Space:
    space = tables.space(spark, d, links=False)
    which = F.col("k") % len(ATTRIBUTES)
    pick = lambda at: F.element_at(F.array(*[F.lit(a[at]) for a in ATTRIBUTES]), (which + 1).cast("int"))
    customers = space.nodes.where("kind = 'core:customer'").withColumn("k", F.substring("id", 2, 20).cast("long"))
    return space.with_(nodes=customers.withColumn("attrs", F.create_map(pick(0), pick(1))).drop("k"), edges=space.edges.limit(0))


def _expected(at: int) -> str:
    rows = ", ".join(f"({k}, {'NULL' if a[at] is None else repr(a[at])})" for k, a in enumerate(ATTRIBUTES))
    return f"WITH x(k, code) AS (VALUES {rows}) SELECT code, 'gn' || c_nationkey AS graph_id, 'c' || c_custkey AS element_id FROM customer JOIN x ON k = c_custkey % {len(ATTRIBUTES)} WHERE code IS NOT NULL"


@registered("validate_attrs", _expected(2))
def _(spark, d):
    return validate.bad_attrs(_attributes(spark, d))


@registered("validate_attr_types", _expected(3))
def _(spark, d):
    known = spark.createDataFrame([("tpch:segment", "string"), ("tpch:sizes", "number-array"), ("tpch:none", "null")], "key string, type string")
    return validate.bad_attrs(_attributes(spark, d), known)


@registered(
    "validate_texts",
    """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'invalid-id' WHEN 1 THEN 'string-not-nfc' WHEN 2 THEN 'invalid-provenance' WHEN 3 THEN 'invalid-id' END AS code, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 5 < 4 GROUP BY 1
UNION ALL SELECT 'invalid-domain', count(*) FROM customer""",
)
def _(spark, d):
    space = tables.space(spark, d, links=False)
    k = F.substring("id", 2, 20).cast("long") % 5
    orders = space.nodes.where("kind = 'core:order'").withColumn("k", k)
    bad = orders.withColumns({"id": F.when(F.col("k") == 0, "").when(F.col("k") == 3, F.concat("id", F.lit("\x1f"))).otherwise(F.col("id")), "label": F.when(F.col("k") == 1, F.concat("label", F.lit("é"))).otherwise(F.col("label")), "origin": F.when(F.col("k") == 2, "unknown").otherwise("ai")})
    graphs = space.graphs.withColumn("domain", F.when(F.col("id").startswith("gc"), "").otherwise(F.col("domain")))
    return validate.bad_texts(space.with_(nodes=bad.drop("k"), graphs=graphs, edges=space.edges.limit(0))).groupBy("code").agg(F.count("*").alias("n"))


@registered(
    "text_helpers",
    r"""WITH t AS (SELECT p_partkey AS id, p_name || '  (' || p_type || ') ' || p_brand AS s FROM part)
SELECT id, regexp_replace(regexp_replace(lower(trim(s)), '[^a-z0-9\s-]', '', 'g'), '\s', '-', 'g') AS slug, format('{:08x}', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(s, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS hash,
       CASE WHEN length(regexp_replace(s, '\s+', ' ', 'g')) <= 20 THEN regexp_replace(s, '\s+', ' ', 'g') ELSE regexp_replace(s, '\s+', ' ', 'g')[1:19] || '…' END AS excerpt, CASE WHEN id % 2 = 0 THEN 'part' END AS namespace FROM t""",
)
def _(spark, d):
    s = F.concat("p_name", F.lit("  ("), "p_type", F.lit(") "), "p_brand")
    key = F.when(F.col("p_partkey") % 2 == 0, F.lit("part:name")).otherwise(F.lit("name"))
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.slug(s).alias("slug"), tx.fnv1a(s).alias("hash"), tx.excerpt(s, 20).alias("excerpt"), tx.namespace_of(key).alias("namespace"))


@registered("glob_selection", r"SELECT 'src/' || lower(p_type) || '/' || p_size || '/' || p_partkey || '.py' AS path FROM part WHERE (p_size < 10 OR p_partkey BETWEEN 10 AND 99) AND lower(p_type) <> 'promo'")
def _(spark, d):
    path = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py"))
    paths = tables.table(spark, d, "part").select(path.alias("path"))
    return paths.where(files.selected(F.col("path"), ["src/*/?/**", "**/??.py"], ["src/promo/**"]))


@registered("delta_chunks", "SELECT o_custkey AS key, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS delta, o_orderkey AS id FROM orders")
def _(spark, d):
    rows = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"))
    return files.chunked(rows, ["key"], ["id"], 4).select("key", "delta", "id")


@registered(
    "markdown_headings",
    """WITH k AS (SELECT n_regionkey AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT r_regionkey::BIGINT AS doc_id, 0::BIGINT AS line, 1::BIGINT AS level, r_name AS title, lower(replace(replace(r_name, '_', ''), ' ', '-')) AS slug, NULL::BIGINT AS parent_line FROM region
UNION ALL SELECT r, 6 * k - 5, 2, n_name, lower(replace(n_name, '_', '')), 0 FROM k
UNION ALL SELECT r, 6 * k - 4, 4, 'Notes', CASE WHEN k = 1 THEN 'notes' ELSE 'notes-' || (k - 1) END, 6 * k - 5 FROM k""",
)
def _(spark, d):
    """A document for each region: a heading for each nation, below it notes and a fence that holds no heading."""
    nation, region = tables.table(spark, d, "nation"), tables.table(spark, d, "region")
    part = F.concat(F.lit("## "), "n_name", F.lit("\n#### Notes ####\n```\n# no\n```\ntext\n"))
    texts = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("t")))), lambda x: x["t"]), "").alias("t"))
    docs = region.join(texts, "r_regionkey").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "r_name", F.lit("\n"), "t").alias("text"))
    return adapters.headings(docs)
