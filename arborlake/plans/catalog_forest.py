"""Forest, cut and induced-edge queries over the driver's space."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cut, forest, induced, resolve
from . import sql, tables
from .scratch import written

QUERIES: dict = {}
ORACLES: dict = {}


def _tree(spark, sf_dir: str, measures: bool = True) -> DataFrame:
    return forest.forest(tables.space(spark, sf_dir, links=False), measures)


def _named(df: DataFrame, *cols: str) -> DataFrame:
    """Columns for the comparison: numbers long, lists as text."""
    kinds = dict(df.dtypes)
    as_text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")) if kinds[c].startswith("array") else F.col(c).cast("long") if kinds[c] in ("int", "bigint") else F.col(c)
    return df.select(*[as_text(c).alias(c) for c in cols])


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("derived_roots", sql.SPACE + "SELECT id FROM g WHERE id NOT IN (SELECT detail_graph FROM n WHERE detail_graph IS NOT NULL)")
def _(spark, d):
    return forest.derived_roots(tables.space(spark, d, links=False))


@query("containment_index", sql.SPACE + "SELECT detail_graph AS graph, graph_id AS in_graph, id AS node FROM n WHERE detail_graph IS NOT NULL")
def _(spark, d):
    return forest.containment_index(tables.space(spark, d, links=False))


@query(
    "containment_path",
    sql.SPACE + """, p AS (SELECT 'root' AS graph, 0 AS depth, 'root' AS path UNION ALL SELECT n.detail_graph, p.depth + 1, p.path || ',' || n.detail_graph FROM n JOIN p ON n.graph_id = p.graph WHERE n.detail_graph IS NOT NULL)
SELECT graph, depth::BIGINT AS depth, path FROM p""",
)
def _(spark, d):
    return _named(forest.containment_paths(tables.space(spark, d, links=False)), "graph", "depth", "path")


@query("forest_measures", sql.SPACE + "SELECT id, depth::BIGINT AS depth, array_to_string(path, ',') AS path, parent, children::BIGINT AS children, leaves::BIGINT AS leaves, size::BIGINT AS size FROM f")
def _(spark, d):
    return _named(_tree(spark, d), "id", "depth", "path", "parent", "children", "leaves", "size")


@query("leaf_paths", sql.SPACE + "SELECT id, array_to_string(path, ',') AS path FROM t WHERE children = 0")
def _(spark, d):
    return _named(_tree(spark, d, False).where("is_leaf"), "id", "path")


@query("max_depth", sql.SPACE + "SELECT max(depth)::BIGINT AS max_depth FROM t")
def _(spark, d):
    return forest.max_depth(_tree(spark, d, False))


@query("incident_degree", sql.SPACE + "SELECT n.id, count(x.id)::BIGINT AS degree FROM n LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x ON x.id = n.id GROUP BY n.id")
def _(spark, d):
    return forest.incident_degree(tables.space(spark, d))


@query("recency_rollup", sql.SPACE + "SELECT a AS id, min(v)::BIGINT AS low, max(v)::BIGINT AS high FROM (SELECT unnest(path) AS a, epoch_ms(o_orderdate) AS v FROM t JOIN orders ON t.id = 'o' || o_orderkey) GROUP BY a")
def _(spark, d):
    dates = tables.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("value"))
    return forest.rolled_up(_tree(spark, d, False), dates)


@query("portal_rebase", sql.SPACE + "SELECT graph_id, src, dst, count(*)::BIGINT AS multiplicity, sum(weight) AS weight FROM e WHERE kind = 'core:supplies' GROUP BY 1, 2, 3")
def _(spark, d):
    up = forest.rebase(_tree(spark, d, False).where("depth <= 1"), tables.supplies(spark, d))
    return up.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("multiplicity"), F.sum("weight").alias("weight"))


@query("subspace_nodes", sql.SPACE + "SELECT id, graph_id FROM t WHERE list_contains(path, 'n3') AND id <> 'n3'")
def _(spark, d):
    return forest.subspace(tables.space(spark, d, links=False), "gn3").nodes.select("id", "graph_id")


for _level in range(4):

    @query(f"cut_l{_level}", sql.SPACE + f"SELECT id, graph_id, depth::BIGINT AS depth, reason, covered_leaves::BIGINT AS covered_leaves FROM {sql.cut(_level)}")
    def _(spark, d, level=_level):
        return _named(cut.build_cut(_tree(spark, d), level), "id", "graph_id", "depth", "reason", "covered_leaves")


@query("cut_zoom", sql.SPACE + f"SELECT id, depth::BIGINT AS depth, reason FROM {sql.cut(2)}")
def _(spark, d):
    tree = _tree(spark, d)
    steps = cut.thresholds(3)
    level = spark.range(1).select(cut.nominal_level(F.lit(0.6), steps).alias("v")).first()["v"]
    return _named(cut.build_cut(tree, level), "id", "depth", "reason")


@query("coverage_proof", sql.SPACE + "SELECT count(*) FILTER (WHERE children = 0)::BIGINT AS total_leaves, count(*) FILTER (WHERE children = 0)::BIGINT AS covered_once, 0::BIGINT AS uncovered, 0::BIGINT AS covered_twice FROM f")
def _(spark, d):
    tree = _tree(spark, d)
    return cut.coverage(tree, cut.build_cut(tree, 2))


OVERRIDES = [("n3", "pin"), ("c5", "expand"), ("r1", "collapse"), ("n1", "pin"), ("r4", "expand"), ("nowhere", "pin")]

#: The recursive rule, walked from the roots down: a node is open or it stops here. Overrides under a pin don't count.
_OVERRIDE_SQL = sql.SPACE + """, given(id, kind) AS (VALUES ('n3', 'pin'), ('c5', 'expand'), ('r1', 'collapse'), ('n1', 'pin'), ('r4', 'expand'), ('nowhere', 'pin'){more}),
under AS (SELECT DISTINCT x.id FROM given x JOIN f USING (id) JOIN given p ON p.kind = 'pin' AND list_contains(f.path, p.id) AND p.id <> x.id),
marks AS (SELECT id, given.kind FROM given JOIN f USING (id) WHERE id NOT IN (SELECT id FROM under)),
opened AS (SELECT DISTINCT unnest(list_slice(path, 1, len(path) - 1)) AS id FROM f JOIN marks USING (id) WHERE marks.kind IN ('pin', 'expand')),
cold AS ({cold}),
w AS (
  SELECT f.*, CASE
    WHEN marks.kind = 'pin' THEN 'pin'
    WHEN marks.kind = 'expand' THEN CASE WHEN cold.id IS NOT NULL THEN 'cold' WHEN children = 0 THEN 'leaf' END
    WHEN marks.kind = 'collapse' THEN CASE WHEN children > 0 AND opened.id IS NOT NULL THEN NULL ELSE 'collapse' END
    WHEN children = 0 THEN CASE WHEN cold.id IS NOT NULL AND depth < {level} THEN 'cold' ELSE 'leaf' END
    WHEN depth < {level} OR opened.id IS NOT NULL THEN NULL
    WHEN depth = {level} THEN 'level' ELSE 'expand-parent' END AS reason
  FROM f LEFT JOIN marks ON marks.id = f.id LEFT JOIN opened ON opened.id = f.id LEFT JOIN cold ON cold.id = f.detail_graph),
walk AS (
  SELECT id, detail_graph, graph_id, depth, reason, leaves FROM w WHERE depth = 0
  UNION ALL SELECT w.id, w.detail_graph, w.graph_id, w.depth, w.reason, w.leaves FROM w JOIN walk ON w.graph_id = walk.detail_graph WHERE walk.reason IS NULL),
members AS (SELECT id, graph_id, depth::BIGINT AS depth, reason, leaves::BIGINT AS covered_leaves FROM walk WHERE reason IS NOT NULL),
kept AS (SELECT DISTINCT unnest(path) AS id FROM f JOIN marks USING (id) WHERE marks.kind IN ('pin', 'expand')),
frontier AS (
  SELECT members.id, 'expand' AS action FROM members JOIN f USING (id) WHERE children > 0 OR detail_graph IN (SELECT id FROM cold)
  UNION ALL SELECT members.id, 'hydrate' FROM members JOIN f USING (id) WHERE detail_graph IN (SELECT id FROM cold)
  UNION ALL SELECT members.id, 'collapse' FROM members JOIN f USING (id) WHERE parent IN (
    SELECT p.id FROM f p JOIN f c ON c.parent = p.id GROUP BY p.id HAVING bool_and(c.id IN (SELECT id FROM members) AND c.id NOT IN (SELECT id FROM kept))))
"""
_NOT_LOADED = "SELECT unnest(['gr4', 'gc5']) AS id UNION SELECT 'gc' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"


def _override_sql(level: int, cold: str = "SELECT NULL AS id WHERE false", more: str = "") -> str:
    return _OVERRIDE_SQL.replace("{level}", str(level)).replace("{cold}", cold).replace("{more}", more)


def _not_loaded(spark, d) -> DataFrame:
    """Two graphs by name, and those of all customers without orders."""
    named = spark.createDataFrame([("gr4",), ("gc5",)], "graph_id string")
    orders = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    empty = tables.table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select(F.concat(F.lit("gc"), F.col("c_custkey").cast("string")).alias("graph_id"))
    return named.unionByName(empty)


@query("cut_overrides", _override_sql(1) + "SELECT * FROM members")
def _(spark, d):
    marks = spark.createDataFrame(OVERRIDES, "id string, kind string")
    return _named(cut.override_cut(_tree(spark, d), 1, marks), "id", "graph_id", "depth", "reason", "covered_leaves")


@query("cut_cold", _override_sql(3, _NOT_LOADED) + "SELECT * FROM members")
def _(spark, d):
    marks = spark.createDataFrame(OVERRIDES, "id string, kind string")
    return _named(cut.override_cut(_tree(spark, d), 3, marks, _not_loaded(spark, d)), "id", "graph_id", "depth", "reason", "covered_leaves")


@query("cut_frontier", _override_sql(1) + "SELECT id, action FROM frontier")
def _(spark, d):
    tree, marks = written(_tree(spark, d), "tree"), spark.createDataFrame(OVERRIDES, "id string, kind string")
    held = cut.effective_overrides(tree, marks)[0].where("override <> 'collapse'")
    return cut.frontier(tree, cut.override_cut(tree, 1, marks), held)


@query("ignored_overrides", _override_sql(1, more=", ('n6', 'collapse'), ('n0', 'expand')").replace("'r1', 'collapse'", "'r1', 'pin'") + "SELECT id, kind, CASE WHEN id IN (SELECT id FROM f) THEN 'shadowed' ELSE 'removed' END AS reason FROM given WHERE id IN (SELECT id FROM under) OR id NOT IN (SELECT id FROM f)")
def _(spark, d):
    """A region is pinned, so what is said of its nations is ignored."""
    marks = [("r1", "pin") if m == ("r1", "collapse") else m for m in OVERRIDES] + [("n6", "collapse"), ("n0", "expand")]
    return cut.effective_overrides(_tree(spark, d), spark.createDataFrame(marks, "id string, kind string"))[1]


#: Half-way, four levels begin at quarters; from level 1 the zoom is beyond the band, so it is level 2.
@query(
    "resolve_lod",
    _override_sql(2, _NOT_LOADED) + f""", cover AS (SELECT f.id, arg_max(m.id, m.depth) AS member FROM f JOIN members m ON list_contains(f.path, m.id) GROUP BY f.id)
SELECT 'member' AS what, id, reason AS value FROM members UNION ALL SELECT 'frontier', id, action FROM frontier UNION ALL SELECT 'ignored', id, 'removed' FROM given WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT 'ignored', id, 'shadowed' FROM under
UNION ALL SELECT 'edge', a.member, b.member || ' ' || count(*) FROM e JOIN cover a ON a.id = e.src JOIN cover b ON b.id = e.dst WHERE a.member <> b.member GROUP BY a.member, b.member, e.kind""",
)
def _(spark, d):
    space = tables.space(spark, d)
    asked = resolve.Request(0.55, spark.createDataFrame(OVERRIDES, "id string, kind string"), _not_loaded(spark, d), level_before=1)
    found = resolve.resolve(space, asked)
    row = lambda df, what, value: df.select(F.lit(what).alias("what"), "id", F.col(value).alias("value"))
    edges = found.edges.select(F.col("src").alias("id"), F.concat_ws(" ", "dst", F.col("multiplicity").cast("string")).alias("value"))
    return row(found.members, "member", "reason").unionByName(row(found.frontier, "frontier", "action")).unionByName(row(found.ignored, "ignored", "reason")).unionByName(row(edges, "edge", "value"))


@query(
    "cut_affected",
    _override_sql(1) + f", plain AS {sql.cut(1)} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'retained' END AS change, a.id IS NOT NULL AND b.id IS NOT NULL AND coalesce(a.id, b.id) IN (SELECT 'n' || c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING') AS affected FROM plain a FULL JOIN members b ON a.id = b.id",
)
def _(spark, d):
    """From a plain cut to one under overrides; the nations of one market segment were computed anew."""
    tree, marks = written(_tree(spark, d), "tree"), spark.createDataFrame(OVERRIDES, "id string, kind string")
    again = tables.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("id"))
    return cut.affected(cut.build_cut(tree, 1), cut.override_cut(tree, 1, marks), again)


@query(
    "compound_groups",
    sql.SPACE + f", m AS {sql.cut(2)}, way AS (SELECT DISTINCT unnest(path) AS id FROM f JOIN m USING (id)) SELECT 'member' AS what, id, graph_id AS \"group\" FROM m UNION ALL SELECT DISTINCT 'graph', f.graph_id, p.graph_id FROM way JOIN f USING (id) JOIN f p ON p.id = f.parent",
)
def _(spark, d):
    tree = written(_tree(spark, d), "tree")
    groups, nesting = cut.compound_groups(tree, cut.build_cut(tree, 2))
    return groups.select(F.lit("member").alias("what"), "id", "group").unionByName(nesting.select(F.lit("graph").alias("what"), F.col("group").alias("id"), F.col("parent").alias("group")))


@query("node_cover", sql.SPACE + f"SELECT id, member FROM {sql.cover(1)}")
def _(spark, d):
    tree = _tree(spark, d)
    return induced.node_cover(tree, cut.build_cut(tree, 1))


def _induced(spark, d, level: int) -> DataFrame:
    tree = _tree(spark, d, False)
    return induced.induced_edges(tables.space(spark, d, tree=tree).edges, induced.level_cover(tree, level))


for _level in range(4):

    @query(f"induced_l{_level}", sql.SPACE + f"SELECT * FROM {sql.induced(_level)}")
    def _(spark, d, level=_level):
        return _named(_induced(spark, d, level), "src", "dst", "kind", "weight", "multiplicity", "samples")


_CAPPED = sql.SPACE + f""", i AS (SELECT * FROM {sql.induced(1)}), o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, kind) AS k FROM i),
b AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src, kind) AS j FROM o WHERE k <= 3) """


@query("induced_capped", _CAPPED + "SELECT src, dst, kind, weight, multiplicity FROM b WHERE j <= 3")
def _(spark, d):
    return induced.cap_fan_out(_induced(spark, d, 1), 3)[0].select("src", "dst", "kind", "weight", "multiplicity")


@query(
    "induced_residuals",
    _CAPPED + """SELECT src AS node, 'out' AS direction, count(*)::BIGINT AS hidden, sum(weight) AS weight, sum(multiplicity)::BIGINT AS multiplicity FROM o WHERE k > 3 GROUP BY 1
UNION ALL SELECT dst, 'in', count(*)::BIGINT, sum(weight), sum(multiplicity)::BIGINT FROM b WHERE j > 3 GROUP BY 1""",
)
def _(spark, d):
    return induced.cap_fan_out(_induced(spark, d, 1), 3)[1].select("node", "direction", "hidden", "weight", "multiplicity")


@query(
    "induced_after_edge_add",
    (sql.SPACE + f"SELECT * FROM {sql.induced(1)}").replace("\n  UNION ALL\n  SELECT 'gc' || o_custkey, 'p'", "\n  UNION ALL SELECT 'gr' || n_regionkey, 'z' || n_nationkey, 'n' || n_nationkey, 'n' || ((n_nationkey + 1) % 25), 'core:supplies', 7.0::DOUBLE FROM nation WHERE n_regionkey = 2\n  UNION ALL\n  SELECT 'gc' || o_custkey, 'p'"),
)
def _(spark, d):
    tree, edges = _tree(spark, d), tables.space(spark, d).edges.select("graph_id", "id", "src", "dst", "kind", "weight")
    cover = written(induced.node_cover(tree, cut.build_cut(tree, 1)), "cover")
    nation = tables.table(spark, d, "nation").where("n_regionkey = 2")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    added = nation.select(text("gr", F.col("n_regionkey")).alias("graph_id"), text("z", F.col("n_nationkey")).alias("id"), text("n", F.col("n_nationkey")).alias("src"), text("n", (F.col("n_nationkey") + 1) % 25).alias("dst"), F.lit("core:supplies").alias("kind"), F.lit(7.0).alias("weight"))
    touched = added.select(F.explode(F.array("src", "dst")).alias("id"))
    now = induced.refreshed(induced.induced_edges(edges, cover), edges.unionByName(added), cover, touched)
    return _named(now, "src", "dst", "kind", "weight", "multiplicity", "samples")


@query("refinement_map", sql.SPACE + f""", a AS (SELECT id FROM {sql.cut(1)}), b AS (SELECT id FROM {sql.cut(2)})
SELECT id, 'move' AS change, id AS link FROM a JOIN b USING (id)
UNION ALL SELECT a.id, 'exit', (SELECT min(f.id) FROM f JOIN b ON b.id = f.id WHERE list_contains(f.path, a.id)) FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT b.id, 'enter', (SELECT list_filter(f.path, lambda x: x IN (SELECT id FROM a))[-1] FROM f WHERE f.id = b.id) FROM b WHERE id NOT IN (SELECT id FROM a)""".replace("(SELECT list_filter(f.path, lambda x: x IN (SELECT id FROM a))[-1] FROM f WHERE f.id = b.id)", "(SELECT f.path[2] FROM f WHERE f.id = b.id)"))
def _(spark, d):
    tree = _tree(spark, d)
    return cut.refinement(tree, cut.build_cut(tree, 1), cut.build_cut(tree, 2))


@query(
    "zoom_hysteresis",
    """WITH RECURSIVE r AS (SELECT user_id::VARCHAR AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, least(greatest((value % 100.0) / 100.0, 0.0), 1.0)::DOUBLE AS zoom FROM events),
q AS (SELECT *, (zoom >= 0.25)::INT + (zoom >= 0.5)::INT + (zoom >= 0.75)::INT AS nom FROM r),
w AS (SELECT session, seq, zoom, nom AS level FROM q WHERE seq = 1
UNION ALL SELECT q.session, q.seq, q.zoom, CASE WHEN abs(q.nom - w.level) > 1 THEN q.nom WHEN q.nom > w.level AND q.zoom >= (w.level + 1) / 4.0 + 0.025 THEN w.level + 1 WHEN q.nom < w.level AND q.zoom < w.level / 4.0 - 0.025 THEN w.level - 1 ELSE w.level END
FROM q JOIN w ON q.session = w.session AND q.seq = w.seq + 1)
SELECT session, seq::BIGINT AS seq, zoom, level::BIGINT AS level FROM w""",
)
def _(spark, d):
    from pyspark.sql import Window

    ev = tables.table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    zoom = F.least(F.greatest((F.col("value") % 100.0) / 100.0, F.lit(0.0)), F.lit(1.0))
    return cut.zoom_levels(ev.select(F.col("user_id").cast("string").alias("session"), seq.alias("seq"), zoom.alias("zoom")), cut.thresholds(3))


def _scores(spark, d, tree: DataFrame) -> DataFrame:
    measures = tree.join(forest.incident_degree(tables.space(spark, d, tree=tree)), "id").select("id", F.col("leaves").cast("double").alias("size"), F.col("degree").cast("double").alias("degree"), F.lit(None).cast("double").alias("recency"))
    return cut.salience(measures)


_SALIENCE = sql.SPACE + """, deg AS (SELECT n.id, count(x.id)::DOUBLE AS degree FROM n LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) x ON x.id = n.id GROUP BY n.id),
m AS (SELECT f.id, f.leaves::DOUBLE AS size, degree FROM f JOIN deg USING (id)),
b AS (SELECT min(size) AS a, max(size) AS b, min(degree) AS c, max(degree) AS d FROM m)"""


@query(
    "salience",
    _SALIENCE + """
SELECT id, round((0.5::DOUBLE * (size - a) / (b - a) + 0.3::DOUBLE * (degree - c) / (d - c)) / 0.8::DOUBLE, 9) AS salience FROM m, b""",
)
def _(spark, d):
    return _scores(spark, d, _tree(spark, d)).select("id", F.round("salience", 9).alias("salience"))


#: Every nation has a turn once its customers are members; a region once all its nations had theirs, but for that of n7, which stays. Turns are in the
#: order of the greatest key among those that they wait for.
_BUDGET = _SALIENCE + """, s AS (SELECT id, round((0.5::DOUBLE * (size - a) / (b - a) + 0.3::DOUBLE * (degree - c) / (d - c)) / 0.8::DOUBLE, 9) AS v FROM m, b),
k AS (SELECT p.id, p.parent, p.depth, p.children, min(s.v) AS least FROM f p JOIN f c ON c.parent = p.id JOIN s ON s.id = c.id WHERE p.depth <= 1 GROUP BY p.id, p.parent, p.depth, p.children),
one AS (SELECT id, parent, depth, children, {'v': least, 'id': id} AS lock FROM k WHERE depth = 1 ),
w AS (SELECT parent AS id, count(*) AS n, max(lock) AS after FROM (SELECT parent, lock FROM one UNION ALL SELECT parent, NULL FROM f WHERE depth = 1 AND children = 0) GROUP BY parent),
two AS (SELECT k.id, k.parent, k.depth, k.children, greatest({'v': least, 'id': k.id}, after) AS lock FROM k JOIN w ON w.id = k.id WHERE k.depth = 0 AND w.n = k.children AND k.id NOT IN (SELECT parent FROM f WHERE id = 'n7')),
turns AS (SELECT id, parent, depth, lock, children - 1 AS gain FROM one UNION ALL SELECT id, parent, depth, lock, children - 1 FROM two),
o AS (SELECT *, coalesce(sum(gain) OVER (ORDER BY lock, depth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM turns),
st AS (SELECT id, parent, depth FROM f WHERE depth = 2 OR depth < 2 AND children = 0),
tk AS (SELECT id, parent, depth FROM o WHERE gone < (SELECT count(*) FROM st) - 200)
SELECT id, depth::BIGINT AS depth, reason FROM (SELECT *, 'kept' AS reason FROM st UNION ALL SELECT *, 'budget' FROM tk) WHERE parent IS NULL OR parent NOT IN (SELECT id FROM tk)"""


@query("budget_cut", _BUDGET)
def _(spark, d):
    tree = written(_tree(spark, d), "tree")
    scores = _scores(spark, d, tree).select("id", F.round("salience", 9).alias("salience"))
    return cut.budget_cut(tree, cut.build_cut(tree, 2), scores, 200, spark.createDataFrame([("n7",)], "id string"))
