"""The driver tables as a space in SQL: common table expressions that the oracles start from.

g (graphs), n (nodes), f (forest with path as a list, parent, children, leaves, size), links (line items between nations),
e (all edges).
"""

SPACE = """
WITH RECURSIVE g AS (
  SELECT 'root' AS id, 'all' AS label
  UNION ALL SELECT 'gr' || r_regionkey, r_name FROM region
  UNION ALL SELECT 'gn' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'gc' || c_custkey, c_name FROM customer
), n AS (
  SELECT 'root' AS graph_id, 'r' || r_regionkey AS id, 'core:region' AS kind, r_name AS label, 'gr' || r_regionkey AS detail_graph FROM region
  UNION ALL SELECT 'gr' || n_regionkey, 'n' || n_nationkey, 'core:nation', n_name, 'gn' || n_nationkey FROM nation
  UNION ALL SELECT 'gn' || c_nationkey, 'c' || c_custkey, 'core:customer', c_name, 'gc' || c_custkey FROM customer
  UNION ALL SELECT 'gc' || o_custkey, 'o' || o_orderkey, 'core:order', o_orderpriority, NULL FROM orders
), filled AS (
  SELECT graph_id, count(*) AS children FROM n GROUP BY graph_id
), nc AS (
  SELECT n.*, coalesce(filled.children, 0) AS children FROM n LEFT JOIN filled ON filled.graph_id = n.detail_graph
), t AS (
  SELECT nc.*, 0 AS depth, [id] AS path, NULL::VARCHAR AS parent FROM nc WHERE graph_id = 'root'
  UNION ALL
  SELECT nc.*, t.depth + 1, list_append(t.path, nc.id), t.id FROM nc JOIN t ON nc.graph_id = t.detail_graph
), up AS (
  SELECT a AS id, count(*) FILTER (WHERE children = 0) AS leaves, count(*) AS size FROM (SELECT unnest(path) AS a, children FROM t) GROUP BY a
), f AS (
  SELECT t.*, up.leaves, up.size FROM t JOIN up USING (id)
), links AS (
  SELECT 's' || l_orderkey || '-' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id,
         s_nationkey AS a, c_nationkey AS b, l_quantity AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), e AS (
  SELECT CASE WHEN x.n_regionkey = y.n_regionkey THEN 'gr' || x.n_regionkey ELSE 'root' END AS graph_id, id,
         CASE WHEN x.n_regionkey = y.n_regionkey THEN 'n' || a ELSE 'r' || x.n_regionkey END AS src,
         CASE WHEN x.n_regionkey = y.n_regionkey THEN 'n' || b ELSE 'r' || y.n_regionkey END AS dst,
         'core:supplies' AS kind, weight
  FROM links JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE a <> b
  UNION ALL
  SELECT 'gc' || o_custkey, 'p' || o_orderkey, 'o' || o_orderkey, 'o' || nxt, 'core:precedes', NULL
  FROM (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE nxt IS NOT NULL
)
"""


def cut(level: int) -> str:
    return f"(SELECT id, graph_id, depth, CASE WHEN depth = {level} THEN 'level' ELSE 'leaf' END AS reason, leaves AS covered_leaves FROM f WHERE depth = {level} OR (children = 0 AND depth < {level}))"


def cover(level: int) -> str:
    """id, member for a plain cut: the node on the path at the level, or the leaf above it."""
    return f"(SELECT id, CASE WHEN depth >= {level} THEN path[{level + 1}] ELSE id END AS member FROM f WHERE depth >= {level} OR children = 0)"


def induced(level: int) -> str:
    return f"""(SELECT a.member AS src, b.member AS dst, kind, sum(coalesce(weight, 1.0::DOUBLE)) AS weight, count(*)::BIGINT AS multiplicity,
  array_to_string(list_slice(list(e.id ORDER BY e.id), 1, 3), ',') AS samples
  FROM e JOIN {cover(level)} a ON a.id = e.src JOIN {cover(level)} b ON b.id = e.dst WHERE a.member <> b.member GROUP BY 1, 2, 3)"""
