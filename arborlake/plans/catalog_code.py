"""Queries over programs: Python sources that Spark writes from the driver's tables, one function for each row."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import code, control_flow
from ..streaming import code_session
from . import tables
from .scratch import shared_dir, written

QUERIES: dict = {}
ORACLES: dict = {}


def registered(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


#: Functions that a task parses; what Spark shuffles of them is too compact for it to tell how much work they are.
FUNCTIONS = 20_000


def _parts(spark, d) -> int:
    return tables.table(spark, d, "orders").count() // FUNCTIONS + 1


def _bodies(spark, d) -> DataFrame:
    """A file for each customer with a function for each order: a loop with jumps, a protected part, or a match, by its status."""
    k = (F.col("o_orderkey") % 4 + 1).cast("int")
    each = lambda make: F.array_join(F.transform(F.sequence(F.lit(0), k - 1), make), "")
    loop = F.concat(F.lit("  for i in r:\n"), each(lambda j: F.when(j % 2 == 0, "    if i:\n      continue\n").otherwise("    if i:\n      break\n")), F.lit("    h(i)\n  done()\n"))
    protected = F.lit("  try:\n    a()\n    return 1\n  except E:\n    b()\n  finally:\n    c()\n  d()\n")
    arms = F.concat(F.lit("  match x:\n"), each(lambda j: F.concat(F.lit("    case "), j.cast("string"), F.lit(":\n      return\n"))), F.lit("    case _:\n      b()\n  d()\n"))
    body = F.when(F.col("o_orderstatus") == "F", loop).when(F.col("o_orderstatus") == "O", protected).otherwise(arms)
    orders = tables.table(spark, d, "orders").repartition(_parts(spark, d), "o_custkey").select("o_custkey", "o_orderkey", F.concat(F.lit("def o"), F.col("o_orderkey").cast("string"), F.lit("(x):\n"), body).alias("t"))
    files = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "t"))).alias("f"))
    return files.select(F.concat(F.lit("src/c"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("path"), F.array_join(F.transform("f", lambda f: f["t"]), "\n").alias("text"))


_FLOWS = """
WITH o AS (
  SELECT 'src/c' || o_custkey || '.py' AS path, 'o' || o_orderkey AS function, o_orderstatus AS s, (o_orderkey % 4 + 1)::INT AS k FROM orders
), j AS (
  SELECT o.*, unnest(range(0, k)) AS j FROM o
), flows AS (
  SELECT path, function, unnest(['entry', '0', '0', '2', (1 + 2 * k)::VARCHAR]) AS src, unnest(['0', '1', '2', 'exit', '0']) AS dst, unnest(['seq', 'true', 'false', 'seq', 'loop']) AS label FROM o WHERE s = 'F'
  UNION ALL
  SELECT path, function, unnest([1 + 2 * j, 1 + 2 * j, 4 + 2 * j])::VARCHAR, unnest([4 + 2 * j, 3 + 2 * j, CASE WHEN j % 2 = 0 THEN 0 ELSE 2 END])::VARCHAR, unnest(['true', 'false', CASE WHEN j % 2 = 0 THEN 'continue' ELSE 'break' END]) FROM j WHERE s = 'F'
  UNION ALL
  SELECT path, function, unnest(['entry', '2', '2', '3', '1', '1', '0']), unnest(['2', '3', '1', '1', 'exit', '0', 'exit']), unnest(['seq', 'exception', 'return', 'finally', 'return', 'seq', 'seq']) FROM o WHERE s = 'O'
  UNION ALL
  SELECT path, function, unnest(['entry', (1 + k)::VARCHAR, '0']), unnest([(1 + k)::VARCHAR, '0', 'exit']), unnest(['true', 'seq', 'seq']) FROM o WHERE s NOT IN ('F', 'O')
  UNION ALL
  SELECT path, function, unnest(['entry', (1 + j)::VARCHAR]), unnest([(1 + j)::VARCHAR, 'exit']), unnest(['true', 'return']) FROM j WHERE s NOT IN ('F', 'O')
)
"""


@registered("control_flow", _FLOWS + "SELECT path, function, src, dst, label FROM flows")
def _(spark, d):
    return control_flow.flows(control_flow.functions(_bodies(spark, d))).drop("nth")


_BLOCKS = ", b AS (SELECT path, function, CASE WHEN s = 'F' THEN 5 + 2 * k WHEN s = 'O' THEN 6 ELSE 4 + k END::BIGINT AS blocks FROM o) "


@registered("cyclomatic_complexity", _FLOWS + _BLOCKS + "SELECT path, function, any_value(b.blocks) AS blocks, count(*)::BIGINT AS flows, count(*) FILTER (WHERE label IN ('loop', 'continue'))::BIGINT AS loops, count(*) FILTER (WHERE dst = 'exit')::BIGINT AS exits, (count(*) - any_value(b.blocks) + 2)::BIGINT AS cyclomatic FROM flows JOIN b USING (path, function) GROUP BY 1, 2")
def _(spark, d):
    return control_flow.complexity(control_flow.functions(_bodies(spark, d))).drop("nth")


@registered("unreached_blocks", "SELECT 'src/c' || o_custkey || '.py' AS path, 'o' || o_orderkey AS function, '5' AS block FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    """Each loop's last statement is a break now, after which a block of its own follows that nothing reaches."""
    files = _bodies(spark, d).withColumn("text", F.regexp_replace("text", r"(?:    if i:\n      (?:continue|break)\n)+    h\(i\)\n", "    if i:\n      continue\n    break\n    h(i)\n"))
    return control_flow.unreached(control_flow.functions(files)).drop("nth")


@registered("body_operations", _FLOWS + _BLOCKS + "SELECT path, function, 'graph:add' AS t, 4::BIGINT AS phase, 1::BIGINT AS n FROM o UNION ALL SELECT path, function, 'node:detail', 7, 1 FROM o UNION ALL SELECT path, function, 'node:add', 6, blocks FROM b UNION ALL SELECT path, function, 'edge:add', 9, count(*) FROM flows GROUP BY 1, 2")
def _(spark, d):
    # Dealt by file while a function is one row: then its operations, some twenty rows with an id each, are counted where they are.
    ops = control_flow.body_operations(control_flow.functions(_bodies(spark, d)).repartition(_parts(spark, d), "path"))
    return ops.groupBy("path", "function", "t", F.col("phase").cast("long").alias("phase")).agg(F.countDistinct("id").alias("n"))


# --- modules that import and call each other ------------------------------------------------------------------------------------


def _project(spark, d, moved: bool = False) -> DataFrame:
    """A module for each supplier in a package for its nation: imports the next of the nation, and the next of all, and calls both.

    moved: every third module has a comment on top, every fifth calls one thing more.
    """
    s = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("n"))
    ends = s.agg(F.count("*").alias("count"))  # keys count from 0
    far = s.select(F.col("s").alias("q"), F.col("n").alias("m"))
    s = s.join(F.broadcast(ends)).withColumn("q", (F.col("s") + 1) % F.col("count")).join(far, "q")
    near = F.lead("s").over(Window.partitionBy("n").orderBy("s"))
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    s = s.withColumn("peer", F.coalesce(near.cast("string"), F.lit("none")))
    twice = F.when(F.col("s") % 3 == 0, "def help():\n  pass\n").otherwise("")
    calls = F.repeat(F.lit("  go()\n"), (F.col("s") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit("from .s"), F.col("peer"), F.lit(" import run as go\nfrom "), name("n", "m"), F.lit("."), name("s", "q"), F.lit(" import run as far\nimport os\n"),
        F.lit("def run(x):\n  return x\ndef help():\n  pass\n"), twice, F.lit("def main():\n"), calls, F.lit("  far()\n  help()\n  run(1)\n  os.getcwd()\n  print()\n"),
        F.lit("class A:\n  def m(self):\n    self.k()\n    self.nothing()\n  def k(self):\n    help()\n"),
    )
    if moved:
        text = F.concat(F.when(F.col("s") % 3 == 0, "# moved\n\n").otherwise(""), text, F.when(F.col("s") % 5 == 0, "def more():\n  main()\n").otherwise(""))
    return s.select(F.concat(name("n", "n"), F.lit("/"), name("s", "s"), F.lit(".py")).alias("path"), text.alias("text"))


_PROJECT = """
WITH s AS (
  SELECT s_suppkey AS s, s_nationkey AS n, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS peer, (s_suppkey + 1) % count(*) OVER () AS q FROM supplier
), p AS (
  SELECT s.*, f.s_nationkey AS m, 'n' || n || '/s' || s || '.py' AS path, 'n' || n || '/s' || peer || '.py' AS peer_path, 'n' || f.s_nationkey || '/s' || q || '.py' AS far_path, (s % 3 + 1) AS k, s % 3 <> 0 AS one FROM s JOIN supplier f ON f.s_suppkey = q
), calls AS (
  SELECT path, 'main' AS caller, 'go' AS callee, unnest(range(0, k)) AS nth, CASE WHEN peer IS NULL THEN 'external' ELSE 'resolved' END AS state, peer_path AS target_path, CASE WHEN peer IS NOT NULL THEN 'run' END AS target FROM p
  UNION ALL SELECT path, 'main', 'far', 0, 'resolved', far_path, 'run' FROM p
  UNION ALL SELECT path, caller, 'help', 0, CASE WHEN one THEN 'resolved' ELSE 'unresolved' END, CASE WHEN one THEN path END, CASE WHEN one THEN 'help' END FROM p, (VALUES ('main'), ('k')) t(caller)
  UNION ALL SELECT path, 'main', 'run', 0, 'resolved', path, 'run' FROM p
  UNION ALL SELECT path, 'main', unnest(['getcwd', 'print']), 0, 'unresolved', NULL, NULL FROM p
  UNION ALL SELECT path, 'm', 'k', 0, 'resolved', path, 'k' FROM p
  UNION ALL SELECT path, 'm', 'nothing', 0, 'unresolved', NULL, NULL FROM p
)
"""


def _named(mods: DataFrame) -> DataFrame:
    return code.declarations(mods).select("path", F.col("at").alias("decl"), F.col("name").alias("caller"))


@registered("resolved_calls", _PROJECT + "SELECT path, caller, callee, state, target_path, target, count(*)::BIGINT AS n FROM calls GROUP BY ALL")
def _(spark, d):
    mods = written(code.modules(_project(spark, d)), "facts")
    names = _named(mods)
    targets = names.select(F.col("path").alias("target_path"), F.col("decl").alias("at"), F.col("caller").alias("target"))
    found = code.resolved_calls(mods).withColumnRenamed("target", "at").join(names, ["path", "decl"]).join(targets, ["target_path", "at"], "left")
    return found.groupBy("path", "caller", "callee", "state", "target_path", "target").agg(F.count("*").alias("n"))


@registered("call_counters", _PROJECT + "SELECT path, caller, count(*) FILTER (WHERE state = 'resolved')::BIGINT AS resolved, count(*) FILTER (WHERE state = 'unresolved')::BIGINT AS unresolved, count(*) FILTER (WHERE state = 'external')::BIGINT AS external FROM calls GROUP BY 1, 2")
def _(spark, d):
    mods = written(code.modules(_project(spark, d)), "facts")
    return code.counters(code.resolved_calls(mods)).join(_named(mods), ["path", "decl"]).drop("decl")


@registered("resolved_imports", _PROJECT + "SELECT path, 'go' AS local, CASE WHEN peer IS NULL THEN 'external' ELSE 'decl' END AS kind, peer_path AS module FROM p UNION ALL SELECT path, 'far', 'decl', far_path FROM p UNION ALL SELECT path, 'os', 'external', NULL FROM p")
def _(spark, d):
    mods = written(code.modules(_project(spark, d)), "facts")
    return code.resolved_imports(mods).select("path", "local", "kind", "module")


_LINKS = _PROJECT + """, ends AS (
  SELECT 'code:imports' AS kind, path, peer_path AS target_path, '' AS caller, '' AS target FROM p WHERE peer IS NOT NULL
  UNION ALL SELECT 'code:imports', path, far_path, '', '' FROM p
  UNION ALL SELECT 'code:calls', path, target_path, caller, target FROM calls WHERE state = 'resolved'
), placed AS (
  SELECT kind, CASE WHEN path = target_path THEN CASE WHEN caller = 'm' THEN path || '/A' ELSE path END WHEN split_part(path, '/', 1) = split_part(target_path, '/', 1) THEN split_part(path, '/', 1) ELSE 'project' END AS holder,
         CASE WHEN path = target_path THEN path || '/' || CASE caller WHEN 'm' THEN 'A/m' WHEN 'k' THEN 'A' ELSE caller END WHEN split_part(path, '/', 1) = split_part(target_path, '/', 1) THEN path ELSE split_part(path, '/', 1) END AS src,
         CASE WHEN path = target_path THEN path || '/' || CASE target WHEN 'k' THEN 'A/k' ELSE target END WHEN split_part(path, '/', 1) = split_part(target_path, '/', 1) THEN target_path ELSE split_part(target_path, '/', 1) END AS dst
  FROM ends
)
"""


@registered("code_links", _LINKS + "SELECT holder, src, dst, kind, count(*)::DOUBLE AS weight, CASE WHEN kind = 'code:calls' THEN least(count(*), 3) ELSE 0 END::BIGINT AS samples FROM placed GROUP BY holder, src, dst, kind")
def _(spark, d):
    plain = lambda c: F.when(F.col(c).startswith("\x1f"), F.substring_index(c, "\x1f", -1)).otherwise(F.translate(c, "\x1f", "/"))
    mods = written(code.modules(_project(spark, d)), "facts")
    found = code.links(mods)
    return found.select(plain("holder").alias("holder"), plain("src").alias("src"), plain("dst").alias("dst"), "kind", "weight", F.size("spans").cast("long").alias("samples"))


@registered("code_document", _LINKS + "SELECT 'code:project' AS kind, 1::BIGINT AS n UNION ALL SELECT 'code:package', count(DISTINCT n) FROM p UNION ALL SELECT 'code:module', count(*) FROM p UNION ALL SELECT 'code:class', count(*) FROM p UNION ALL SELECT 'code:method', 2 * count(*) FROM p UNION ALL SELECT 'code:function', 3 * count(*) + count(*) FILTER (WHERE NOT one) FROM p UNION ALL SELECT kind, count(*) FROM (SELECT DISTINCT holder, src, dst, kind FROM placed) GROUP BY kind")
def _(spark, d):
    doc = code.code_document(written(code.modules(_project(spark, d)), "facts"))
    return doc.nodes.select("kind", "id").unionByName(doc.edges.select("kind", "id")).groupBy("kind").agg(F.countDistinct("id").alias("n"))


@registered("code_diff_modulo_spans", _PROJECT + "SELECT 'node:add' AS t, 'more' AS label, count(*)::BIGINT AS n FROM p WHERE s % 5 = 0 UNION ALL SELECT 'edge:add', 'code:calls', count(*) FROM p WHERE s % 5 = 0")
def _(spark, d):
    before, after = (code.code_document(written(code.modules(_project(spark, d, moved)), "facts")) for moved in (False, True))
    ops = code.diff_modulo_spans(before, after)
    return ops.groupBy("t", F.when(F.col("t") == "edge:add", F.get_json_object("next", "$.kind")).otherwise(F.get_json_object("next", "$.label")).alias("label")).agg(F.count("*").alias("n"))


@registered("code_session", _PROJECT + "SELECT 'node:add' AS t, 'more' AS label, count(*)::BIGINT AS n FROM p WHERE s % 5 = 0 UNION ALL SELECT 'edge:add', 'code:calls', count(*) FROM p WHERE s % 5 = 0 UNION ALL SELECT 'left over', NULL, 0")
def _(spark, d):
    """The project streamed as it was, then as it is moved, with old versions that come late: the operations of the second batch, and
    what its document and a fresh one differ by."""
    root = f"{shared_dir(spark)}/arborlake/session-{uuid.uuid4().hex}"
    old, new = (_project(spark, d, moved).select("path", F.lit(2 + moved).cast("long").alias("version"), "text") for moved in (False, True))
    late = old.withColumns({"version": F.lit(1).cast("long"), "text": F.lit("x = 1\n")})
    for k, rows in enumerate((old, new.unionByName(late))):
        rows.coalesce(1).write.parquet(f"{root}/in/{k}")
    session = code_session.Session(spark, f"{root}/project")
    changes = spark.readStream.schema(code_session.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    session.watch(changes, availableNow=True).awaitTermination()
    ops = session.operations(session.published()[-1])
    label = F.when(F.col("t") == "edge:add", F.get_json_object("next", "$.kind")).otherwise(F.get_json_object("next", "$.label"))
    fresh = code.code_document(written(code.modules(new), "facts"))
    rest = code.diff_modulo_spans(session.document(), fresh).agg(F.count("*").alias("n")).select(F.lit("left over").alias("t"), F.lit(None).cast("string").alias("label"), "n")
    return ops.groupBy("t", label.alias("label")).agg(F.count("*").alias("n")).unionByName(rest)
