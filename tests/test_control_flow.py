import ast

import pytest
from pyspark.sql import functions as F

from arborlake.operators import delta
from arborlake.sources import control_flow as cf

# fixed values: control flow as drawn by hand
DRAWN = {
    "def f(x):\n  if x:\n    return 1\n  g()\n  return 2\n": "0->exit:return 1->exit:return entry->0:false entry->1:true",
    "def f():\n  for i in r:\n    if i:\n      continue\n    if i:\n      break\n    h(i)\n  done()\n": "entry->0:seq 0->1:true 0->2:false 1->4:true 4->0:continue 1->3:false 3->6:true 6->2:break 3->5:false 5->0:loop 2->exit:seq",
    "def f(x):\n  match x:\n    case 1:\n      a()\n    case _:\n      b()\n  d()\n": "entry->1:true 1->0:seq entry->2:true 2->0:seq 0->exit:seq",
    "def f():\n  try:\n    a()\n    return 1\n  except E:\n    b()\n  else:\n    e()\n  finally:\n    c()\n  d()\n": "entry->2:seq 2->3:exception 2->1:return 3->1:finally 1->exit:return 1->0:seq 0->exit:seq",
    "def f():\n  try:\n    a()\n    return 1\n  finally:\n    c()\n  d()\n": "entry->2:seq 2->1:exception 2->1:return 1->exit:return 0->exit:seq",
    # a break through two finalizers, and an exception that a handler's own code raises
    "def f():\n  while x:\n    try:\n      try:\n        break\n      finally:\n        a()\n    finally:\n      b()\n": "entry->0:seq 0->1:true 0->2:false 1->5:seq 5->4:exception 5->8:seq 8->7:exception 8->7:break 7->4:break 4->2:break 6->4:finally 4->3:seq 3->0:loop 2->exit:seq",
    "def f():\n  try:\n    a()\n  except E:\n    raise\n": "entry->1:seq 1->2:exception 1->0:seq 2->exit:exception 0->exit:seq",
    "def f():\n  with a:\n    x()\n  if a:\n    b()\n  elif c:\n    d()\n  else:\n    e()\n": "entry->1:true entry->2:false 1->0:seq 2->4:true 2->5:false 4->3:seq 5->3:seq 3->0:seq 0->exit:seq",
    "def f():\n  return\n  a()\n": "entry->exit:return 0->exit:seq",
    "def f(x):\n  match x:\n    case 1:\n      raise E\n": "entry->1:true 1->exit:exception entry->0:false 0->exit:seq",
}


@pytest.mark.parametrize("source", DRAWN, ids=range(len(DRAWN)))
def test_flows_as_drawn_by_hand(source):
    flow = cf.Flow(ast.parse(source).body[0].body)
    assert sorted("{}->{}:{}".format(*f) for f in flow.flows) == sorted(DRAWN[source].split())
    blocks = [b[0] for b in flow.blocks()]
    assert {x for s, d, _ in flow.flows for x in (s, d)} <= set(blocks) and len(set(blocks)) == len(blocks)
    assert not any(d == "entry" or s == "exit" for s, d, _ in flow.flows)


def test_functions_of_files(spark):
    source = "class A:\n  def m(self):\n    def inner():\n      return 1\n    return inner\nif x:\n  def m():\n    pass\nelse:\n  def m():\n    y()\n"
    rows = [("a.py", source, 1), ("bad.py", "def f(:", 2), ("null.py", None, 3), ("none.py", "", 4), ("b.py", "async def g():\n  async for x in y:\n    await z\n", 5)]
    found = cf.functions(spark.createDataFrame(rows, "path string, text string, flows int"))
    assert sorted(tuple(r)[:5] for r in found.collect()) == [("a.py", "A.m", 0, 2, 5), ("a.py", "A.m.inner", 0, 3, 4), ("a.py", "m", 0, 7, 8), ("a.py", "m", 1, 10, 11), ("b.py", "g", 0, 1, 3)]
    assert {(r["function"], r["block"], r["role"], r["statements"]) for r in cf.blocks(found).where("path = 'b.py'").collect()} == {("g", "entry", "entry", 0), ("g", "0", "block", 0), ("g", "1", "block", 1), ("g", "2", "block", 0), ("g", "exit", "exit", 0)}
    assert {tuple(r)[1:] for r in cf.complexity(found).where("path = 'b.py'").collect()} == {("g", 0, 5, 5, 1, 1, 2)}
    assert cf.functions(spark.createDataFrame([], "path string, text string")).collect() == []


def test_unreached_blocks(spark):
    source = "def f():\n  try:\n    return 1\n  finally:\n    c()\n  d()\ndef g(x):\n  while x:\n    return\n    a()\n  b()\n"
    found = cf.functions(spark.createDataFrame([("a", source)], "path string, text string"))
    assert sorted(tuple(r) for r in cf.unreached(found).collect()) == [("a", "f", 0, "0"), ("a", "g", 0, "3")]


def test_operations_of_bodies(spark):
    files = spark.createDataFrame([("a.py", next(iter(DRAWN)))], "path string, text string")
    found = cf.functions(files)
    ops = cf.body_operations(found)
    rows = ops.collect()
    assert sorted((r["t"], r["phase"]) for r in rows) == [("edge:add", 9)] * 4 + [("graph:add", 4), ("node:add", 6), ("node:add", 6), ("node:add", 6), ("node:add", 6), ("node:detail", 7)]
    assert sorted(map(str, rows)) == sorted(map(str, cf.body_operations(cf.functions(files)).collect()))
    graph = next(r for r in rows if r["t"] == "graph:add")["id"]
    detail = next(r for r in rows if r["t"] == "node:detail")
    assert detail["next"] == graph
    from arborlake.model import Space

    space = Space.of(spark, [(detail["graph_id"], "a.py")], [(detail["graph_id"], detail["id"], "code:function", "f", None)], [])
    after = delta.apply(space, ops)
    assert after.nodes.where(F.col("graph_id") == graph).count() == 4 and after.edges.count() == 4
    assert after.edges.join(after.nodes.select(F.col("id").alias("src"), "graph_id"), ["src", "graph_id"], "left_anti").isEmpty()
    assert after.nodes.where(F.col("id") == detail["id"]).first()["detail_graph"] == graph
