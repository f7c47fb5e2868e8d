import json

import pytest
from pyspark.sql import functions as F

from arborlake.operators import delta, validate
from arborlake.sources import code, control_flow

A = '''import os, pkg.util as u
from pkg import util, lost
from . import pkg
from .pkg.util import help as aid, twin, Thing
from pkg.util import *
from nowhere import gone
f = lambda x, y=1: aid(x)
def main(a: int, /, *, b: "str" = 2) -> bool:
    aid(); aid(twin())
    os.getcwd()
    util()
    gone()
    print(gone)
    def inner():
        aid()
    @aid()
    def other(x=aid()):
        pass
    return [f(i) for i in Thing()]
aid_ = 1
class C:
    @property
    def p(self): return self.q()
    @staticmethod
    def q(): self.q(); self.both(); cls.p(); q(); main(1)
    def both(self): pass
    def both(self, x): pass
    class D:
        def m(self): self.q(); self.m()
if x:
    def hidden(): pass
'''
UTIL = '''def help(): help()
def twin(): pass
def twin(): pass
class Thing:
    async def go(self):
        f"{help()}"
'''  # fmt: skip
FILES = [("a.py", A), ("pkg/util.py", UTIL), ("pkg/__init__.py", ""), ("bad.py", "def f(:"), ("pkg/sub/x.pyi", "from ..util import help\nfrom ...a import main\nfrom . import y\ndef go(): help(); main(); y()\n"), ("null.py", None)]


@pytest.fixture(scope="module")
def mods(spark):
    from arborlake.plans.scratch import written

    return written(code.modules(spark.createDataFrame(FILES, "path string, text string").repartition(3)), "mods")


def test_declarations(mods):
    got = {(r["path"], ".".join(s.split("#")[0] + ("#" if "#" in s else "") + s.partition("~")[1] + s.partition("~")[2] for s in r["scope"])): r for r in code.declarations(mods).collect()}
    assert set(got) == {("a.py", x) for x in ("f", "main", "C", "C.p", "C.q", "C.both#", "C.both#", "C.D", "C.D.m")} | {("pkg/util.py", x) for x in ("help", "twin#~0", "twin#~1", "Thing", "Thing.go")} | {("pkg/sub/x.pyi", "go")}
    main = got["a.py", "main"]
    assert (main["kind"], main["params"], main["returns"], main["signature"]) == ("function", 4, "bool", "(a: int, /, *, b: 'str'=2)")
    assert A[main["start"] : main["end"]].startswith("def main") and A[main["body"][0] : main["body"][1]].startswith("aid()")
    assert got["a.py", "C.p"]["flags"] == ["property"] and got["a.py", "C.q"]["flags"] == ["static"] and got["pkg/util.py", "Thing.go"]["flags"] == ["async"]
    assert (got["a.py", "f"]["kind"], got["a.py", "f"]["params"], got["a.py", "C.D.m"]["kind"]) == ("function", 2, "method")
    assert code._fnv("") == "811c9dc5" and code._fnv("a") == "e40c292c"


def test_imports(mods):
    got = {(r["path"], r["local"]): (r["kind"], r["module"], r["external"]) for r in code.resolved_imports(mods).collect()}
    assert got == {
        ("a.py", "os"): ("external", None, True), ("a.py", "u"): ("module", "pkg/util.py", False), ("a.py", "util"): ("decl", "pkg/__init__.py", False),
        ("a.py", "lost"): ("decl", "pkg/__init__.py", False), ("a.py", "pkg"): ("module", "pkg/__init__.py", False), ("a.py", "aid"): ("decl", "pkg/util.py", False),
        ("a.py", "twin"): ("decl", "pkg/util.py", False), ("a.py", "Thing"): ("decl", "pkg/util.py", False), ("a.py", "*"): ("namespace", "pkg/util.py", False),
        ("a.py", "gone"): ("external", None, True), ("pkg/sub/x.pyi", "help"): ("decl", "pkg/util.py", False), ("pkg/sub/x.pyi", "main"): ("decl", "a.py", False), ("pkg/sub/x.pyi", "y"): ("external", None, False),
    }


def test_calls(mods):
    names = {(r["path"], r["at"]): r["scope"][-1].split("#")[0] for r in code.declarations(mods).collect()}
    got = {}
    for r in code.resolved_calls(mods).collect():
        said = r["state"] if r["target"] is None else f"{r['target_path']}:{names[r['target_path'], r['target']]}"
        got.setdefault((r["path"], names[r["path"], r["decl"]]), []).append((r["start"], r["callee"], said))
    plain = {k: [x[1:] for x in sorted(v)] for k, v in got.items()}
    aid = ("aid", "pkg/util.py:help")
    assert plain == {
        ("a.py", "f"): [aid],
        ("a.py", "main"): [aid, aid, ("twin", "unresolved"), ("getcwd", "unresolved"), ("util", "unresolved"), ("gone", "external"), ("print", "unresolved"), aid, ("f", "a.py:f"), ("Thing", "pkg/util.py:Thing")],
        ("a.py", "p"): [("q", "a.py:q")],
        ("a.py", "q"): [("q", "a.py:q"), ("both", "unresolved"), ("p", "a.py:p"), ("q", "unresolved"), ("main", "a.py:main")],
        ("a.py", "m"): [("q", "unresolved"), ("m", "a.py:m")],
        ("pkg/util.py", "help"): [("help", "pkg/util.py:help")],
        ("pkg/util.py", "go"): [("help", "pkg/util.py:help")],
        ("pkg/sub/x.pyi", "go"): [("help", "pkg/util.py:help"), ("main", "a.py:main"), ("y", "external")],
    }


def test_links_lie_where_both_ends_meet(mods):
    got = {(r["holder"].split("\x1f")[-1], r["src"].replace("\x1f", ":"), r["dst"].replace("\x1f", ":"), r["kind"][5:]): (r["weight"], len(r["spans"])) for r in code.links(mods).collect()}
    assert got == {
        ("project", "a.py", "pkg", "imports"): (5.0, 0), ("project", "pkg", "a.py", "imports"): (1.0, 0), ("pkg", "pkg/sub", "pkg/util.py", "imports"): (1.0, 0),
        ("project", "a.py", "pkg", "calls"): (5.0, 3), ("project", "pkg", "a.py", "calls"): (1.0, 1), ("pkg", "pkg/sub", "pkg/util.py", "calls"): (1.0, 1),
        ("a.py", "a.py:main", "a.py:f", "calls"): (1.0, 1), ("C", "a.py:C:p", "a.py:C:q", "calls"): (1.0, 1), ("C", "a.py:C:q", "a.py:C:p", "calls"): (1.0, 1), ("a.py", "a.py:C", "a.py:main", "calls"): (1.0, 1),
        ("pkg/util.py", "pkg/util.py:Thing", "pkg/util.py:help", "calls"): (1.0, 1),
    }


def test_the_document_is_sound_and_takes_bodies(spark, mods):
    doc = code.code_document(mods)
    assert validate.validate(doc).collect() == []
    nodes = {(r["kind"], r["label"]): r["attrs"] for r in doc.nodes.collect()}
    assert {k: nodes["code:function", "main"][k] for k in ("code:calls-resolved", "code:calls-unresolved", "code:calls-external")} == {"code:calls-resolved": "6", "code:calls-unresolved": "4", "code:calls-external": "1"} or nodes["code:function", "main"]
    assert nodes["code:module", "bad.py"]["code:parse-error"] == "true" and nodes["code:module", "a.py"]["code:imports-external"] == "2"
    assert all(json.loads(v) is not None for a in nodes.values() for v in a.values())
    found = control_flow.functions(spark.createDataFrame(FILES, "path string, text string").where("text is not null"))
    ops = control_flow.body_operations(found).where("function = 'C.q'")
    after = delta.apply(doc, ops)
    assert after.nodes.where("kind = 'code:method' and label = 'q' and detail_graph is not null").count() == 1


def test_moved_code_makes_no_operation(spark, mods):
    from arborlake.plans.scratch import written

    read = lambda files: written(code.modules(spark.createDataFrame(files, "path string, text string")), "mods")
    before = code.code_document(mods)
    moved = [(p, t and "# moved\n\n" + t.replace("    def both(self): pass", "\n\n    def both(self): pass")) for p, t in FILES]
    assert code.diff_modulo_spans(before, code.code_document(read(moved))).collect() == []
    assert not delta.diff(before, code.code_document(read(moved))).isEmpty()
    changed = [(p, t and t.replace("    gone()\n", "").replace("def help(): help()", "def help():\n  help()\ndef new(): help()")) for p, t in moved]
    ops = code.diff_modulo_spans(before, code.code_document(read(changed))).collect()
    assert sorted((r["t"], r["key"]) for r in ops) == [("edge:add", None), ("node:add", None), ("node:attr", "code:calls-external")]
    new = json.loads(next(r["next"] for r in ops if r["t"] == "node:add"))
    assert new["label"] == "new" and new["attrs"]["code:span"] != "0"
    after = delta.apply(before, spark.createDataFrame(ops, "phase int, t string, graph_id string, id string, key string, prev string, next string"))
    assert code.diff_modulo_spans(after, code.code_document(read(changed))).collect() == []


def test_nothing(spark):
    none = code.modules(spark.createDataFrame([], "path string, text string"))
    doc = code.code_document(none)
    assert doc.nodes.count() == 1 and doc.edges.isEmpty() and code.resolved_calls(none).isEmpty()
    assert doc.graphs.where(F.col("label") == "project").count() == 2
