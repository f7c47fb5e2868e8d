"""Python projects as graphs: what files declare, import and call; which declaration a call means; the project's document.

Each file is read by a parser in Python, by itself, into facts: declarations, imports and calls. What needs other files is joins
over the facts: an import looks for the file that it means, a call for its one possible declaration, and links between files are put
where both ends lie in one graph.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, derived_id
from ..model import Space
from ..operators.delta import diff
from ..plans.scratch import written

DOMAIN = "code"
DECLARATION = "struct<at: int, parent: int, kind: string, name: string, scope: array<string>, again: boolean, start: int, end: int, body: array<int>, signature: string, params: int, returns: string, flags: array<string>, decorators: string>"
IMPORT = "struct<at: int, dots: int, segments: array<string>, named: boolean, start: int, end: int, bindings: array<struct<local: string, imported: string>>>"
CALL = "struct<decl: int, callee: string, receiver: string, start: int, end: int>"
FACTS = f"length int, decls array<{DECLARATION}>, imports array<{IMPORT}>, calls array<{CALL}>"
#: Attributes that say where something stands; a change of these alone is none.
SPANS = ["code:body-span", "code:call-sites", "code:span"]
SAMPLES = 3
#: A call is plain (a name), self (of the own object or class), member (of anything else) or dynamic.
_SCOPES = ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef | ast.Lambda


class _Places:
    """Places in a text as code points, from lines and bytes within them."""

    def __init__(self, text: str) -> None:
        self.lines = text.splitlines(keepends=True)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def __call__(self, line: int, byte: int) -> int:
        text = self.lines[line - 1] if line <= len(self.lines) else ""
        return self.starts[line - 1] + (byte if text.isascii() else len(text.encode()[:byte].decode(errors="ignore")))

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self(node.lineno, node.col_offset), self(node.end_lineno, node.end_col_offset)


def _fnv(text: str) -> str:
    h = 0x811C9DC5
    for c in map(ord, text):
        h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def _calls(body: list[ast.AST]) -> Iterator[ast.Call]:
    """Calls of a body in the order of the text; those of functions and classes inside are theirs."""
    work = list(reversed(body))
    while work:
        node = work.pop()
        if isinstance(node, _SCOPES):
            work += reversed(getattr(node, "decorator_list", []))
            continue
        if isinstance(node, ast.Call):
            yield node
        work += reversed(list(ast.iter_child_nodes(node)))


def _called(node: ast.Call) -> tuple[str | None, str]:
    match node.func:
        case ast.Name(id=name):
            return name, "plain"
        case ast.Attribute(attr=name, value=ast.Name(id="self" | "cls")):
            return name, "self"
        case ast.Attribute(attr=name):
            return name, "member"
    return None, "dynamic"


def _parameters(args: ast.arguments) -> list[ast.arg | None]:
    """Parameters as written; None for a lone slash or star."""
    out = [*args.posonlyargs, *([None] if args.posonlyargs else []), *args.args]
    out += [args.vararg] if args.vararg else [None] if args.kwonlyargs else []
    return out + args.kwonlyargs + ([args.kwarg] if args.kwarg else [])


def _shape(node: ast.AST, flags: list[str], note) -> tuple[str, int, str, str]:
    """Signature, number of parameters, return type, and a hash of what tells overloads apart: types, not names."""
    params = _parameters(node.args)
    types = [note(p.annotation) if p is not None and p.annotation else "" for p in params]
    returns = note(node.returns) if getattr(node, "returns", None) else ""
    told = [f if f in flags else "" for f in ("async", "static")] + ["", "abstract" if "abstract" in flags else ""]
    shape = "|".join([*told, f"arity={len(params)}", f"params={','.join(types)}", f"returns={returns}"])
    return f"({ast.unparse(node.args)})", len(params), returns, _fnv(shape)


def _flags(node: ast.AST, decorators: list[str]) -> list[str]:
    tails = [d.rpartition(".")[2] for d in decorators]
    tests = {
        "async": isinstance(node, ast.AsyncFunctionDef),
        "static": "staticmethod" in tails,
        "abstract": "abstractmethod" in tails or "abstractproperty" in tails,
        "classmethod": "classmethod" in tails,
        "property": "property" in tails or any("." in d and t in ("setter", "getter", "deleter") for d, t in zip(decorators, tails, strict=True)),
        "overload": "overload" in tails,
    }
    return [k for k, v in tests.items() if v]


def _facts(text: str) -> tuple[int, list[tuple], list[tuple], list[tuple]]:
    tree, at = ast.parse(text), _Places(text)
    note = lambda node: " ".join((ast.get_source_segment(text, node) or "").split())
    decls: list[list] = []
    calls: list[tuple] = []
    work: list[tuple] = [(tree.body, -1, ())]
    while work:
        body, parent, scope = work.pop()
        kind, here = "function" if parent < 0 else "method", []
        for stmt in body:
            match stmt:
                case ast.FunctionDef() | ast.AsyncFunctionDef():
                    decorators = [note(d) for d in stmt.decorator_list]
                    flags = _flags(stmt, decorators)
                    inside = (at.span(stmt.body[0])[0], at.span(stmt.body[-1])[1])
                    here.append((kind, stmt.name, stmt, stmt.body, inside, _shape(stmt, flags, note), flags, decorators))
                case ast.Assign(targets=[ast.Name(id=name)], value=ast.Lambda() as made) | ast.AnnAssign(target=ast.Name(id=name), value=ast.Lambda() as made):
                    here.append((kind, name, stmt, [made.body], at.span(made.body), _shape(made, [], note), [], []))
                case ast.ClassDef():
                    here.append(("class", stmt.name, stmt, None, None, ("", 0, "", ""), [], [note(d) for d in stmt.decorator_list]))
        names = [(name, shape[3]) for _, name, *_, shape, _, _ in here]
        for k, (kind_, name, node, own, inside, shape, flags, decorators) in enumerate(here):
            same = [n for n, (other, _) in enumerate(names) if other == name]
            again = len(same) > 1 and names.count(names[k]) > 1
            mark = (f"#{shape[3]}" if shape[3] else "") if len(same) > 1 else ""
            segment = name + mark + (f"~{same.index(k)}" if again else "")
            number = len(decls)
            decls.append((number, parent, kind_, name, [*scope, segment], again, *at.span(node), list(inside) if inside else None, *shape[:3], flags, ", ".join(decorators)))
            if own is None:
                work.append((node.body, number, (*scope, segment)))
            else:
                calls += [(number, *_called(c), *at.span(c)) for c in _calls(own)]
    return len(text), decls, _imports(tree, at), calls


def _imports(tree: ast.Module, at: _Places) -> list[tuple]:
    """Imports at the top of a file: (number, dots, segments, whether names are taken from it, start, end, bindings)."""
    out: list[tuple] = []
    for stmt in tree.body:
        if isinstance(stmt, ast.Import):
            for name in stmt.names:
                out.append((len(out), 0, name.name.split("."), False, *at.span(name), [(name.asname or name.name.split(".")[0], "")]))
        elif isinstance(stmt, ast.ImportFrom):
            segments = stmt.module.split(".") if stmt.module else []
            out.append((len(out), stmt.level, segments, True, *at.span(stmt), [("*" if n.name == "*" else n.asname or n.name, n.name) for n in stmt.names]))
    return out


def modules(files: DataFrame) -> DataFrame:
    """path and FACTS of Python sources (path, text); where a file doesn't parse, or its text is null, length and the facts are null.

    Paths may not repeat. Only declarations at the top of a file and in classes there count, and bindings of a name to a lambda; calls
    belong to the innermost of them. Places are code points.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                try:
                    out.append((path, *_facts(text)))
                except (SyntaxError, ValueError, RecursionError, TypeError):
                    out.append((path, None, None, None, None))
            frame = pd.DataFrame(out, columns=["path", "length", "decls", "imports", "calls"])
            yield frame.assign(length=frame["length"].astype("Int32"))

    return files.select("path", "text").mapInPandas(run, f"path string, {FACTS}")


def _folder(path: str) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def _files_by_stem(mods: DataFrame) -> DataFrame:
    """stem, file: the file that a dotted name with this path means; a plain file before a package."""
    path = F.col("path")
    tries = [(r"\.py$", 0), (r"\.pyi$", 1), (r"/__init__\.py$", 2), (r"/__init__\.pyi$", 3)]
    made = F.filter(F.array(*[F.struct(F.when(path.rlike(p), F.regexp_replace(path, p, "")).alias("stem"), F.lit(n).alias("n")) for p, n in tries]), lambda s: s["stem"].isNotNull())
    return mods.select("path", F.inline(made)).groupBy("stem").agg(F.min_by("path", "n").alias("file"))


def resolved_imports(mods: DataFrame) -> DataFrame:
    """path, at, place, local, kind, module, imported, external: what each imported name is bound to.

    kind: decl (a declaration of module), module, namespace (a star) or external (no file of the project). module is the file that the
    import depends on, or null. external: the whole import means no file.
    """
    stems = written(_files_by_stem(mods), "code-stems")
    parts = F.filter(F.split(_folder("path"), "/"), lambda s: s != "")
    base = F.when(F.col("i.dots") == 0, F.array().cast("array<string>")).otherwise(F.slice(parts, 1, F.greatest(F.size(parts) - F.col("i.dots") + 1, F.lit(0))))
    asked = mods.select("path", F.explode("imports").alias("i")).withColumn("stem", F.array_join(F.concat(base, F.col("i.segments")), "/"))
    asked = asked.select("path", "i.*", "stem").select("path", "at", "named", "segments", "stem", F.posexplode_outer("bindings").alias("place", "b")).select("*", "b.local", "b.imported").drop("b")
    inner = F.concat_ws("/", F.when(F.col("stem") != "", F.col("stem")), "imported")
    folders = mods.select(F.explode(F.expr("transform(sequence(0, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))")).alias("stem")).distinct().withColumn("folder", F.lit(True))
    found = asked.join(stems.withColumnRenamed("file", "own"), "stem", "left").join(folders, "stem", "left")
    found = found.withColumn("inner", inner).join(stems.select(F.col("stem").alias("inner"), F.col("file").alias("sub")), "inner", "left")
    # A dotted name is itself a module; without a name after the dots, it is the package's own file.
    is_module = F.col("own").isNotNull() & (~F.col("named") | (F.size("segments") > 0))
    exists = F.col("own").isNotNull() | (F.col("named") & F.coalesce("folder", F.lit(False)))
    star = F.col("imported") == "*"
    kind = (
        F.when(~exists, "external").when(~F.col("named"), "module").when(star, "namespace").when(is_module, "decl")
        .when(F.col("sub").isNotNull(), "module").when(F.col("own").isNotNull(), "decl").otherwise("external")
    )
    module = F.when(is_module | star | F.col("sub").isNull(), F.col("own")).otherwise(F.col("sub"))
    return found.select("path", "at", "place", "local", kind.alias("kind"), F.when(exists, module).alias("module"), "imported", (~exists).alias("external"))


def declarations(mods: DataFrame) -> DataFrame:
    """path and DECLARATION of facts."""
    return mods.select("path", F.inline("decls"))


def resolved_calls(mods: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """path, decl, callee, receiver, start, end, state, target_path, target: which declaration each call means.

    A plain name has the declarations at the top of its file and the import of that name as candidates; more than one, or none, is
    unresolved. An imported declaration must be the only one of its name at the top of its file. A call of the own object means the
    only member of that name in the class. What an import from outside binds is external; all else is unresolved.
    """
    imports = resolved_imports(mods) if imports is None else imports
    every = declarations(mods)
    named = every.groupBy("path", "parent", "name").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    named = written(named, "code-names")
    tops = named.where("parent = -1")
    bound = imports.where("local is not null").groupBy("path", F.col("local").alias("callee")).agg(F.max_by(F.struct("kind", "module", "imported"), F.struct("at", "place")).alias("b"))
    calls = mods.select("path", F.inline("calls"))
    owners = every.select("path", F.col("at").alias("decl"), "parent", F.col("kind").alias("owner"))
    plain, own = F.col("receiver") == "plain", (F.col("receiver") == "self") & (F.col("owner") == "method")
    c = calls.join(owners, ["path", "decl"])
    c = c.join(tops.select("path", F.col("name").alias("callee"), F.col("n").alias("locals"), F.col("at").alias("local_at")), ["path", "callee"], "left")
    c = c.join(bound, ["path", "callee"], "left")
    c = c.join(named.where("parent >= 0").select("path", "parent", F.col("name").alias("callee"), F.col("n").alias("members"), F.col("at").alias("member_at")), ["path", "parent", "callee"], "left")
    there = tops.select(F.col("path").alias("m"), F.col("name").alias("w"), F.col("n").alias("far"), F.col("at").alias("far_at"))
    c = c.join(there, (F.col("b.kind") == "decl") & (F.col("b.module") == F.col("m")) & (F.col("b.imported") == F.col("w")), "left")
    alone = F.coalesce("locals", F.lit(0)) + F.col("b").isNotNull().cast("int") == 1
    imported = plain & alone & F.col("b").isNotNull()
    target = F.when(own & (F.col("members") == 1), F.col("member_at")).when(plain & alone & (F.col("locals") == 1), F.col("local_at")).when(imported & (F.col("far") == 1), F.col("far_at"))
    state = F.when(target.isNotNull(), "resolved").when(imported & (F.col("b.kind") == "external"), "external").otherwise("unresolved")
    where = F.when(imported, F.col("b.module")).otherwise(F.col("path"))
    return c.select("path", "decl", "callee", "receiver", "start", "end", state.alias("state"), F.when(target.isNotNull(), where).alias("target_path"), target.alias("target"))


def counters(calls: DataFrame) -> DataFrame:
    """path, decl, resolved, unresolved, external: calls by state."""
    return calls.groupBy("path", "decl").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("resolved", "unresolved", "external")])


def _key(*segments) -> Column:
    """Where something is, as one text: its source, then its scopes."""
    return F.concat_ws(SEPARATOR, *segments)


def _address(project: str, path: str = "path", scope: Column | None = None) -> Column:
    """Keys of all that hold a file or declaration, from the project down to itself."""
    top = F.array(_key(F.lit(""), F.lit(project)))
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    if scope is None:
        return F.concat(top, above)
    return F.concat(top, above, F.transform(F.sequence(F.lit(1), F.size(scope)), lambda k: _key(F.col(path), F.slice(scope, 1, k))))


def links(mods: DataFrame, imports: DataFrame | None = None, calls: DataFrame | None = None, project: str = "project") -> DataFrame:
    """holder, src, dst, kind, weight, spans of the project's links (keys of what they join and of what holds both).

    A link goes between the two things that lie in the lowest graph common to both ends; links within one thing go. weight counts what
    was joined into one; spans are the first SAMPLES places of calls, by place.
    """
    imports = resolved_imports(mods) if imports is None else imports
    calls = resolved_calls(mods, imports) if calls is None else calls
    none = F.lit(None).cast("struct<start:int,end:int>")
    known = mods.where("decls is not null").select(F.col("path").alias("module"))
    used = imports.where("module is not null and module <> path").select("path", "at", "module").distinct().join(known, "module", "left_semi")
    used = used.select(_address(project).alias("a"), _address(project, "module").alias("b"), F.lit("code:imports").alias("kind"), none.alias("span"))
    scopes = declarations(mods).select("path", "at", "scope")
    found = calls.where("state = 'resolved'").join(scopes.withColumnsRenamed({"at": "decl", "scope": "s"}), ["path", "decl"])
    found = found.join(scopes.select(F.col("path").alias("target_path"), F.col("at").alias("target"), F.col("scope").alias("t")), ["target_path", "target"])
    found = found.select(_address(project, "path", F.col("s")).alias("a"), _address(project, "target_path", F.col("t")).alias("b"), F.lit("code:calls").alias("kind"), F.struct("start", "end").alias("span"))
    same = F.size(F.filter(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    at = F.least(same, F.size("a") - 1, F.size("b") - 1)
    placed = used.unionByName(found).withColumn("k", at).select(F.get("a", F.col("k") - 1).alias("holder"), F.get("a", F.col("k")).alias("src"), F.get("b", F.col("k")).alias("dst"), "kind", "span").where("src <> dst")
    # Equal places (of several files) are counted first; then every range of places keeps its first few, and the group the first of those.
    key = ["holder", "src", "dst", "kind"]
    counted = placed.groupBy(*key, "span").agg(F.count("*").alias("n")).withColumn("range", F.coalesce(F.floor(F.col("span.start") / 4096), F.lit(0)))
    repeated = F.flatten(F.collect_list(F.array_repeat("span", F.least("n", F.lit(SAMPLES)).cast("int"))))
    parts = counted.groupBy(*key, "range").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.filter(repeated, lambda x: x.isNotNull())), 1, SAMPLES).alias("spans"))
    return parts.groupBy(*key).agg(F.sum("n").cast("double").alias("weight"), F.slice(F.array_sort(F.flatten(F.collect_list("spans"))), 1, SAMPLES).alias("spans"))


def code_document(mods: DataFrame, project: str = "project") -> Space:
    """The project as a space: packages, modules, classes, functions and methods, with imports and calls as edges.

    A file that doesn't parse is a module without declarations, marked code:parse-error. Functions have the numbers of their calls by
    state, and no detail: bodies are read by control_flow. Places are attributes too (SPANS).
    """
    imports = written(resolved_imports(mods), "code-imports")
    calls = written(resolved_calls(mods, imports), "code-calls")
    node_id = lambda key: derived_id("n", F.lit(DOMAIN), key)
    graph_id = lambda key: derived_id("g", F.lit(DOMAIN), key)
    text = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    attrs = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(f"code:{k.replace('_', '-')}"), v)]), lambda k, v: v.isNotNull())
    flag = lambda test: F.when(test, F.lit("true"))
    top = _key(F.lit(""), F.lit(project))
    holder = F.when(_folder("path") == "", top).otherwise(_folder("path"))
    one = mods.sparkSession.range(1)
    empty = F.create_map().cast("map<string,string>")
    node = lambda df, graph, key, kind, label, detail, extra: df.select(graph.alias("graph_id"), node_id(key).alias("id"), kind.alias("kind"), label.alias("label"), detail.alias("detail_graph"), extra.alias("attrs"), F.lit("source").alias("origin"))
    name = lambda c: F.substring_index(c, "/", -1)

    folders = mods.select(F.explode(F.expr("transform(sequence(0, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))")).alias("path")).where("path <> ''").distinct()
    outside = imports.where("external").groupBy("path").agg(F.countDistinct("at").alias("outside"))
    files = mods.select("path", "length", F.coalesce(F.size("decls") > 0, F.lit(False)).alias("full")).join(outside, "path", "left")
    decls = declarations(mods).join(counters(calls).withColumnRenamed("decl", "at"), ["path", "at"], "left")
    inner = declarations(mods).where("parent >= 0").select("path", F.col("parent").alias("at")).distinct().withColumn("inner", F.lit(True))
    decls = decls.join(inner, ["path", "at"], "left")
    scope, callable_ = F.col("scope"), F.col("kind") != "class"
    own, outer = _key(F.col("path"), scope), F.when(F.size(scope) == 1, F.col("path")).otherwise(_key(F.col("path"), F.slice(scope, F.lit(1), F.size(scope) - 1)))
    count = lambda c: F.when(callable_, F.coalesce(c, F.lit(0)).cast("string"))
    said = lambda c: F.when(F.col(c) != "", text(F.col(c)))
    has = lambda f: flag(F.array_contains("flags", f))
    told = attrs(
        signature=F.when(callable_, text(F.col("signature"))), params=F.when(callable_, F.col("params").cast("string")), returns=said("returns"), decorators=said("decorators"), duplicate=flag(F.col("again")),
        async_=has("async"), static=has("static"), abstract=has("abstract"), classmethod=has("classmethod"), property=has("property"), overload=has("overload"),
        calls_resolved=count(F.col("resolved")), calls_unresolved=count(F.col("unresolved")), calls_external=count(F.col("external")),
        body_span=F.when(F.col("body").isNotNull(), F.to_json("body")), scope_path=F.when(F.col("body").isNotNull(), F.to_json("scope")), span=F.to_json(F.array("start", "end")),
    )
    told = F.transform_keys(told, lambda k, v: F.when(k == "code:async-", F.lit("code:async")).otherwise(k))
    nodes = (
        node(one, graph_id(F.lit("")), top, F.lit("code:project"), F.lit(project), graph_id(top), empty)
        .unionByName(node(folders, graph_id(holder), F.col("path"), F.lit("code:package"), name("path"), graph_id(F.col("path")), empty))
        .unionByName(node(files, graph_id(holder), F.col("path"), F.lit("code:module"), name("path"), F.when(F.col("full"), graph_id(F.col("path"))), attrs(language=F.lit('"python"'), parse_error=flag(F.col("length").isNull()), imports_external=F.col("outside").cast("string"))))
        .unionByName(node(decls, graph_id(outer), own, F.concat(F.lit("code:"), "kind"), F.col("name"), F.when(F.col("inner"), graph_id(own)), told))
    )
    graph = lambda df, key, label: df.select(graph_id(key).alias("id"), label.alias("label"), F.lit(DOMAIN).alias("domain"), F.lit("source").alias("origin"))
    graphs = (
        graph(one, F.lit(""), F.lit(project)).unionByName(graph(one, top, F.lit(project))).unionByName(graph(folders, F.col("path"), name("path")))
        .unionByName(graph(files.where("full"), F.col("path"), name("path"))).unionByName(graph(decls.where("inner"), own, F.col("name")))
    )
    found = links(mods, imports, calls, project).select(graph_id(F.col("holder")).alias("graph_id"), node_id(F.col("src")).alias("src"), node_id(F.col("dst")).alias("dst"), "kind", "weight", "spans")
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    sites = F.when(F.col("kind") == "code:calls", F.concat(F.lit('"'), places, F.lit('"')))
    edges = found.select("graph_id", derived_id("e", F.col("graph_id"), F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "src", "dst", "kind", "weight", attrs(confidence=F.lit('"syntactic"'), call_sites=sites).alias("attrs"), F.lit("source").alias("origin"))
    return Space(written(graphs, "code-graphs"), written(nodes, "code-nodes"), written(edges, "code-edges"))


def diff_modulo_spans(a: Space, b: Space, spans: list[str] = SPANS) -> DataFrame:
    """delta.diff() of two documents, in which places don't count: code that only moved makes no operation.

    Attributes in spans are compared by being there; where they come new, or with what comes new, they have their values.
    """
    is_span = lambda k: k.isin(spans)

    def still(df: DataFrame) -> DataFrame:
        return df.withColumn("attrs", F.transform_values("attrs", lambda k, v: F.when(is_span(k), F.lit("0")).otherwise(v)))

    ops = diff(a.with_(nodes=still(a.nodes), edges=still(a.edges)), b.with_(nodes=still(b.nodes), edges=still(b.edges)))
    real = b.nodes.select("id", F.lit("node").alias("what"), F.col("attrs").alias("real")).unionByName(b.edges.select("id", F.lit("edge").alias("what"), F.col("attrs").alias("real")))
    ops = ops.withColumn("what", F.substring_index("t", ":", 1)).join(real, ["id", "what"], "left")
    whole = "graph_id string, id string, kind string, label string, detail_graph string, src string, dst string, weight double, attrs map<string,string>, origin string"
    put = F.to_json(F.from_json("next", whole).withField("attrs", F.col("real")))
    next_ = F.when(F.col("t").isin("node:add", "edge:add") & F.col("real").isNotNull(), put).when((F.col("t") == "node:attr") & is_span(F.col("key")) & F.col("next").isNotNull(), F.try_element_at("real", F.col("key"))).otherwise(F.col("next"))
    return ops.select("phase", "t", "graph_id", "id", "key", "prev", next_.alias("next"))
