"""Python sources to nodes, calls and routes with the standard parser, a file at a time on the executors.

A file that does not parse gives no rows. Calls keep what the source states: the
receiver's name, the line, whether every run of the caller may repeat or skip it.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "id string, kind string, path string, start int, end int, cls string, doc string, params int, complexity int, depth int, bases array<string>, signature string, decorators array<string>, routes array<string>, entry string, attrs array<string>"
CALLS = "source string, path string, cls string, receiver string, name string, line int, loop boolean, cond boolean, rtype string, rmodule string"
#: decorators' names that state a route's method.
VERBS = ("get", "post", "put", "patch", "delete")
_BRANCH = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.comprehension)
_BLOCK = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def own(node: ast.AST):
    """Descendants of a function without those of functions and classes inside it."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (*_DEF, ast.ClassDef, ast.Lambda)):
            yield child
            yield from own(child)


def complexity(f: ast.AST) -> int:
    """1, and 1 for each decision and each further operand of and/or; default arms count 0."""
    total = 1
    for n in own(f):
        if isinstance(n, _BRANCH):
            total += 1 + (len(n.ifs) if isinstance(n, ast.comprehension) else 0)
        elif isinstance(n, ast.BoolOp):
            total += len(n.values) - 1
        elif isinstance(n, ast.match_case) and not (isinstance(n.pattern, ast.MatchAs) and n.pattern.pattern is None):
            total += 1
    return total


def depth(body: list[ast.stmt]) -> int:
    """Deepest nesting of blocks; elif stays on its level."""
    best = 0
    for s in body:
        if not isinstance(s, _BLOCK):
            continue
        inner = [depth(s.body) if hasattr(s, "body") else 0]
        rest = getattr(s, "orelse", [])
        if isinstance(s, ast.If) and len(rest) == 1 and isinstance(rest[0], ast.If):
            best = max(best, depth(rest))
        else:
            inner.append(depth(rest))
        for h in getattr(s, "handlers", []) + getattr(s, "cases", []):
            inner.append(depth(h.body))
        inner.append(depth(getattr(s, "finalbody", [])))
        best = max(best, 1 + max(inner))
    return best


def calls_of(f: ast.AST):
    """(receiver, name, line, loop, cond) of every call; the iterable of a for and a test are not inside."""

    def walk(n: ast.AST, loop: bool, cond: bool):
        if isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                yield None, n.func.id, n.lineno, loop, cond
            elif isinstance(n.func, ast.Attribute):
                yield ast.unparse(n.func.value), n.func.attr, n.lineno, loop, cond
        for name, value in ast.iter_fields(n):
            for c in value if isinstance(value, list) else [value]:
                if not isinstance(c, ast.AST) or isinstance(c, (*_DEF, ast.ClassDef, ast.Lambda)):
                    continue
                again = isinstance(n, (ast.For, ast.AsyncFor)) and name == "body" or isinstance(n, ast.While) and name in ("body", "test") or isinstance(n, (ast.ListComp, ast.SetComp, ast.GeneratorExp)) and name == "elt"
                maybe = isinstance(n, ast.If) and name in ("body", "orelse") or isinstance(n, ast.IfExp) and name in ("body", "orelse") or isinstance(n, ast.ExceptHandler) or isinstance(n, ast.match_case) and name == "body"
                yield from walk(c, loop or again, cond or maybe)

    for s in f.body:
        if not isinstance(s, (*_DEF, ast.ClassDef)):
            yield from walk(s, False, False)


def type_name(annotation: ast.expr | None) -> str | None:
    """The class that an annotation names: a name, the last part of a dotted one, a quoted one, or one of an Optional or | None."""
    if isinstance(annotation, ast.Constant) and isinstance(annotation.value, str):
        return annotation.value.rpartition(".")[2] if annotation.value.replace(".", "").isidentifier() else None
    if isinstance(annotation, ast.Name):
        return annotation.id
    if isinstance(annotation, ast.Attribute):
        return annotation.attr
    if isinstance(annotation, ast.Subscript) and type_name(annotation.value) == "Optional":
        return type_name(annotation.slice)
    if isinstance(annotation, ast.BinOp) and isinstance(annotation.op, ast.BitOr):
        sides = [x for x in (annotation.left, annotation.right) if not (isinstance(x, ast.Constant) and x.value is None)]
        return type_name(sides[0]) if len(sides) == 1 else None
    return None


def made(value: ast.expr | None) -> str | None:
    """The class that an expression makes an object of: a call of a capitalised name."""
    name = type_name(value.func) if isinstance(value, ast.Call) else None
    return name if name and name[:1].isupper() else None


def typed(f: ast.AST) -> dict[str, str]:
    """Names within a function or module that the source gives a class: annotated, or assigned an object made on the spot."""
    out: dict[str, str] = {}
    if isinstance(f, _DEF):
        a = f.args
        out |= {x.arg: t for x in [*a.posonlyargs, *a.args, *a.kwonlyargs] if (t := type_name(x.annotation))}
    lost = set()
    for n in f.body if isinstance(f, ast.Module) else own(f):
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and (t := type_name(n.annotation)):
            out[n.target.id] = t
        elif isinstance(n, ast.Assign):
            for x in n.targets:
                if isinstance(x, ast.Name):
                    t = made(n.value)
                    if t is None or out.get(x.id, t) != t:
                        lost.add(x.id)
                    else:
                        out[x.id] = t
    return {k: t for k, t in out.items() if k not in lost}


def attributes(c: ast.ClassDef) -> dict[str, str]:
    """Declared classes of a class's attributes: annotated in its body, or given to self by an annotated or made object."""
    out = {n.target.id: t for n in c.body if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and (t := type_name(n.annotation))}
    for f in c.body:
        if isinstance(f, _DEF):
            names = typed(f)
            for n in own(f):
                for x in [n.target] if isinstance(n, ast.AnnAssign) else n.targets if isinstance(n, ast.Assign) else []:
                    if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name) and x.value.id == "self":
                        t = type_name(n.annotation) if isinstance(n, ast.AnnAssign) else names.get(n.value.id) if isinstance(n.value, ast.Name) else made(n.value)
                        if t:
                            out.setdefault(x.attr, t)
    return out


def routes_of(f: ast.AST) -> list[str]:
    """METHOD /path of the decorators of a function."""
    out = []
    for d in f.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and str(d.args[0].value).startswith("/"):
            if d.func.attr in VERBS:
                out.append(f"{d.func.attr.upper()} {d.args[0].value}")
            elif d.func.attr == "route":
                listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
                methods = [e.value for e in listed.elts if isinstance(e, ast.Constant)] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
                out += [f"{str(x).upper()} {d.args[0].value}" for x in methods]
    return out


def parse(path: str, text: str) -> tuple[list[dict], list[dict]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    nodes, calls = [], []
    imported: dict[str, str] = {}  # a name here: the name in its module
    modules: dict[str, str] = {}  # a name here: the module
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom):
            imported |= {x.asname or x.name: x.name for x in n.names}
        elif isinstance(n, ast.Import):
            modules |= {x.asname or x.name: x.name for x in n.names}
    outside = typed(tree)

    def add_calls(source: str, cls: str | None, f: ast.AST) -> None:
        names = outside | (typed(f) if f is not tree else {})
        for r, c, line, loop, cond in calls_of(f):
            t = names.get(r) if r else None
            calls.append({"source": source, "path": path, "cls": cls, "receiver": imported.get(r, r), "name": imported.get(c, c) if r is None else c, "line": line, "loop": loop, "cond": cond, "rtype": imported.get(t, t), "rmodule": modules.get(r) if r else None})

    loaded = {c for r, c, *_ in calls_of(tree) if r is None}

    def visit(body: list[ast.stmt], cls: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                attrs = [f"{k}:{imported.get(t, t)}" for k, t in sorted(attributes(n).items())]
                nodes.append({"id": n.name, "kind": "class", "path": path, "start": start, "end": n.end_lineno, "cls": None, "doc": (ast.get_docstring(n) or "").partition("\n")[0], "params": 0, "complexity": 0, "depth": 0, "bases": [ast.unparse(b) for b in n.bases], "signature": f"class {n.name}", "decorators": [ast.unparse(d) for d in n.decorator_list], "routes": [], "entry": None, "attrs": attrs})
                visit(n.body, n.name)
            elif isinstance(n, _DEF):
                name = f"{cls}.{n.name}" if cls else n.name
                a = n.args
                params = [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]]
                start = min([n.lineno, *(d.lineno for d in n.decorator_list)])
                routes = routes_of(n)
                entry = "init" if cls and n.name == "__init__" else "module" if not cls and n.name in loaded else None
                nodes.append({"id": name, "kind": "endpoint" if routes else "method" if cls else "function", "path": path, "start": start, "end": n.end_lineno, "cls": cls, "doc": (ast.get_docstring(n) or "").partition("\n")[0], "params": len(params) - (bool(cls) and params[:1] in (["self"], ["cls"])), "complexity": complexity(n), "depth": depth(n.body), "bases": [], "signature": f"{n.name}({ast.unparse(a)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else ""), "decorators": [ast.unparse(d) for d in n.decorator_list], "routes": routes, "entry": entry, "attrs": []})
                add_calls(name, cls, n)
            else:  # definitions under if, try, with and loops
                for part in ("body", "orelse", "finalbody"):
                    visit(getattr(n, part, []), cls)
                for h in getattr(n, "handlers", []):
                    visit(h.body, cls)

    visit(tree.body, None)
    add_calls(path, None, tree)
    return nodes, calls


def _map(files: DataFrame, which: int, schema: str) -> DataFrame:
    py = files.where((F.col("lang") == "py") & F.col("text").isNotNull()).select("path", "text")
    kind = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    arrow = pa.schema([(c.split()[0], kind[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = parse(path, text)[which]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return py.mapInArrow(run, schema)


def nodes(files: DataFrame) -> DataFrame:
    """Classes, methods and functions of files(path, lang, text), with line ranges and measures."""
    return _map(files, 0, NODES)


def calls(files: DataFrame) -> DataFrame:
    """Every call with its caller; calls at load time have the file as their caller."""
    return _map(files, 1, CALLS)


def resolve(calls: DataFrame, nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(source, target, line, loop, cond) of calls whose target the source states; others are dropped.

    The receiver's class: the own one (self, cls), a declared attribute's (self.x), a typed name's, or a class by
    name; its method, or an ancestor's (up(cls, base)). A call without a receiver means a function of the file, else
    of the only file that defines it; one through a module's name a function of that module's file.
    """
    kept = ["source", "target", "line", "loop", "cond"]
    method = nodes.where("cls is not null").select(F.col("id").alias("target"), F.col("cls").alias("c"), F.substring_index("id", ".", -1).alias("n"))
    attr = nodes.where("kind = 'class'").select(F.col("id").alias("k"), F.explode("attrs").alias("x")).select("k", F.substring_index("x", ":", 1).alias("attr"), F.substring_index("x", ":", -1).alias("type"))
    call = calls.select("source", "path", "cls", "receiver", "name", "line", "loop", "cond", "rtype", "rmodule").withColumn("key", F.monotonically_increasing_id())
    own = F.col("receiver").isin("self", "cls") & F.col("cls").isNotNull()
    above = (F.col("receiver") == "super()") & F.col("cls").isNotNull()
    field = F.when(F.col("receiver").rlike(r"^self\.\w+$"), F.substring("receiver", 6, 1 << 30))
    call = call.withColumn("field", field).join(attr, (F.col("cls") == F.col("k")) & (F.col("field") == F.col("attr")), "left")
    on = F.when(own, F.col("cls")).when(above, F.lit(None)).when(F.col("field").isNotNull(), F.col("type")).otherwise(F.coalesce("rtype", "receiver"))
    call = call.withColumn("on", on)
    sent = call.where("receiver is not null")
    direct = sent.join(method, (F.col("on") == F.col("c")) & (F.col("name") == F.col("n")))
    found = direct.select(*kept)
    if up is not None:
        rest = sent.join(direct.select("key"), "key", "left_anti").withColumn("from", F.when(above, F.col("cls")).otherwise(F.col("on")))
        found = found.unionByName(rest.join(up.select(F.col("cls").alias("sub"), "base"), F.col("from") == F.col("sub")).join(method, (F.col("base") == F.col("c")) & (F.col("name") == F.col("n"))).select(*kept))
    function = nodes.where("cls is null and kind <> 'class'").select(F.col("id").alias("target"), F.col("path").alias("p"))
    through = call.where("rmodule is not null").join(function, F.col("name") == F.col("target")).where(F.concat(F.lit("/"), "p").endswith(F.concat(F.lit("/"), F.translate("rmodule", ".", "/"), F.lit(".py"))))
    bare = call.where("receiver is null")
    hit = bare.join(function, F.col("name") == F.col("target"))
    local = hit.where("path = p")
    far = hit.join(local.select("key"), "key", "left_anti").groupBy("key", *kept).agg(F.countDistinct("p").alias("files")).where("files = 1")
    return found.unionByName(through.select(*kept)).unionByName(local.select(*kept)).unionByName(far.select(*kept)).where("source <> target")


def django_routes(text: str) -> list[tuple[str, str]]:
    """(path, handler) of urlpatterns; include and handlers that are no name are left out."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("path", "re_path") and len(n.args) >= 2 and isinstance(n.args[0], ast.Constant):
            h = n.args[1]
            if isinstance(h, ast.Call) and isinstance(h.func, ast.Attribute) and h.func.attr == "as_view":
                h = h.func.value
            if isinstance(h, (ast.Attribute, ast.Name)):
                out.append((str(n.args[0].value), h.attr if isinstance(h, ast.Attribute) else h.id))
    return out


def attached(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, path, handler, id) of routes(file, path, handler) whose handler names one node(id); none or several: no row."""
    named = nodes.select("id", F.substring_index("id", ".", -1).alias("handler")).distinct()
    one = named.groupBy("handler").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("handler", "id")
    return routes.join(one, "handler").select("file", "path", "handler", "id")


def route_tables(files: DataFrame) -> DataFrame:
    """(file, path, handler) of route tables."""

    def run(batches):
        for b in batches:
            rows = [(p, r, h) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r, h in django_routes(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["file", "path", "handler"])

    return files.where(F.col("path").endswith("urls.py")).select("path", "text").mapInArrow(run, "file string, path string, handler string")
