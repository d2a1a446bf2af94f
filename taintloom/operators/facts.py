"""Fact extraction: a file's text in, flat rows out. Syntax never leaves the worker; everything later is relational.

Rows (FACTS): `source` and `sink` and `sanitize` marks of variables, `edge`s between them, `function`s with parameters
and `call`s with argument variables (linked across files by joins), module `var`s, `alias`es of imports, `span`s (lines of
functions and classes), `function_source`s (calls whose value a file or database gives; marks only on demand), and `error`
for files that can't be parsed. Variables carry their file and scope: path@scope:name, so equal names in different functions stay apart.
"""

from __future__ import annotations

import ast
import functools
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.functions.catalog import PYTHON_SINKS, PYTHON_SOURCES, SANITIZERS, sink_rows

from .code_facts import c_facts, php_facts
from .graph import cut

FACTS = "project_id string, path string, language string, seq long, kind string, var string, dst string, name string, vuln_type string, types array<string>, code string, line int, module string, args array<array<string>>, results array<string>, params array<string>, kwonly array<string>, prefix string, end int"
COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in FACTS.split(", ")])
#: Facts of one batch that leaves a worker.
BATCH = 50_000

# Calls that give a database connection, and names that stand for one.
CONNECTS = ["sqlite3.connect", "pymysql.connect", "MySQLdb.connect", "psycopg2.connect", "psycopg.connect", "mysql.connector.connect", "asyncpg.connect", "aiomysql.connect"]
DATABASE_NAMES = ["c", "cur", "cursor", "curs", "conn", "connection", "db", "database", "con"]

_CLEAN = {k: v or ["all"] for k, v in SANITIZERS["python"].items()}


def _short(name: str) -> str:
    """The last two parts of a catalogue name: its module's last part and the function."""
    return ".".join(name.split(".")[-2:])


def _sinks_by_name() -> dict[str, list[tuple[int, str, str, int | None]]]:
    out: dict[str, list[tuple[int, str, str, int | None]]] = {}
    for order, vuln, name, _, arg in sink_rows(PYTHON_SINKS):
        for key in dict.fromkeys((name, _short(name))):
            out.setdefault(key, []).append((order, vuln, name, arg))
    return out


_SINKS = _sinks_by_name()
_SINK_NAMES = {name for rows in _SINKS.values() for _, _, name, _ in rows}
#: Names that sources end with, and the catalogue entry of each.
_SOURCE_ENDS = {key: name for name in PYTHON_SOURCES for key in (name, _short(name))}
_END_LENGTHS = sorted({len(k) for k in _SOURCE_ENDS}, reverse=True)


def source_end(name: str) -> str | None:
    """The longest of the names that sources end with that `name` ends with: one lookup for each length there is."""
    return next((name[-n:] for n in _END_LENGTHS if n <= len(name) and name[-n:] in _SOURCE_ENDS), None)


@functools.lru_cache(maxsize=65_536)
def call_source(full: str, short: str) -> str | None:
    """The source that a call is: by its full name, else by the end of its name as it is written."""
    if full in _SOURCE_ENDS:
        return full
    end = source_end(short)
    return None if end is None else _SOURCE_ENDS[end]


@functools.lru_cache(maxsize=65_536)
def attribute_source(full: str) -> str | None:
    """The source that an attribute is: by its full name or the end of it."""
    return full if full in _SOURCE_ENDS else source_end(full)


def item_source(full: str) -> str | None:
    return next((k for k in (f"{full}.__getitem__", full) if k in _SOURCE_ENDS), None)


def dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        inner = dotted(node.func)
        return None if inner is None else ".".join([inner, *reversed(parts)])
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Nodes that give facts by themselves, and those that tell types.
_VISITED = {ast.Assign, ast.AugAssign, ast.AnnAssign, ast.NamedExpr, ast.For, ast.AsyncFor, ast.Return, ast.Call}
_TYPED = {ast.Assign, ast.With, ast.AsyncWith}
_CLOSED = {*_FUNCTIONS, ast.Lambda}
_KEPT = _VISITED | _TYPED | {*_FUNCTIONS}
#: Kinds that attributes and items give by themselves, wherever a value is made of one.
_OF_PARTS = {"source", "edge", "module_attr"}
#: Kinds that each class of nodes may lead to; a node that leads to no asked kind isn't visited.
_LEADS_TO = {ast.Call: {"source", "edge", "module_attr", "sink", "call"}, ast.Return: _OF_PARTS, ast.For: _OF_PARTS, ast.AsyncFor: _OF_PARTS, **dict.fromkeys((ast.Assign, ast.AugAssign, ast.AnnAssign, ast.NamedExpr), _OF_PARTS | {"sanitize"})}
#: Fields of each class of nodes that may hold nodes; contexts and operators give no facts.
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: ()}
#: Fields that hold statements, or what holds statements.
_BLOCKS = {"body", "handlers", "orelse", "finalbody", "cases"}


def children(node: ast.AST) -> list[ast.AST]:
    """A node's children in order, without contexts and operators."""
    kind = node.__class__
    fields = _FIELDS.get(kind)
    if fields is None:
        fields = _FIELDS[kind] = tuple(f for f in kind._fields if f not in ("ctx", "op", "ops", "id", "attr", "type_comment"))
    out: list[ast.AST] = []
    for f in fields:
        v = getattr(node, f, None)
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Statements of a file, breadth first, as `ast.walk` comes to them."""
    queue: deque[ast.AST] = deque([tree])
    while queue:
        node = queue.popleft()
        yield node
        for f in node._fields:
            if f in _BLOCKS:
                queue += getattr(node, f)


def calls_in(value: ast.AST) -> Iterator[ast.Call]:
    """Calls of an expression, breadth first."""
    queue = deque([value])
    while queue:
        node = queue.popleft()
        queue += children(node)
        if node.__class__ is ast.Call:
            yield node


def module_of(path: str, base: str) -> tuple[str, str]:
    """(module, package) of a file below the folder `base`."""
    parts = path.removeprefix(base).lstrip("/").removesuffix(".py").split("/")
    package = ".".join(parts[:-1])
    return (package if parts[-1] == "__init__" else ".".join(parts)), package


class PythonFacts:
    """One file's facts. Scopes: the module and every function; bodies of nested functions belong to those alone.
    `base`: the folder that all of the project's files are below, which is no part of module names. `wanted`: the kinds that
    are asked for; what only leads to others is passed over, so `seq` numbers the facts of these kinds alone."""

    def __init__(self, path: str, text: str, base: str = "", wanted: frozenset[str] | None = None) -> None:
        self.path, self.text, self.wanted = path, text, wanted
        self.visited = _VISITED if wanted is None else {k for k in _VISITED if _LEADS_TO[k] & wanted}
        self.of_parts = wanted is None or bool(_OF_PARTS & wanted)
        self.rows: list[dict[str, Any]] = []
        self.aliases: dict[str, str] = {}
        self.module, self.package = module_of(path, base)
        try:
            self.tree: ast.Module | None = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError) as e:
            self.tree = None
            self.add("error", name=type(e).__name__, code=str(e), line=getattr(e, "lineno", 0) or 0)
        self.lines = text.split("\n")

    def add(self, kind: str, **more: Any) -> None:
        if self.wanted is None or kind in self.wanted:
            self.rows.append({"kind": kind, "path": self.path, "language": "python", "seq": len(self.rows), "module": self.module, **more})

    def asks(self, kind: str) -> bool:
        return self.wanted is None or kind in self.wanted

    def line_text(self, node: ast.AST) -> str:
        n = getattr(node, "lineno", 0)
        return self.lines[n - 1].strip() if 0 < n <= len(self.lines) else ""

    def run(self) -> list[dict[str, Any]]:
        if self.tree is None:
            return self.rows
        self.imports()
        nodes, self.module_vars = self.own(self.tree.body)
        for v in sorted(self.module_vars):
            self.add("var", name=v, var=f"{self.path}@:{v}")
        self.scope("", self.tree.body, nodes, [], None, self.module_vars)
        return self.rows

    def imports(self) -> None:
        """Aliases of the whole file, wherever they are imported, and spans."""
        for node in statements(self.tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.alias(node, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0])
            elif isinstance(node, ast.ImportFrom):
                base = node.module or ""
                if node.level:
                    up = self.package.split(".")[: len(self.package.split(".")) - node.level + 1] if self.package else []
                    base = ".".join([*up, *([node.module] if node.module else [])])
                for a in node.names:
                    if a.name != "*":
                        self.alias(node, a.asname or a.name, f"{base}.{a.name}" if base else a.name)
            elif isinstance(node, _FUNCTIONS):
                self.add("span", name=node.name, dst="function", line=node.lineno, end=node.end_lineno or node.lineno)

    def alias(self, node: ast.AST, local: str, full: str) -> None:
        self.aliases[local] = full
        self.add("alias", name=local, dst=full, line=node.lineno)

    def own(self, body: list[ast.stmt]) -> tuple[list[ast.AST], set[str]]:
        """Nodes of a scope that give facts, types or scopes, in source order, without those of nested functions (classes stay
        in it), and the names that it assigns."""
        out: list[ast.AST] = []
        stored: set[str] = set()
        stack: list[ast.AST] = body[::-1]
        while stack:
            node = stack.pop()
            kind = node.__class__
            if kind is ast.Name:
                if node.ctx.__class__ is ast.Store:
                    stored.add(node.id)
            elif kind is not ast.Constant:
                if kind in _KEPT:
                    out.append(node)
                if kind not in _CLOSED:
                    stack += children(node)[::-1]
        return out, stored

    def scope(self, qual: str, body: list[ast.stmt], nodes: list[ast.AST], params: list[str], owner: str | None, local: set[str]) -> None:
        s = Scope(self, qual, owner, local | set(params))
        for p in params:
            if p not in ("self", "cls"):
                self.add("source", var=s.var(p), name="function.parameter", code=s.code, line=s.line)
        for node in nodes:
            if node.__class__ in _TYPED:
                s.types(node)
        for node in nodes:
            if node.__class__ in self.visited:
                s.visit(node)
        for node in nodes:
            if node.__class__ in _FUNCTIONS:
                holder = self.holder(body, node)
                name = ".".join(x for x in (qual, holder, node.name) if x)
                a = node.args
                every = [x.arg for x in [*a.posonlyargs, *a.args]]
                rest = [x.arg for x in (a.vararg, a.kwarg) if x]
                kwonly = [x.arg for x in a.kwonlyargs]
                self.add("function", name=name, params=every, kwonly=kwonly, prefix=f"{self.path}@{name}:", line=node.lineno)
                self.scope_of(node, name, [*every, *kwonly, *rest], ".".join(x for x in (qual, holder) if x) or None)

    def scope_of(self, node: ast.FunctionDef | ast.AsyncFunctionDef, name: str, params: list[str], owner: str | None) -> None:
        nodes, stored = self.own(node.body)
        self.current = (self.line_text(node), node.lineno)
        self.scope(name, node.body, nodes, params, owner, stored)

    def holder(self, body: list[ast.stmt], function: ast.AST) -> str:
        """The classes around a function within its scope, outermost first."""

        def find(nodes: list[ast.AST], names: list[str]) -> list[str] | None:
            for n in nodes:
                if n is function:
                    return names
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                    continue
                more = [*names, n.name] if isinstance(n, ast.ClassDef) else names
                if (got := find(list(ast.iter_child_nodes(n)), more)) is not None:
                    return got
            return None

        return ".".join(find(list(body), []) or [])


class Scope:
    def __init__(self, file: PythonFacts, qual: str, owner: str | None, local: set[str]) -> None:
        self.file, self.qual, self.owner, self.local = file, qual, owner, local
        self.kinds: dict[str, str] = {}
        self.code, self.line = getattr(file, "current", ("", 0)) if qual else ("", 0)
        self.marked: set[str] = set()

    def var(self, name: str) -> str:
        at = "" if self.qual and name not in self.local and name in self.file.module_vars else self.qual
        return f"{self.file.path}@{at}:{name}"

    def anon(self, kind: str, node: ast.AST) -> str:
        return f"{self.file.path}@{self.qual}:{kind}@{node.lineno}:{node.col_offset}"

    def full(self, name: str | None) -> str:
        if not name:
            return ""
        root, _, rest = name.partition(".")
        if root in self.kinds and rest:
            return f"{self.kinds[root]}.{rest}"
        if root in self.file.aliases:
            return ".".join(x for x in (self.file.aliases[root], rest) if x)
        return f"builtins.{root}" if not rest and root not in self.local and root not in self.file.module_vars else name

    def types(self, node: ast.AST) -> None:
        """Connections and cursors of databases, by what made them."""
        pairs = []
        if isinstance(node, ast.Assign):
            pairs = [(t, node.value) for t in node.targets]
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            pairs = [(i.optional_vars, i.context_expr) for i in node.items if i.optional_vars is not None]
        for target, value in pairs:
            if isinstance(target, ast.Name) and isinstance(value, ast.Call):
                name = dotted(value.func) or ""
                if self.full(name) in CONNECTS or name.endswith(".connect"):
                    self.kinds[target.id] = "db.Connection"
                elif name.endswith(".cursor"):
                    self.kinds[target.id] = "db.Cursor"

    def names(self, node: ast.AST | None) -> list[str]:
        """Variables that an expression's value is made of."""
        f = self.names
        if isinstance(node, ast.Name):
            return [self.var(node.id)]
        if isinstance(node, ast.Attribute):
            v = self.anon("attr", node)
            self.once(v, node)
            return [v]
        if isinstance(node, ast.Subscript):
            v = self.anon("item", node)
            self.once(v, node)
            return [v]
        if isinstance(node, ast.BinOp):
            return f(node.left) + f(node.right)
        if isinstance(node, ast.JoinedStr):
            return [n for x in node.values if isinstance(x, ast.FormattedValue) for n in f(x.value)]
        if isinstance(node, ast.Call):
            own = [self.anon("call", node)] if self.source_of(node) or self.is_known(node) else []
            through = f(node.func.value) if isinstance(node.func, ast.Attribute) and (not own or node.func.attr == "get") else []
            return own + through + [n for a in node.args for n in f(a)]
        if isinstance(node, ast.IfExp):
            return f(node.body) + f(node.orelse)
        if isinstance(node, (ast.List, ast.Tuple)):
            return [n for x in node.elts for n in f(x)]
        if isinstance(node, (ast.Starred, ast.Await)):
            return f(node.value)
        return []

    def source_of(self, node: ast.Call) -> str | None:
        name = dotted(node.func)
        return call_source(self.full(name), name) if name else None

    def is_known(self, node: ast.Call) -> bool:
        """May a call be one of the project's functions? Then its result is a variable of its own."""
        name = dotted(node.func) or ""
        return bool(name) and self.full(name) not in _CLEAN and not name.startswith("builtins.")

    def once(self, v: str, node: ast.AST) -> None:
        """An attribute's or item's own facts: a source if its name is one, and an edge from its object."""
        if v in self.marked or not self.file.of_parts:
            return
        self.marked.add(v)
        base = node.value
        chain = dotted(node if isinstance(node, ast.Attribute) else base)
        full = self.full(chain)
        found = attribute_source(full) if isinstance(node, ast.Attribute) else item_source(full)
        if found:
            self.file.add("source", var=v, name=found, code=self.file.line_text(node), line=node.lineno)
        for n in self.names(base):
            self.file.add("edge", var=n, dst=v, name="attribute", code=self.file.line_text(node), line=node.lineno)
        if isinstance(node, ast.Attribute) and isinstance(base, ast.Name) and base.id in self.file.aliases:
            self.file.add("module_attr", name=f"{self.file.aliases[base.id]}.{node.attr}", dst=v, line=node.lineno)

    def targets(self, node: ast.AST) -> list[str]:
        if isinstance(node, (ast.Tuple, ast.List)):
            return [t for x in node.elts for t in self.targets(x)]
        while isinstance(node, (ast.Attribute, ast.Starred)):
            node = node.value
        return [self.var(node.id)] if isinstance(node, ast.Name) else []

    def visit(self, node: ast.AST) -> None:
        add, code = self.file.add, self.file.line_text(node)
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.NamedExpr)) and node.value is not None:
            targets = [t for x in (node.targets if isinstance(node, ast.Assign) else [node.target]) for t in self.targets(x)]
            values = self.names(node.value) if targets and self.file.of_parts else []
            clean = [full for c in (calls_in(node.value) if targets and self.file.asks("sanitize") else ()) if (full := self.full(dotted(c.func))) in _CLEAN]
            for t in targets:
                for n in values:
                    add("edge", var=n, dst=t, name="assign", code=code, line=node.lineno)
                for full in clean:
                    add("sanitize", var=t, types=_CLEAN[full], name=full, line=node.lineno)
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            for t in self.targets(node.target):
                for n in self.names(node.iter):
                    add("edge", var=n, dst=t, name="loop", code=code, line=node.lineno)
        elif isinstance(node, ast.Return) and self.qual:
            for n in self.names(node.value):
                add("edge", var=n, dst=f"{self.file.path}@{self.qual}:#ret", name="return", code=code, line=node.lineno)
        elif isinstance(node, ast.Call):
            self.call(node, code)

    def call(self, node: ast.Call, code: str) -> None:
        add = self.file.add
        name = dotted(node.func) or ""
        full = self.full(name)
        result = self.anon("call", node)
        asks = self.file.asks
        if asks("source") and (found := self.source_of(node)):
            add("source", var=result, name=found, code=code, line=node.lineno)
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        for vuln, sink, arg in self.sinks(name, full) if asks("sink") or self.file.of_parts else ():
            at = arg or 0
            value = node.args[at] if at < len(node.args) else None
            if vuln == "command_execution" and full.startswith("subprocess.") and isinstance(value, (ast.List, ast.Tuple)) and not shell:
                continue
            for v in dict.fromkeys(self.names(value)):
                add("sink", var=v, name=sink, vuln_type=vuln, code=code, line=node.lineno)
        if name and full not in _CLEAN and (asks("call") or self.file.of_parts):
            own = self.owner and name.split(".")[0] in ("self", "cls")
            callee = ".".join([self.owner, *name.split(".")[1:]]) if own else name
            add("call", name=callee, code=full, var=result, args=[self.names(a) for a in node.args], params=[k.arg or "" for k in node.keywords], kwonly=[",".join(self.names(k.value)) for k in node.keywords], line=node.lineno, dst=self.qual)

    def sinks(self, name: str, full: str) -> list[tuple[str, str, int | None]]:
        """(type, sink, argument) of a call, the first of the catalogue for each type: by its full name, or by what is
        written if that is a catalogue name or the short form of one."""
        if name.endswith("objects.raw") and name.split(".")[-1] == "raw":
            return [("sql_injection", "django.db.models.query.raw", 0)]
        found: dict[str, tuple[str, str, int | None]] = {}
        hits = [r for r in _SINKS.get(full, ()) if full == r[2]] + _SINKS.get(name, [])
        for _, vuln, sink, arg in sorted(hits, key=lambda r: r[0]):
            found.setdefault(vuln, (vuln, sink, arg))
        root, last = name.split(".")[0], name.split(".")[-1]
        if "." in name and last in ("execute", "executemany", "executescript") and root in DATABASE_NAMES:
            found.setdefault("sql_injection", ("sql_injection", f"db.{last}", 0))
        elif name.endswith("session.execute"):
            found.setdefault("sql_injection", ("sql_injection", "sqlalchemy.session.execute", 0))
        return list(found.values())


def facts_of(language: str, path: str, text: str, base: str = "", wanted: frozenset[str] | None = None) -> list[dict[str, Any]]:
    if language == "python":
        return PythonFacts(path, text, base, wanted).run()
    return php_facts(path, text, wanted) if language == "php" else c_facts(path, text, wanted)


#: Projects whose folders may be broadcast: some 10 MB of names.
MOST_PROJECTS = 100_000


def common_folders(files: DataFrame) -> DataFrame:
    """(project_id, base): the folder that all Python files of a project are in, "" or ending with a slash. What the first and
    the last path in order share, all paths between them share too, so a minimum and a maximum are enough."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    ends = files.where(F.col("language") == "python").groupBy("project_id").agg(F.min(folder).alias("low"), F.max(folder).alias("high"))
    low, high = F.split("low", "/", -1), F.split("high", "/", -1)
    same = F.transform(low, lambda x, i: F.coalesce(x == F.get(high, i), F.lit(False)))
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(low) - 1).cast("int")
    return ends.select("project_id", F.concat(F.array_join(F.slice(low, 1, n), "/"), F.when(n > 0, "/").otherwise("")).alias("base"))


def extract(files: DataFrame, kinds: list[str] | None = None, ordered: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Facts of every file (project_id, path, language, text), one file at a time; of some kinds only, if these are given, so
    that no others leave a worker. A file that can't be parsed gives an `error` row and nothing else; null and empty texts
    give nothing. Projects are counted first, so that their folders are broadcast and no text is shuffled, unless there are
    more than MOST_PROJECTS of them. Only Python names modules by folders, so only its facts ask for them.

    ordered: `seq` numbers all of a file's facts, so each of them is found, asked for or not. Without it, `seq` numbers those
    of the asked kinds, and what leads to no such fact isn't looked at; the rows are the same but for that. Flat files are
    then read by the forms of their lines (`flat`).

    columns: those of FACTS that leave a worker, all if not given. Without `module`, projects' folders aren't looked for."""
    wanted = None if kinds is None else frozenset(kinds)
    only = None if ordered else wanted
    asked = COLUMNS if columns is None else columns

    def run(batches):
        from . import flat

        readers = {} if only is None else flat.readers(only)
        whole: list[tuple[str, dict[str, Any]]] = []
        lines: list[tuple[str, flat.Found]] = []
        for batch in batches:
            held = {c: x.to_numpy(zero_copy_only=False) for c, x in zip(batch.schema.names, batch.columns, strict=True)}
            blank = [""] * batch.num_rows
            for project, path, language, text, base in zip(*(held.get(c, blank) for c in ("project_id", "path", "language", "text", "base")), strict=True):
                if text:
                    found = readers[language].facts(path, text, base or "") if language in readers else None
                    if found is None:
                        whole += [(project, r) for r in facts_of(language, path, text, base or "", only) if wanted is None or r["kind"] in wanted]
                    else:
                        lines += [(project, f) for f in found]
                if len(whole) >= BATCH:
                    yield packed(whole, asked)
                    whole = []
                if len(lines) >= BATCH:
                    yield packed_lines(lines, asked)
                    lines = []
        yield packed(whole, asked)
        yield packed_lines(lines, asked)

    code = files.where(F.col("language").isin("python", "php", "c", "cpp")).select("project_id", "path", "language", "text")
    schema = ", ".join(c for c in FACTS.split(", ") if c.split()[0] in asked)
    if "module" not in asked:
        return code.select(*(c for c in code.columns if c != "project_id" or c in asked)).mapInArrow(run, schema).select(*asked)
    folders = cut(common_folders(files))
    few = folders.count() <= MOST_PROJECTS
    return code.join(F.broadcast(folders) if few else folders, "project_id", "left").select(*code.columns, "base").mapInArrow(run, schema).select(*asked)


def packed(rows: list[tuple[str, dict[str, Any]]], asked: list[str]) -> pa.RecordBatch:
    """A batch of (project, fact), with the columns asked for."""
    held = {k for _, r in rows for k in r}
    return batch_of(len(rows), asked, lambda c: [p for p, _ in rows] if c == "project_id" else [r.get(c) for _, r in rows] if c in held else None)


def packed_lines(rows: list[tuple[str, Any]], asked: list[str]) -> pa.RecordBatch:
    """The same of facts that are found by forms of lines, whose columns are made here."""
    from . import flat

    found = [f for _, f in rows]
    return batch_of(len(rows), asked, lambda c: [p for p, _ in rows] if c == "project_id" else flat.column(found, c))


def batch_of(n: int, asked: list[str], column: Callable[[str], list[Any] | None]) -> pa.RecordBatch:
    schema = pa.schema([f for f in _SCHEMA if f.name in asked])
    values = ((f, column(f.name)) for f in schema)
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if x is None else pa.array(x, f.type) for f, x in values], schema=schema)
