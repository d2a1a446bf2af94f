"""Facts of flat files by the forms of their lines.

A file is flat if each of its lines is whole statements by itself. Such code repeats few forms with other names, so a form is
read once by its language's reader, and its facts are filled in for every line that has it. The form of a line is the line
with its names of letters with digits behind put as Q0_, Q1_ and so on, by first use and of the same width, so that columns
hold. No name that the readers know ends in a digit but those of KEPT, which stay as they are.

What isn't surely flat gives None and is read whole: functions, classes, blocks over lines, open brackets and strings,
backslashes, connections of databases, sessions. Facts are those of the whole file, in its order,
and only the columns of them that are asked for are made.
"""

from __future__ import annotations

import ast
import functools
import re
from typing import Any

from taintloom.functions.catalog import PHP_SINKS, PHP_SOURCES, PYTHON_SINKS, PYTHON_SOURCES, SANITIZERS

from . import code_facts, facts, syntax

#: Kinds that a line gives by itself, and functions, which flat files have none of.
KINDS = {"source", "function_source", "sink", "sanitize", "edge", "module_attr", "function"}
#: Forms that are kept, and characters of a line that may be one: more are read whole.
MOST_FORMS, MOST_LINE = 65_536, 300

_ZEROS = bytes.maketrans(b"123456789", b"000000000")


def masked(text: str) -> str:
    """An ASCII text with its digits put as 0."""
    return text.encode().translate(_ZEROS).decode()


_NAME = re.compile(r"\b([A-Za-z_]+\d+)\b", re.ASCII)
_PUT = re.compile(r"\bQ\d+_*", re.ASCII)
_AT = re.compile(r"@(\d+):(\d+)\Z")
_KNOWN = [PHP_SINKS, PHP_SOURCES, PYTHON_SINKS, PYTHON_SOURCES, SANITIZERS, facts.CONNECTS, facts.DATABASE_NAMES, code_facts.SERVER_KEYS, code_facts.SAFE_ECHO]
KEPT = tuple(sorted({masked(w.lower()) for w in re.findall(r"\w+", repr(_KNOWN)) if w[-1].isdigit() and not w.isdigit()}))
#: Words of PHP behind which the reader goes on past an end of a statement, or looks for a bracket.
_PHP_OPEN = {"function", "fn", "class", "interface", "trait", "enum", "if", "else", "elseif", "while", "do", "switch", "for", "foreach", "try", "catch", "finally", "declare", "static", "match", "use", "namespace", "__halt_compiler"}
_CLOSES = {")": "(", "]": "[", "}": "{"}


@functools.lru_cache(maxsize=MOST_FORMS)
def places(mask: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(where names stand, where other digits do, is that all one form?) in all lines that are this one but for their digits. It
    is if there are no other digits and no two names that could be the same."""
    names = [m.span() for m in _NAME.finditer(mask) if len(m[0]) > 3 and not m[0].lower().endswith(KEPT)]
    held = {k for a, b in names for k in range(a, b)}
    digits = [m.span() for m in re.finditer("0+", mask) if m.start() not in held]
    return names, digits, not digits and len({mask[a:b] for a, b in names}) == len(names)


def names_of(line: str, mask: str) -> list[str]:
    """The names in a line, each once. mask: the line, masked."""
    return list(dict.fromkeys([line[a:b] for a, b in places(mask)[0]]))


def form_of(line: str, mask: str) -> Any:
    """What tells a line's form; most often that is its mask, and its names aren't looked at. Lines of one form are equal but for
    the digits of names, and name the same where each other does."""
    at, digits, one = places(mask)
    if one:
        return mask
    names = [line[a:b] for a, b in at]
    own = list(dict.fromkeys(names))
    if len(own) == len(names) and not digits:
        return mask
    return mask, tuple(line[a:b] for a, b in digits), tuple(map(own.index, names))


def written(line: str) -> str:
    """A line with its names put."""
    mask = masked(line)
    at, own = places(mask)[0], names_of(line, mask)
    out, end = [], 0
    for a, b in at:
        out += [line[end:a], f"Q{own.index(line[a:b])}".ljust(b - a, "_")]
        end = b
    return "".join(out) + line[end:]


class Template:
    """One fact of a form: what is the same for all lines, and patterns of what isn't: {0} the path, {1} the line's number,
    {2} and so on its names."""

    def __init__(self, row: dict[str, Any], form: str, line: int) -> None:
        self.same = {k: v for k, v in row.items() if k not in ("path", "seq", "module", "line", "code", "var", "dst")}
        self.start = form.index(row["code"]) if row.get("code") is not None else None
        self.end = None if self.start is None else self.start + len(row["code"])
        self.var, self.dst = (self.pattern(row.get(c), line) for c in ("var", "dst"))
        if row["line"] != line or any(isinstance(v, str) and _PUT.search(v) for v in self.same.values()):
            raise ValueError("a fact of another line, or a name where none is expected")

    @staticmethod
    def pattern(value: str | None, line: int) -> str | None:
        if value is None:
            return None
        at = _AT.search(value)
        if at and int(at[1]) != line:
            raise ValueError("an expression of another line")
        head, tail = (value[: at.start()], f"@{{1}}:{at[2]}") if at else (value, "")
        head = head.replace("{", "{{").replace("}", "}}")
        return "{0}" + _PUT.sub(lambda m: f"{{{int(re.sub('[Q_]', '', m[0])) + 2}}}", head) + tail


#: (template, path, line's number, line, names, module, seq): a fact before its columns are made.
Found = tuple[Template, str, int, str, list[str], str, int]


def column(found: list[Found], name: str) -> list[Any] | None:
    """A column of facts; None if none of them has it."""
    if name == "var":
        return [t.var and t.var.format(path, n, *names) for t, path, n, _, names, _, _ in found]
    if name == "dst":
        return [t.dst and t.dst.format(path, n, *names) for t, path, n, _, names, _, _ in found]
    if name == "code":
        return [None if t.start is None else line[t.start : t.end] for t, _, _, line, _, _, _ in found]
    if name in _PLACES:
        k = _PLACES[name]
        return [x[k] for x in found]
    return [t.same.get(name) for t, *_ in found] if name in _SAME else None


def rows(found: list[Found]) -> list[dict[str, Any]]:
    """Facts as a reader of whole files gives them."""
    return [{**t.same, "path": path, "seq": seq, "module": module, "line": n, "code": None if t.start is None else line[t.start : t.end], "var": t.var and t.var.format(path, n, *names), "dst": t.dst and t.dst.format(path, n, *names)} for t, path, n, line, names, module, seq in found]


def edges(found: list[Found]) -> list[tuple[str, str]]:
    """Both ends of the edges among facts."""
    return [(t.var.format(path, n, *names), t.dst.format(path, n, *names)) for t, path, n, _, names, _, _ in found if t.same["kind"] == "edge"]


_PLACES = {"path": 1, "line": 2, "module": 5, "seq": 6}
_SAME = {"kind", "language", "name", "vuln_type", "types"}


def plain(text: str) -> bool:
    """May a text be flat? Columns count bytes in Python and characters here, so what isn't ASCII isn't."""
    return text.isascii() and not ("\\" in text or "\r" in text or "\f" in text or "Q" in text and _PUT.search(text))


class PhpLines:
    """Facts of flat PHP files, of some kinds."""

    def __init__(self, wanted: frozenset[str]) -> None:
        self.wanted = wanted
        self.forms: dict[Any, list[Template] | None] = {}
        #: The facts of all lines of a mask, where that is one form.
        self.masks: dict[str, list[Template]] = {}

    def read(self, form: str) -> list[Template] | None:
        text = "<?php\n" + form
        if len(form) > MOST_LINE or any(x in form for x in ("?>", "/*", "<<<", "`")):
            return None
        held: list[str] = []
        toks = syntax.tokens(text, True)[1:]
        for t in toks:
            if t.line != 2 or t.kind == "other" and t.text in "'\"" or t.kind == "name" and t.text.lower() in _PHP_OPEN:
                return None
            if t.kind in ("op", "other") and t.text in ("(", "[", "{"):
                held.append(t.text)
            elif t.kind in ("op", "other") and t.text in _CLOSES and (not held or held.pop() != _CLOSES[t.text]):
                return None
        if held or toks and toks[-1].text != ";":
            return None
        trees, more = syntax.read(text, True), syntax.read(text + "\n$z = 1;", True)
        if more[:-1] != trees or more[-1].start != len(text) + 1:  # the line's statements end with it
            return None
        try:
            return [Template(r, form, 2) for r in code_facts.php_facts("", text, self.wanted)]
        except ValueError:
            return None

    def facts(self, path: str, text: str, base: str = "") -> list[Found] | None:
        if not text.startswith("<?php\n") or "_SESSION" in text or not plain(text):
            return None
        out: list[Found] = []
        lines: list[str] = []
        for number, mask in enumerate(masked(text).split("\n"), 1):
            found = self.masks.get(mask)
            if found == [] or number == 1:  # most lines give nothing, and aren't cut out of the text
                continue
            lines = lines or text.split("\n")
            line = lines[number - 1]
            if found is None:
                form = form_of(line, mask)
                try:
                    found = self.forms[form]
                except KeyError:
                    if len(self.forms) >= MOST_FORMS:
                        self.forms.clear()
                        self.masks.clear()
                    found = self.forms[form] = self.read(written(line))
                if found is None:
                    return None
                if places(mask)[2]:
                    self.masks[mask] = found
            if found:
                names = names_of(line, mask)
                for t in found:
                    out.append((t, path, number, line, names, "", len(out)))
        return out


class PythonLines:
    """Facts of flat Python files, of some kinds. What a line's names mean depends on the file's imports and on which known
    names it assigns: both are the context that a form is read in."""

    def __init__(self, wanted: frozenset[str]) -> None:
        self.wanted = wanted
        self.outlines: dict[Any, tuple | None] = {}
        self.contexts: dict[tuple, dict[Any, list[Template] | None]] = {}
        self.kept = 0

    def outline(self, form: str) -> tuple | None:
        """(aliases, assigned names that stay as they are) of a line; None if it isn't flat."""
        if len(form) > MOST_LINE:
            return None
        f = facts.PythonFacts("", form, wanted=frozenset())
        if f.tree is None:
            return None
        for node in ast.walk(f.tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.With, ast.AsyncWith)) or isinstance(node, ast.ImportFrom) and node.level:
                return None
        f.imports()
        if any(_PUT.search(x) for pair in f.aliases.items() for x in pair):
            return None
        stored = f.own(f.tree.body)[1]
        return tuple(f.aliases.items()), tuple(sorted(x for x in stored if not _PUT.fullmatch(x)))

    def read(self, form: str, context: tuple) -> list[Template] | None:
        f = facts.PythonFacts("", form, wanted=self.wanted)
        f.aliases = {k: v for aliases, _ in context for k, v in aliases}
        nodes, stored = f.own(f.tree.body)
        f.module_vars = stored.union(*(names for _, names in context))
        scope = facts.Scope(f, "", None, f.module_vars)
        for node in nodes:
            if isinstance(node, ast.Assign):
                scope.types(node)
        if scope.kinds:  # a connection, which other lines' names depend on
            return None
        f.scope("", f.tree.body, nodes, [], None, f.module_vars)
        try:
            return [Template(r, form, 1) for r in f.rows]
        except ValueError:
            return None

    def facts(self, path: str, text: str, base: str = "") -> list[Found] | None:
        if "\n " in text or "\n\t" in text or not plain(text):
            return None
        lines, masks = text.split("\n"), masked(text).split("\n")
        forms = list(map(form_of, lines, masks))
        context = []
        for line, form in zip(lines, forms, strict=True):
            try:
                found = self.outlines[form]
            except KeyError:
                if len(self.outlines) >= MOST_FORMS:
                    self.outlines.clear()
                found = self.outlines[form] = self.outline(written(line))
            if found is None:
                return None
            if found[0] or found[1]:
                context.append(found)
        key = tuple(context)
        known = self.contexts.get(key)
        if known is None:
            known = self.contexts[key] = {}
        out: list[Found] = []
        module = None
        for number, (line, mask, form) in enumerate(zip(lines, masks, forms, strict=True), 1):
            try:
                found = known[form]
            except KeyError:
                self.kept += 1
                if self.kept >= MOST_FORMS:
                    self.contexts.clear()
                    self.contexts[key] = known = {}
                    self.kept = 0
                found = known[form] = self.read(written(line), key)
            if found is None:
                return None
            if found:
                names = names_of(line, mask)
                if module is None:
                    module = facts.module_of(path, base)[0]
                for t in found:
                    out.append((t, path, number, line, names, module, len(out)))
        return out


@functools.lru_cache(maxsize=16)
def readers(wanted: frozenset[str]) -> dict[str, PhpLines | PythonLines]:
    """Readers of flat files by language, for kinds that lines give by themselves; none for others. A worker keeps its
    forms from task to task."""
    return {"python": PythonLines(wanted), "php": PhpLines(wanted)} if wanted <= KINDS else {}
