"""A tolerant reader of PHP and C: tokens, then expression trees by operator precedence.

It knows strings, comments, calls, item and member reads, assignments and declarations. Statements have no tree: what is
not part of an expression is passed over, so a construct that it doesn't know costs that construct only. Work is linear in
the text, but for nesting, which is read to DEPTH levels; what is deeper is passed over too.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

DEPTH = 200

_COMMON = r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)%s)|(?P<number>\d[\w.]*)|(?P<op>%s)|(?P<other>.)"
_PHP_OPS = ["<<<", "===", "!==", "<=>", "**=", "...", "<<=", ">>=", "??=", "?->", "==", "!=", "<>", "<=", ">=", "&&", "||", "??", "->", "::", "=>", "++", "--", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<", ">>", "**"]
_C_OPS = ["...", "<<=", ">>=", "->", "::", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>"]
_STRINGS = r"(?P<raw>'(?:\\.|[^'\\])*')|(?P<text>\"(?:\\.|[^\"\\])*\")|"
_PHP = re.compile(r"(?P<close>\?>)|(?P<heredoc><<<[ \t]*(?P<q>['\"]?)(?P<mark>\w+)(?P=q)\n.*?\n[ \t]*(?P=mark)\b)|" + _STRINGS + r"(?P<var>\$+\w+)|(?P<name>\\?[A-Za-z_]\w*(?:\\\w+)*)|" + _COMMON % (r"|#(?!\[)[^\n]*", "|".join(map(re.escape, _PHP_OPS))), re.DOTALL)
_PHP_OPENS = re.compile(r"<\?(?:php\b|=)?")
_C = re.compile(r"(?P<directive>^[ \t]*#(?:\\\n|[^\n])*)|" + _STRINGS + r"(?P<name>[A-Za-z_]\w*)|" + _COMMON % ("", "|".join(map(re.escape, _C_OPS))), re.DOTALL | re.MULTILINE)

#: How tightly operators bind; those of RIGHT group to the right.
BINDS = {"or": 1, "xor": 2, "and": 3, "?": 6, "??": 7, "||": 8, "&&": 9, "|": 10, "^": 11, "&": 12, "==": 13, "!=": 13, "===": 13, "!==": 13, "<>": 13, "<=>": 13, "<": 14, ">": 14, "<=": 14, ">=": 14, "<<": 16, ">>": 16, "+": 17, "-": 17, "*": 18, "/": 18, "%": 18, "instanceof": 20, "**": 21}
ASSIGNS = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}
RIGHT = {"??", "**"}
COMPARES = {"==", "!=", "===", "!==", "<>", "<=>", "<", ">", "<=", ">="}
_UNARY = 19
_QUOTED = {"raw", "text", "heredoc"}
_PHP_WORDS = {"new", "clone", "print", "include", "include_once", "require", "require_once", "throw", "yield", "return", "echo", "static", "global", "public", "private", "protected", "final", "abstract", "readonly", "const", "case", "default", "else", "do", "try", "finally", "extends", "implements", "as", "use", "namespace", "break", "continue", "goto", "var"}
_C_WORDS = {"return", "else", "do", "case", "default", "goto", "break", "continue", "try", "throw", "new", "delete", "public", "private", "protected", "using", "namespace", "typedef", "extern", "inline"}
_C_TYPES = {"void", "char", "short", "int", "long", "float", "double", "signed", "unsigned", "struct", "union", "enum", "const", "volatile", "static", "register", "auto", "bool", "wchar_t", "FILE", "string"}


#: Kinds of tokens that are passed over, and those that may hold an end of a line.
_PASSED = {"space", "comment", "directive"}
_LONG = _PASSED | _QUOTED | {"other"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    line: int


@dataclass(slots=True)
class Node:
    """kind: var, name, string, template, number, call, method, static, item, member, binary, assign, ternary, unary, cast,
    array, declare, function, echo; `text`: its name or operator; `kids`: operands, a call's arguments."""

    kind: str
    text: str
    start: int
    end: int
    line: int
    kids: list[Node] = field(default_factory=list)
    head: Node | None = None

    def walk(self) -> Iterator[Node]:
        """The node and those below it, each before its parts, in source order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.kids)
            if n.head is not None:
                stack.append(n.head)


@lru_cache(maxsize=4)
def tokens(text: str, php: bool) -> list[Token]:
    """Tokens without white space and comments. PHP outside of its marks is one `html` token. Expressions and spans of a file
    are read from the same tokens, so the last list is kept; readers don't change it."""
    out: list[Token] = []
    at, line, n = 0, 1, len(text)
    pattern = _PHP if php else _C
    while at < n:
        if php and (not out or out[-1].kind == "close"):
            m = _PHP_OPENS.search(text, at)
            end = m.end() if m else n
            out.append(Token("html", "<?=" if m and m[0] == "<?=" else ";", at, line))
            if m and m[0] == "<?=":
                out.append(Token("name", "echo", m.start(), line + text.count("\n", at, m.start())))
            line += text.count("\n", at, end)
            at = end
            continue
        m = pattern.match(text, at)
        kind, found = m.lastgroup, m[0]
        if kind == "q" or kind == "mark":
            kind = "heredoc"
        if kind not in _PASSED:
            out.append(Token(kind, found, at, line))
        if kind in _LONG:
            line += found.count("\n")
        at = m.end()
    return out


class Reader:
    """Top-level expressions of a token list, in source order."""

    def __init__(self, text: str, php: bool) -> None:
        self.text, self.php = text, php
        self.toks = tokens(text, php)
        # What each token reads as (strings as nothing) and its kind: looked up far more often than there are tokens.
        self.reads = ["" if t.kind in _QUOTED else t.text for t in self.toks]
        self.kinds = [t.kind for t in self.toks]
        self.at, self.depth = 0, 0
        self.words = _PHP_WORDS if php else _C_WORDS

    def peek(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.reads[i] if i < len(self.reads) else ""

    def kind(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.kinds[i] if i < len(self.kinds) else ""

    def node(self, kind: str, text: str, first: Token, kids: list[Node] | None = None, head: Node | None = None, start: Node | None = None) -> Node:
        last = self.toks[self.at - 1]
        begin, line = (start.start, start.line) if start else (first.start, first.line)
        return Node(kind, text, begin, last.start + len(last.text), line, kids or [], head)

    def statements(self) -> Iterator[Node]:
        while self.at < len(self.toks):
            before = self.at
            yield from self.statement()
            self.at = max(self.at, before + 1)

    def statement(self) -> Iterator[Node]:
        t = self.toks[self.at]
        low = t.text.lower() if t.kind == "name" else ""
        if self.peek() in ("{", "}", ";"):
            self.at += 1
        elif self.php and low in ("echo", "print"):
            self.at += 1
            kids = [x for x in self.listed() if x]
            yield self.node("echo", low, t, kids)
        elif self.php and low == "function" and self.kind(1) == "name" or self.php and low == "function" and self.peek(1) == "&":
            while self.at < len(self.toks) and self.peek() != "(":
                self.at += 1
            self.skip()
        elif low in ("class", "interface", "trait") and self.php:
            while self.at < len(self.toks) and self.peek() not in ("{", ";"):
                self.at += 1
        elif low in ("if", "elseif", "while", "switch", "for", "foreach", "catch", "declare"):
            self.at += 1
            if self.peek() == "(":
                self.at += 1
                while self.at < len(self.toks) and self.peek() not in (")", "{", "}"):
                    before = self.at
                    yield from ([self.declaration()] if not self.php and self.declares() else [x] if (x := self.expression(0)) else [])
                    self.at = max(self.at, before + 1) if self.peek() not in (")", "{", "}") or self.at == before else self.at
                self.at += self.peek() == ")"
        elif low in self.words:
            self.at += 1
        elif not self.php and (made := self.declared()):
            yield from made
        elif x := self.expression(0):
            yield x

    def listed(self) -> list[Node]:
        out = []
        while True:
            if x := self.expression(0):
                out.append(x)
            if self.peek() != ",":
                return out
            self.at += 1

    def skip(self) -> None:
        """Over a bracket and what is in it."""
        depth = 0
        while self.at < len(self.toks):
            c = self.peek()
            depth += c in ("(", "[", "{")
            depth -= c in (")", "]", "}")
            self.at += 1
            if depth <= 0:
                return

    # C declarations

    def declares(self) -> bool:
        """Do a type and a name begin here?"""
        i, names = 0, 0
        while self.kind(i) == "name" and self.peek(i) not in self.words or names and self.peek(i) in ("*", "&", "::"):
            if self.peek(i) == "::":
                names -= 1
            names += self.kind(i) == "name"
            i += 1
        if names >= 1 and self.peek(i) == "(" and self.peek(i + 1) == "*" and self.peek(i + 3) == ")" and self.peek(i + 4) == "(":
            return True
        if names == 1 and self.peek(i) == "<" and self.kind(i + 1) == "name":  # a template's arguments
            return False
        return names >= 2 and self.kind(i - 1) == "name" and self.peek(i) in ("=", ";", ",", "[", "(", ":", ")")

    def declared(self) -> list[Node]:
        if not self.declares():
            return []
        out = [self.declaration()]
        while self.peek() == ",":
            self.at += 1
            out.append(self.declaration())
        return out

    def declaration(self) -> Node:
        """A declarator with its value, or a function with its parameters as names."""
        first = self.toks[self.at]
        name, kids = "", []
        while self.kind() == "name" or self.peek() in ("*", "&", "::"):
            name = self.peek() if self.kind() == "name" else name
            self.at += 1
        if self.peek() == "(" and self.peek(1) == "*":
            name = self.peek(2)
            self.at += 4
            self.skip()
        elif self.peek() == "(":
            start, depth, last, last_token = self.at, 0, "", first
            while self.at < len(self.toks):
                c = self.peek()
                depth += c == "("
                depth -= c == ")"
                if c in (",", ")") and last and depth <= 1:
                    kids.append(Node("name", last, last_token.start, last_token.start + len(last), last_token.line))
                    last = ""
                if self.kind() == "name":
                    last, last_token = c, self.toks[self.at]
                self.at += 1
                if not depth:
                    break
            if self.peek() == "{" or self.peek() == "const":
                return self.node("function", name, first, kids)
            self.at = start
            values = self.arguments()
            return self.node("declare", name, first, values)
        while self.peek() == "[":
            self.skip()
        if self.peek() == "=":
            self.at += 1
            value = self.expression(4)
            kids = [value] if value else []
        return self.node("declare", name, first, kids)

    # expressions

    def arguments(self) -> list[Node]:
        """Of a call whose opening bracket is next; names of named arguments are passed over."""
        self.at += 1
        out = []
        while self.at < len(self.toks) and self.peek() not in (")", ";", "{", "}"):
            before = self.at
            if self.peek() == ",":
                self.at += 1
                continue
            if self.php and self.kind() == "name" and self.peek(1) == ":" and self.peek(2) != ":":
                self.at += 2
            if x := self.expression(4):
                out.append(x)
            if self.at == before:
                self.at += 1
        self.at += self.peek() == ")"
        return out

    def expression(self, least: int) -> Node | None:
        self.depth += 1
        try:
            if self.depth > DEPTH:
                return None
            left = self.prefix()
            while left is not None:
                op = self.peek().lower() if self.kind() == "name" else self.peek()
                if op == "." and self.php:
                    bind = 15
                elif op in ASSIGNS:
                    bind = 5
                elif op in BINDS and self.kind() in ("op", "other", "name"):
                    bind = BINDS[op]
                else:
                    return left
                if bind <= least and not (op in ASSIGNS and left.kind in ("var", "item", "member", "static", "array")):
                    return left
                first = self.toks[self.at]
                self.at += 1
                if op in ASSIGNS:
                    self.at += self.php and self.peek() == "&"
                    right = self.expression(4)
                    left = self.node("assign", op, first, [left, *([right] if right else [])], start=left)
                elif op == "?":
                    middle = None if self.peek() == ":" else self.expression(5)
                    self.at += self.peek() == ":"
                    last = self.expression(5)
                    left = self.node("ternary", "?", first, [left, *([middle] if middle else [left]), *([last] if last else [])], start=left)
                else:
                    right = self.expression(bind - 1 if op in RIGHT else bind)
                    left = self.node("binary", op, first, [left, *([right] if right else [])], start=left)
            return left
        finally:
            self.depth -= 1

    def prefix(self) -> Node | None:
        if self.at >= len(self.toks):
            return None
        t = self.toks[self.at]
        c, kind = self.peek(), t.kind
        if kind in ("raw", "text", "heredoc"):
            self.at += 1
            while not self.php and self.kind() in ("raw", "text"):
                self.at += 1
            if self.php and (kind == "text" or kind == "heredoc" and not re.match(r"<<<[ \t]*'", t.text)):
                return self.postfix(self.template(t), t)
            return self.postfix(self.node("string", t.text, t), t)
        if kind == "number":
            self.at += 1
            return self.node("number", c, t)
        if kind == "var":
            self.at += 1
            return self.postfix(self.node("var", c.lstrip("$").join(["$", ""]), t), t)
        if kind == "name":
            return self.named(t, c)
        if c == "(":
            return self.bracket(t)
        if c in ("[", "{") and (c == "[" or not self.php):
            return self.postfix(self.series(t, "]" if c == "[" else "}"), t)
        if c in ("!", "-", "+", "@", "&", "~", "++", "--", "*", "...", "$"):
            self.at += 1
            x = self.expression(_UNARY)
            return self.node("unary", c, t, [x] if x else [])
        return None

    def series(self, t: Token, close: str) -> Node:
        self.at += 1
        kids = []
        while self.at < len(self.toks) and self.peek() not in (close, ";"):
            before = self.at
            if x := self.expression(4):
                kids.append(x)
            if self.at == before:
                self.at += 1
        self.at += self.peek() == close
        return self.node("array", "", t, kids)

    def bracket(self, t: Token) -> Node | None:
        i = 1
        while self.kind(i) == "name" or not self.php and self.peek(i) in ("*", "::"):
            i += 1
        typed = self.peek(i) == ")" and i > 1 and (self.kind(i + 1) in ("name", "var", "number", "raw", "text") or self.peek(i + 1) in ("(", "&", "*") and not self.php and self.peek(i - 1) == "*")
        if typed and (self.php or self.peek(1) in _C_TYPES or self.peek(i - 1) == "*" or self.peek(i - 1).endswith("_t") or i == 2 and self.kind(i + 1) == "name"):
            self.at += i + 1
            x = self.expression(_UNARY)
            return self.node("cast", t.text, t, [x] if x else [])
        self.at += 1
        x = self.expression(0)
        while x is not None and self.peek() == "," and not self.php:
            self.at += 1
            x = self.expression(0) or x
        self.at += self.peek() == ")"
        return self.postfix(x, t) if x is not None else None

    def named(self, t: Token, c: str) -> Node | None:
        low = c.lower()
        if self.php and low in ("function", "fn") or self.php and low == "static" and self.peek(1).lower() in ("function", "fn"):
            self.at += 1 + (low == "static")
            self.at += self.peek() == "&"
            if self.peek() == "(":
                self.skip()
            if self.peek().lower() == "use":
                self.at += 1
                self.skip()
            if self.peek() == "=>":
                self.at += 1
                x = self.expression(4)
                return self.node("unary", low, t, [x] if x else [])
            return self.node("string", "", t)  # the body's statements follow by themselves
        if self.php and low in ("array", "list") and self.peek(1) == "(":
            self.at += 1
            return self.postfix(self.series(t, ")"), t)
        if low in ("new", "clone", "print", "include", "include_once", "require", "require_once", "throw", "yield", "await", "sizeof", "delete") and (self.php or low in ("new", "delete", "sizeof", "throw")) and not (low == "sizeof" and self.php):
            self.at += 1
            x = self.expression(0 if low == "print" else _UNARY)
            return self.node("echo" if low == "print" else "unary", low, t, [x] if x else [])
        if low in self.words and low not in ("static", "default"):
            return None
        self.at += 1
        return self.postfix(self.node("name", c, t), t)

    def postfix(self, x: Node, t: Token) -> Node:
        while True:
            c = self.peek()
            if c == "(":
                kind = {"name": "call", "member": "method", "static": "method"}.get(x.kind, "apply")
                name = x.text
                kids = self.arguments()
                head = x if kind == "apply" else x.head
                x = self.node(kind, name, t, kids, head, start=x)
            elif c == "[":
                self.at += 1
                i = None if self.peek() == "]" else self.expression(0)
                self.at += self.peek() == "]"
                x = self.node("item", x.text, t, [i] if i else [], x, start=x)
            elif c in ("->", "?->", "::") or c == "." and not self.php:
                self.at += 1
                name = self.peek()
                if self.kind() in ("name", "var"):
                    self.at += 1
                elif name == "{":
                    self.skip()
                if not self.php and c == "::":
                    x = self.node("name", f"{x.text}::{name}", t, start=x)
                else:
                    x = self.node("static" if c == "::" else "member", name, t, [], x, start=x)
            elif c in ("++", "--"):
                self.at += 1
            else:
                return x

    def template(self, t: Token) -> Node:
        """A string with the variables and items that stand in it."""
        node = self.node("template", t.text, t)
        for m in re.finditer(r"(?<!\\)(\$\w+)(?:\[\s*(['\"]?)([^\]'\"]*)\2\s*\])?", t.text):
            line, at = t.line + t.text.count("\n", 0, m.start()), t.start + m.start()
            x = Node("var", m[1], at, at + len(m[1]), line)
            if m[3] is not None:
                key = Node("var" if m[3].startswith("$") else "string", m[3], at, at, line)
                x = Node("item", m[1], at, t.start + m.end(), line, [key], x)
            node.kids.append(x)
        return node


def read(text: str, php: bool) -> list[Node]:
    return list(Reader(text, php).statements())


@dataclass(slots=True)
class Span:
    """A function or class: its lines, its body's offsets and the names that are called in it."""

    kind: str
    name: str
    line: int
    end_line: int
    start: int
    end: int
    calls: list[str]


_NO_FUNCTIONS = {"if", "for", "foreach", "while", "switch", "catch", "return", "sizeof", "elseif", "match", "isset", "empty", "unset", "array", "list", "function", "fn", "and", "or", "xor"}


def spans(text: str, php: bool) -> list[Span]:
    """Functions, and classes of PHP, in the order in which they begin. Brackets are matched once for the whole file."""
    toks = tokens(text, php)
    shown = ["" if t.kind in ("raw", "text", "heredoc", "html") else t.text for t in toks]
    pair: dict[int, int] = {}
    held: list[int] = []
    for i, c in enumerate(shown):
        if c in ("(", "[", "{"):
            held.append(i)
        elif c in (")", "]", "}") and held:
            pair[held.pop()] = i
    for i in held:
        pair[i] = len(toks) - 1
    called = [(i, c) for i, c in enumerate(shown) if toks[i].kind == "name" and c.lower() not in _NO_FUNCTIONS and i + 1 < len(toks) and shown[i + 1] == "(" and (not i or shown[i - 1] not in ("->", "?->", "::", ".") and shown[i - 1].lower() != "function")]
    places = [i for i, _ in called]
    out = []

    def add(kind: str, name: str, first: int, brace: int) -> None:
        last = pair.get(brace, len(toks) - 1)
        inside = called[bisect.bisect_left(places, brace) : bisect.bisect_left(places, last)]
        out.append(Span(kind, name, toks[first].line, toks[last].line, toks[brace].start + 1, toks[last].start, sorted({c for _, c in inside})))

    for i, t in enumerate(toks):
        low = shown[i].lower() if t.kind == "name" else ""
        if php and low in ("class", "trait") and i + 1 < len(toks) and toks[i + 1].kind == "name" and (not i or shown[i - 1] != "::"):
            brace = next((k for k in range(i + 2, min(i + 200, len(toks))) if shown[k] in ("{", ";")), None)
            if brace is not None and shown[brace] == "{":
                add("class", shown[i + 1], i, brace)
        elif php and low == "function":
            k = i + 1 + (i + 1 < len(toks) and shown[i + 1] == "&")
            name = shown[k] if k < len(toks) and toks[k].kind == "name" else toks[i - 2].text if i > 1 and shown[i - 1] == "=" and toks[i - 2].kind == "var" else ""
            k += k < len(toks) and toks[k].kind == "name"
            if name and k < len(toks) and shown[k] == "(":
                brace = pair.get(k, k) + 1
                while brace < len(toks) and shown[brace] not in ("{", ";"):
                    brace = pair[brace] + 1 if shown[brace] == "(" else brace + 1
                if brace < len(toks) and shown[brace] == "{":
                    add("function", name, i, brace)
        elif not php and low and low not in _NO_FUNCTIONS and i and i + 1 < len(toks) and shown[i + 1] == "(" and (toks[i - 1].kind == "name" and shown[i - 1] not in ("return", "else", "new") or shown[i - 1] in ("*", "&", "::", ">")):
            brace = pair.get(i + 1, i + 1) + 1
            while brace < len(toks) and shown[brace] in ("const", "noexcept", "override", "final"):
                brace += 1
            if brace < len(toks) and shown[brace] == "{":
                add("function", shown[i], i, brace)
    return out
