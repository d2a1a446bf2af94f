"""Rule tables of any size against texts: an automaton of the literals that patterns need.

A pattern that matches a text needs some literal to stand in it: `execute\\s*\\(` needs `execute`. Texts run once through an
automaton of all rules' literals (Aho-Corasick), which costs their length whatever the number of rules; the literals that
stand in a text meet the rules by an equi-join, and patterns run on what meets only.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .graph import cut

#: Characters of the shortest literal that is worth a search.
SHORTEST = 3
#: Literals of one automaton, some 100 MB of a worker; a table with more goes in several passes.
AUTOMATON = 500_000
#: Rules that may be broadcast after they are counted.
FEW = 100_000
#: So many alternatives of a pattern are filed; one with more has no literal that it needs.
MOST_LITERALS = 32

#: Escapes of one letter: classes, anchors and control characters.
PLAIN_ESCAPES = "dDwWsSbBAzZGhHvVRtnrfae"
_FLAGS = re.compile(r"\(\?([a-zA-Z]+)\)")
_REPEAT = re.compile(r"\{(\d+)(,\d*)?\}")


class _Reader:
    """Reads a Java regular expression far enough to tell what literals it needs: a list of alternatives, one of which
    stands in every match, or None if nothing is known. What it doesn't understand needs nothing, so it never errs."""

    def __init__(self, pattern: str) -> None:
        self.p, self.i = pattern, 0

    def alternatives(self, depth: int = 0) -> list[str] | None:
        """Up to a closing parenthesis or the end."""
        options: list[list[str] | None] = []
        while True:
            options.append(self.sequence(depth))
            if self.i < len(self.p) and self.p[self.i] == "|":
                self.i += 1
                continue
            break
        if any(o is None for o in options):
            return None
        return [x for o in options for x in o]

    def sequence(self, depth: int) -> list[str] | None:
        """Of the parts of a sequence, the literals of the part that narrows most: whose shortest is longest."""
        best: list[str] | None = None
        run = ""

        def offer(found: list[str] | None) -> None:
            nonlocal best
            if found and (best is None or min(map(len, found)) > min(map(len, best))):
                best = found

        while self.i < len(self.p) and self.p[self.i] not in "|)":
            c = self.p[self.i]
            if c == "(":
                offer([run] if run else None)
                run = ""
                found = self.group(depth)
                least = self.repeat()
                offer(found if least else None)
                continue
            one = self.one()
            least = self.repeat()
            if one is None or least != 1:
                if one is not None and least:
                    run += one
                offer([run] if run else None)
                run = ""
            else:
                run += one
        offer([run] if run else None)
        return best

    def group(self, depth: int) -> list[str] | None:
        self.i += 1
        known = True
        if self.p.startswith("?", self.i):
            m = re.compile(r"\?(?::|<[A-Za-z][A-Za-z0-9]*>)").match(self.p, self.i)
            if m:
                self.i = m.end()
            else:  # a look-around, flags or an atomic group
                known = False
                self.i += 1
        found = self.alternatives(depth + 1)
        self.i += 1
        return found if known else None

    def one(self) -> str | None:
        """The next character if it is a plain one, else None for a class, an anchor or a group of characters."""
        c = self.p[self.i]
        if c == "\\":
            escaped = self.p[self.i + 1]
            if escaped.isalnum() and escaped not in PLAIN_ESCAPES:
                raise ValueError("an escape with operands, or a back reference")
            self.i += 2
            return None if escaped.isalnum() else escaped
        if c == "[":
            depth, j = 0, self.i
            while j < len(self.p):
                if self.p[j] == "\\":
                    j += 1
                elif self.p[j] == "[":
                    depth += 1
                elif self.p[j] == "]" and j > self.i + 1 + self.p.startswith("[^", self.i):
                    depth -= 1
                    if not depth:
                        break
                j += 1
            if j >= len(self.p):
                raise ValueError("class")
            self.i = j + 1
            return None
        self.i += 1
        return None if c in ".^$" else c

    def repeat(self) -> int:
        """The fewest times that the last part stands (0 may be absent, 2 for more than one), behind its quantifier."""
        least = 1
        if self.i < len(self.p) and self.p[self.i] in "*+?{":
            c = self.p[self.i]
            if c == "{":
                m = _REPEAT.match(self.p, self.i)
                if not m:
                    raise ValueError("brace")
                self.i = m.end()
                low = int(m.group(1))
                least = 1 if low == 1 and not m.group(2) else min(low, 1) * 2
            else:
                self.i += 1
                least = {"*": 0, "?": 0, "+": 2}[c]
            if self.i < len(self.p) and self.p[self.i] in "+?":
                self.i += 1
        return least


def needed(pattern: str) -> list[str] | None:
    """Lower-cased literals one of which stands in every lower-cased text that the pattern matches, or None if there are no
    such literals of SHORTEST characters or more. Only ASCII literals count, since other letters fold in more than one way."""
    m = _FLAGS.match(pattern)
    flags = m.group(1) if m else ""
    if "x" in flags or "u" in flags or "U" in flags:
        return None
    reader = _Reader(pattern[m.end() :] if m else pattern)
    try:
        found = reader.alternatives()
    except (ValueError, IndexError):
        return None
    if reader.i < len(reader.p) or not found or len(found) > MOST_LITERALS or _FLAGS.search(reader.p):
        return None
    found = sorted({f.lower() for f in found})
    return found if all(len(f) >= SHORTEST and f.isascii() for f in found) else None


def spelled(pattern: str) -> list[str] | None:
    """All texts, lower-cased, that a pattern of plain characters matches, some of which may be absent (`ab?c`): one of them
    stands in every match, and they narrow more than the longest run that is always there. None for other patterns, for
    many texts, and for short ones."""
    reader, out = _Reader(pattern), [""]
    try:
        while reader.i < len(reader.p):
            if reader.p[reader.i] in "()|*+?{":
                return None
            one = reader.one()
            absent = reader.p.startswith("?", reader.i)
            if one is None or reader.repeat() != (0 if absent else 1) or len(out) > MOST_LITERALS:
                return None
            out = [x + one for x in out] + (out if absent else [])
    except (ValueError, IndexError):
        return None
    found = sorted({x.lower() for x in out})
    return found if len(found) <= MOST_LITERALS and all(len(x) >= SHORTEST and x.isascii() for x in found) else None


def literal_index(rules: DataFrame) -> DataFrame:
    """Rules (with `pattern`) with `literals` (null: none that it needs), and one row for each of them as `literal`."""

    def run(frames):
        for f in frames:
            rows = []
            for pattern in f["pattern"]:
                found = spelled(pattern) or needed(pattern)
                rows += [(pattern, found, x) for x in found] if found else [(pattern, None, None)]
            yield pd.DataFrame(rows, columns=["pattern", "literals", "literal"])

    read = rules.select("pattern").where("pattern is not null").distinct().mapInPandas(run, "pattern string, literals array<string>, literal string")
    return rules.join(read, "pattern")


@functools.lru_cache(maxsize=1)
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for x in literals:
        out.add_word(x, x)
    out.make_automaton()
    return out


def with_literals(rows: DataFrame, text: str, literals: list[str], name: str) -> DataFrame:
    """Rows with `name`, the array of those literals that stand in the lower-cased text; rows without any go."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(literals))
    at = rows.columns.index(text)
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(StringType()))])

    def run(batches):
        search = _automaton(shared.value)
        for b in batches:
            found = [sorted({x for _, x in search.iter(t.lower())}) if t else [] for t in b.column(at).to_pylist()]
            column = pa.array(found, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, column], names=schema.names).filter(pa.array([bool(f) for f in found], pa.bool_()))

    return rows.where(F.col(text).isNotNull()).mapInArrow(run, schema)


def indexed_join(rows: DataFrame, rules: DataFrame, text: str = "code", on: list[str] | None = None) -> DataFrame:
    """Every (row, rule) pair whose pattern the text holds, and whose columns `on` are equal: columns of both.

    A pair goes to its pattern once: where several literals of a rule stand in a text, at the first of them. Rules that
    need no literal meet every row, as they must. Literals are read off the table once (a checkpoint) and broadcast
    AUTOMATON at a time, each a pass over the rows; rules are broadcast if there are at most FEW of them. Null texts and
    patterns match nothing.
    """
    on = on or []
    index = cut(literal_index(rules))
    names = [c for c in rules.columns if c not in on]
    filed, free = index.where("literal is not null"), index.where("literal is null").select(*on, *names)
    n, n_free, different = index.agg(F.count("literal"), F.count_if(F.col("literal").isNull()), F.count_distinct("literal")).first()
    parts = []
    passes = -(-different // AUTOMATON)
    for k in range(passes):
        some = filed.where(F.pmod(F.xxhash64("literal"), F.lit(passes)) == k)
        words = sorted(r[0] for r in some.select("literal").distinct().collect())
        held = with_literals(rows, text, words, "__found").withColumn("literal", F.explode("__found"))
        met = held.join(F.broadcast(some) if n <= FEW else some, [*on, "literal"])
        if passes == 1:
            first = F.get(F.filter("literals", lambda x: F.array_contains("__found", x)), F.lit(0))
        else:  # what another pass has found isn't in this one's list
            first = F.get(F.filter("literals", lambda x: F.contains(F.lower(F.col(text)), x)), F.lit(0))
        parts.append(met.where(F.col("literal") == first))
    if n_free:
        few = F.broadcast(free) if n_free <= FEW else free
        parts.append(rows.join(few, on) if on else rows.join(few))
    if not parts:
        return rows.join(rules.select(*on, *names), on or F.lit(False)).where("1 = 0")
    parts = [p.select(*rows.columns, *names) for p in parts]
    return functools.reduce(DataFrame.unionByName, parts).where(F.call_function("rlike", F.col(text), F.col("pattern")))
