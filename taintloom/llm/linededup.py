"""Operator 3, substring dedup by line and sentence hashing with global groups of digests."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, free_name, small_batches, spread_join

LINE, SENTENCE = 0, 1


def sentences(line: str, start: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a line's sentences: each ends behind full stops and the blanks that follow them. They tile the line."""
    at, n = 0, len(line)
    for m in re.finditer(r"[.!?]+[ \t]+", line):
        yield start + at, start + m.end()
        at = m.end()
    if at < n:
        yield start + at, start + n


def units(text: str, min_line_words: int) -> list[tuple[int, int, int, int, str]]:
    """(kind, start, end, words, normal form) of every line of enough words and of every sentence of the whole text.

    Normal form: lower case, white space as one blank. Offsets are characters of the original text.
    """
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        n = len(line.split())
        if n:
            if n >= min_line_words:
                out.append((LINE, at, end, n, " ".join(line.lower().split())))
            for a, b in sentences(line, at):
                words = text[a:b].lower().split()
                if words:
                    out.append((SENTENCE, a, b, len(words), " ".join(words)))
        at = end + 1
    return out


def spans(found: list[tuple[int, int, int, int]], starts: dict[int, int], min_run_words: int) -> list[tuple[int, int]]:
    """What goes of a text, sorted and apart: repeated lines, and runs of neighbouring repeated sentences of enough
    words. found: (kind, start, end, words) of repeated units; starts: where the unit behind a sentence's end begins."""
    gone = [(a, b) for kind, a, b, _ in found if kind == LINE]
    run: list[tuple[int, int, int]] = []
    for a, b, n in sorted((a, b, n) for kind, a, b, n in found if kind == SENTENCE):
        if run and starts.get(run[-1][1], run[-1][1]) != a:
            if sum(r[2] for r in run) >= min_run_words:
                gone.append((run[0][0], run[-1][1]))
            run = []
        run.append((a, b, n))
    if run and sum(r[2] for r in run) >= min_run_words:
        gone.append((run[0][0], run[-1][1]))
    merged: list[list[int]] = []
    for a, b in sorted(gone):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the spans; a line that goes whole takes its newline along."""
    out, at = [], 0
    for a, b in gone:
        out.append(text[at:a])
        at = b + 1 if b < len(text) and text[b] == "\n" and (a == 0 or text[a - 1] == "\n") else b
    return "".join(out) + text[at:]


#: A unit's number of words, kind and whether its own document has it earlier, in one int.
WORDS, KIND, INNER = (1 << 20) - 1, 1 << 20, 1 << 21


def version_of(text: str | None) -> int:
    return xxhash.xxh32_intdigest((text or "").encode()) - (1 << 31)


def repeated_units(docs: DataFrame, key: str, text: str, min_line_words: int, scratch: Scratch) -> DataFrame:
    """(doc, version, span, facts) of every unit that stands earlier: in its own document, or in one with a smaller key.

    Digests are 128 bits. Repeats within a document are told in its own pass. Units are written once; over documents the
    first of a digest is a minimum of a long, summed map-side in a hash table, so a line that a third of the documents
    share is reduced before the shuffle. The other occurrences are found by a join on the digest in which no digest's
    units meet in one task. span: start and end in the halves of a long; facts: WORDS, KIND and INNER.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows: tuple[list, ...] = tuple([] for _ in range(6))
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                version, seen = version_of(t), set()
                d = (1 << 63) - 1 - (version & 0x7FFFFFFF) if d is None else d
                for kind, a, e, n, normal in units(t or "", min_line_words):
                    h = xxhash.xxh3_128_intdigest(normal.encode(), kind)
                    facts = min(n, WORDS) | KIND * kind | INNER * (h in seen)
                    seen.add(h)
                    for column, value in zip(rows, ((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), d, version, a << 32 | e, facts), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["h1", "h2", "doc", "version", "span", "facts"])

    schema = "h1 long, h2 long, doc long, version int, span long, facts int"
    all_units = scratch.keep(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, schema))
    first = scratch.keep(all_units.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"))
    inner = F.col("facts").bitwiseAND(INNER) != 0
    met = spread_join(all_units, first, ["h1", "h2"], "n", all_units.count())
    return met.where(inner | (F.col("doc") > F.col("first"))).select("doc", "version", "span", "facts")


def deduplicated(docs: DataFrame, min_line_words: int = 6, min_run_words: int = 25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `text` cleaned and a column `removed` array<struct<start:int,end:int>> of original offsets.

    A line of `min_line_words` or more whose normal form stands earlier (by key, then offset; null keys last, by their
    text) goes. So
    does a run of neighbouring sentences that each stand earlier and have `min_run_words` or more words together: that
    finds passages inside longer lines and leaves short phrases that repeat by chance. Null texts stay null with nothing
    removed; empty texts stay. Rows that repeat a key are one document: they get
    the same cuts where their texts are equal, and nothing is cut of one for standing in the other. Every row and
    column of `docs` is kept but a column named `removed`, which is replaced. The key must be an integer.
    """
    names = [c for c in docs.columns if c != "removed"]
    hits, v, d = (free_name(docs.columns, n) for n in ("__found", "__v", "__d"))
    with Scratch(docs.sparkSession) as scratch:
        found = repeated_units(docs, key, text, min_line_words, scratch)
        per_doc = cut(found.groupBy("doc", "version").agg(F.collect_list(F.struct("span", "facts")).alias(hits)))

    def hashed(batches):
        for b in batches:
            versions = [version_of(t) for t in b.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(versions, pa.int32())], names=[*b.schema.names, v])

    def apply(batches):
        at = names.index(text)
        for b in batches:
            texts, gone = [], []
            for t, f in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                if not f:
                    texts.append(t)
                    gone.append([])
                    continue
                follow = {}
                every = [u for u in units(t, 1 << 30)]
                for x, y in zip(every, every[1:], strict=False):
                    follow[x[2]] = y[1]
                s = spans([(x["facts"] // KIND & 1, x["span"] >> 32, x["span"] & 0xFFFFFFFF, x["facts"] & WORDS) for x in f], follow, min_run_words)
                texts.append(without(t, s))
                gone.append([{"start": a, "end": e} for a, e in s])
            removed = pa.array(gone, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            columns = [pa.array(texts, b.schema.field(at).type) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, removed], names=[*names, "removed"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    with_version = docs.select(*names).mapInArrow(hashed, f"{kinds}, `{v}` int")
    unnamed = F.lit((1 << 63) - 1) - F.col(v).cast("long").bitwiseAND(0x7FFFFFFF)
    with_version = with_version.withColumn(d, F.coalesce(F.col(key).cast("long"), unnamed))
    per_doc = per_doc.select(*(F.col(c).alias(free_name(docs.columns, f"__of_{c}")) for c in ("doc", "version")), hits)
    joined = with_version.join(per_doc, (with_version[d] == per_doc[per_doc.columns[0]]) & (with_version[v] == per_doc[per_doc.columns[1]]), "left")
    return joined.select(*(with_version[c] for c in names), hits).mapInArrow(apply, f"{kinds}, removed array<struct<start:int,end:int>>")
