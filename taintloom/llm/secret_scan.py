"""Operator 11, secret scans: stated patterns, and a token-efficiency test that exposes random strings.

Words of a language need few tokens of a byte-pair vocabulary, random strings many: a string with few characters a token
is a secret unless it is a known digest or an identifier.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, small_batches, sole_holder, tokenizer_path

#: The kinds of the stated patterns in their order, each with the group that must be so long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED = 8
KINDS = ("assign", "access", "hex", "random")

#: What may be a random string: a run of letters, digits and the signs of base64 in both alphabets, with its padding.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Digits of hexadecimal digests in common use (MD5, SHA-1, SHA-2), and forms that name their digest or are unique ids.
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
NAMED = re.compile(r"(?i:sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})")
#: Parts of identifiers: numbers, words of one case or in camel case with a short number, and short mixed ones.
PART = re.compile(r"[0-9]+|(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z]+[a-z]{2,})*[A-Z]*)?[0-9]{0,6}|[A-Za-z]{1,4}[0-9]{1,4}[A-Za-z]{0,4}[0-9]{0,2}|[0-9]{1,4}[A-Za-z]{1,4}[0-9]{0,4}")

SPANS = "array<struct<kind:string,start:long,end:long,ratio:double>>"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_identifier(string: str, known: frozenset[str] = frozenset()) -> bool:
    """A digest (by its length, its name or a list of known ones), a unique id, or words and numbers joined by signs."""
    if string in known or (len(string) in DIGEST_LENGTHS and DIGEST.fullmatch(string)) or NAMED.fullmatch(string):
        return True
    return all(PART.fullmatch(p) for p in re.split(r"[-_/+=]", string))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the stated patterns: leftmost, not overlapping within a kind, by start and then by kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


class Ratios:
    """Characters per token of strings, with a bounded memo; strings that are no candidates have none."""

    def __init__(self, path: str, known: frozenset[str]) -> None:
        encoding = _encoding(path)
        self.of = Memo(lambda s: None if is_identifier(s, known) else len(s) / len(encoding.encode_ordinary(s)), 200_000)

    def random_spans(self, text: str, base: list[tuple[str, int, int]], most: float) -> list[tuple[str, int, int, float]]:
        """Strings of at most `most` characters a token that no stated pattern's span holds already."""
        out, starts = [], [s[1] for s in base]
        ends = list(itertools.accumulate((s[2] for s in base), max))
        for m in CANDIDATE.finditer(text):
            s = m.group()
            ratio = self.of[s] if len(s) <= 200 else self.of.make(s)  # long strings aren't kept
            if ratio is not None and ratio <= most:
                before = bisect.bisect_right(starts, m.start())
                if not before or ends[before - 1] < m.end():
                    out.append(("random", *m.span(), ratio))
        return out


@functools.lru_cache(maxsize=2)
def _ratios(path: str, known: frozenset[str]) -> Ratios:
    return Ratios(path, known)


def secrets(docs: DataFrame, most_per_token: float = 2.25, known: frozenset[str] = frozenset(), path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) per row of `docs`: kind, start, end (code points, end exclusive) and, for `random`, the characters per
    token of each secret, by start and then in the order of KINDS.

    `assign`, `access` and `hex` are the stated patterns. `random` strings have 16 characters or more and at most
    `most_per_token` characters a token of the vocabulary at `path`; digests, unique ids, identifiers, strings of `known` (a
    bounded set that travels with the tasks) and what lies within a stated pattern's span are none. Null and empty texts
    have no spans. Repeated rows and null keys each give their own row; other columns are not read; an empty table gives
    an empty result. One pass over whole texts without a shuffle; what a worker keeps in memory is bounded.
    """
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])

    def run(batches):
        sole_holder("secret_scan", _ratios.cache_clear)
        ratios = _ratios(path, known)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t) if t else []
                found = [(*s, None) for s in base] + (ratios.random_spans(t, base, most_per_token) if t else [])
                found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([dict(zip(("kind", "start", "end", "ratio"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(struct))], names=[key, "spans"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, spans {SPANS}")


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span of `secrets` replaced by `mask`; of spans that overlap one mask stands for all. Null for null."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, s):
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, F.when(fresh, F.lit(mask)).otherwise("")).alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, start, step, rest)
