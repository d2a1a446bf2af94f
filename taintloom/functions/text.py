"""Scalar functions of the analysis as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .catalog import STANDARD_RANK, lookup


def version_array(column: Column) -> Column:
    """The numbers of a version string; arrays compare in order, as versions do. No numbers: an empty array."""
    return F.transform(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def version_in_range(version: Column, low: Column, high: Column) -> Column:
    """Is low <= version <= high? An unknown version, and a bound that isn't there, pass."""
    v, a, b = version_array(version), version_array(low), version_array(high)
    return (F.size(v) == 0) | (((F.size(a) == 0) | (v >= a)) & ((F.size(b) == 0) | (v <= b)))


def standard_rank(column: Column) -> Column:
    return lookup(STANDARD_RANK, F.lower(column), 0)


def standard_in_range(version: Column, low: Column, high: Column) -> Column:
    """The same for C and C++ standards by their order, in which every C++ stands behind every C."""
    v = standard_rank(version)
    return (low.isNull() | (v >= standard_rank(low))) & (high.isNull() | (v <= standard_rank(high)))


def overridden(overrides: Column, version: Column, base: Column) -> Column:
    return F.coalesce(F.try_element_at(overrides, version), base)


def strip_php_comments(column: Column) -> Column:
    return F.regexp_replace(column, r"(?s)//[^\n]*|#[^\n]*|/\*.*?\*/", "")


def strip_c_comments(column: Column) -> Column:
    return F.regexp_replace(column, r"(?s)//[^\n]*|/\*.*?\*/", "")


def strip_python_comments(column: Column) -> Column:
    return F.regexp_replace(column, r"#[^\n]*", "")


def masked(column: Column) -> Column:
    """A key with its middle starred: all stars up to 8 characters, else four characters at either end."""
    n = F.length(column)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(column, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(column, F.lit(4))))


def tail_masked(column: Column) -> Column:
    """A key of which only the last four characters show; empty text if there is none."""
    return F.when(F.length(column) > 4, F.concat(F.lit("****"), F.right(column, F.lit(4)))).when(F.length(column) > 0, F.lit("****")).otherwise(F.lit(""))


def safe_name(column: Column) -> Column:
    return F.regexp_replace(column, r"[^A-Za-z0-9_-]", "_")


def glob_pattern(glob: str) -> str:
    """A file name glob as a regular expression."""
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in glob)
    return f"(?:^|/){out}$"


def suffix_language(path: Column) -> Column:
    from .catalog import SUFFIXES

    table = {s: lang for lang, ss in SUFFIXES.items() if lang != "template" for s in ss}
    return lookup(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), "")


def beijing_now() -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.localtimestamp())


def iso(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def json_field(column: Column) -> Column:
    """A container as JSON, empty text if it is empty or null."""
    return F.when(F.size(column) > 0, F.to_json(column)).otherwise(F.lit(""))


def cvss_bucket(v31: Column, v30: Column, v2: Column) -> Column:
    """The first severity there is; a version 2 score in buckets."""
    score = F.when(v2 >= 9, "critical").when(v2 >= 7, "high").when(v2 >= 4, "medium").when(v2.isNotNull(), "low")
    return F.coalesce(F.lower(v31), F.lower(v30), score)


def cpe_part(cpe: Column, k: int) -> Column:
    """Part k of cpe:2.3:part:vendor:product:...; null unless there are five parts or more of that version."""
    parts = F.split(cpe, ":")
    ok = (F.size(parts) >= 5) & cpe.startswith("cpe:2.3:")
    return F.when(ok, F.get(parts, F.lit(k)))


def repair_json(text: str | None) -> str | None:
    """The JSON value in an answer, as JSON: the text itself, a fenced block, or the first balanced braces; then with
    comments and trailing commas gone, bare keys quoted, control characters escaped and open brackets closed."""
    if text is None:
        return None
    fenced = re.findall(r"```(?:json)?\s*(.*?)```", text, re.DOTALL)
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    for candidate in [text, *fenced, _balanced(text[at:]) if at >= 0 else ""]:
        for fix in (lambda x: x, _repaired):
            try:
                return json.dumps(json.loads(fix(candidate.strip())), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
    return None


def _balanced(text: str) -> str:
    """Up to the bracket that closes the first one, or all of it and the closers that it lacks."""
    stack, quoted, escaped = [], False, False
    for i, c in enumerate(text):
        if quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if stack:
                stack.pop()
            if not stack:
                return text[: i + 1]
    return text + '"' * quoted + "".join(reversed(stack))


def _repaired(text: str) -> str:
    t = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    t = re.sub(r'"(?:\\.|[^"\\])*"', lambda m: m[0].replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r"), t, flags=re.DOTALL)
    t = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', t)
    return re.sub(r",(\s*[}\]])", r"\1", _balanced(t))


@F.pandas_udf(StringType())
def json_repair(texts: pd.Series) -> pd.Series:
    return texts.map(repair_json)
