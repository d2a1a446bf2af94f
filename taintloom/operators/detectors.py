"""Pattern detectors over lines and files: safe patterns, dangerous pairs, credentials, debug mode, archives, charsets.

Every line is read once: a line gets the tags of the patterns that it holds, and lines without any go no further. Detectors
are conditions on tags, on tags of neighbouring lines, and on flags of files and projects (sums of tags).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taintloom.functions import patterns as P

from .graph import cut
from .literals import needed
from .relational import first_wins, proximity_first

KEY = ["project_id", "path"]
CODE = ["python", "php", "c", "cpp"]
FOUND = [*KEY, "line_number", "pattern", "confidence", "related_types", "evidence", "is_safe"]


def file_name(path: Column) -> Column:
    return F.lower(F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1))


def test_file(path: Column) -> Column:
    """Is a file one of tests, by its name?"""
    name = file_name(path)
    return name.startswith("test") | name.endswith("_test.py")


def sample_file(path: Column) -> Column:
    """Does a file hold sample data: tests by folder or name, seeds, checks and dummies?"""
    name, whole = file_name(path), F.lower(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))))
    named = name.startswith("test_") | name.endswith("_test.py") | (name == "tests.py") | name.contains("seed") | name.startswith("smoke_check") | name.startswith("create_dummy")
    return named | whole.contains("/tests/") | whole.contains("/test/")


def credential(code: Column) -> Column:
    """Does a line assign a string that is a credential? Placeholders, interpolation, names of fields and samples are none."""
    name = F.lower(F.regexp_extract(code, P.CREDENTIAL, 1))
    value = F.trim(F.concat(F.regexp_extract(code, P.CREDENTIAL, 2), F.regexp_extract(code, P.CREDENTIAL, 3)))
    low = F.lower(value)
    any_of = lambda tests: functools.reduce(Column.__or__, tests)
    word = any_of([name.contains(x) for x in P.CREDENTIAL_WORDS]) | (name.endswith("key") & (F.length(value) >= 12))
    other = any_of([*(low.contains(x) for x in P.PLACEHOLDERS), *(name.endswith(x) for x in P.EXCLUDED_SUFFIXES), *(name.startswith(x) for x in P.EXCLUDED_PREFIXES), *(low == x for x in P.PLAIN_VALUES), low == name, value.rlike(r"[${(%]")])
    # What a line without an assignment needs isn't worked out: only a branch keeps it from being so ahead of the pattern.
    assigns = code.contains("=") & code.rlike(P.CREDENTIAL)
    return F.when(assigns, (F.length(value) >= 3) & word & ~other).otherwise(False)


def holds(code: Column, low: Column, pattern: str) -> Column:
    """Does a line hold a pattern? What a match needs is looked for in the lower-cased line (`low`) first, since finding text is
    far cheaper than a pattern."""
    found = needed(pattern)
    tested = code.rlike(pattern)
    return tested if found is None else F.when(functools.reduce(Column.__or__, (low.contains(x) for x in found)), tested).otherwise(False)


def tagged(lines: DataFrame) -> DataFrame:
    """(project_id, path, line_no, code, tags) of the lines of code that hold a pattern: the one pass over all lines."""
    code, path = F.col("code"), F.col("path")
    tests = {name: holds(code, F.col("__low"), p) for name, p in P.TAGS.items()}
    tests["debug"] &= ~test_file(path)
    tests["archive"] &= ~test_file(path)
    tests["credential"] = credential(code) & ~sample_file(path)
    tags = F.filter(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())), lambda x: x.isNotNull())
    some = F.explode(F.filter(F.array(tags), lambda x: F.size(x) > 0))  # a condition on tags would work them out twice
    return lines.where(F.col("language").isin(CODE)).withColumn("__low", F.lower(code)).select(*KEY, "line_no", "code", some.alias("tags"))


def has(tag: str) -> Column:
    return F.array_contains("tags", tag)


def with_flags(hits: DataFrame) -> DataFrame:
    """Adds what files (f_*) and projects (p_*) hold anywhere. Flags are partial sums per task before they are shuffled."""
    flag = lambda side, tag: F.bool_or(has(tag)).alias(f"{side}_{tag}")
    files = hits.groupBy(*KEY).agg(*(flag("f", t) for t in P.FILE_FLAGS))
    projects = hits.groupBy("project_id").agg(*(flag("p", t) for t in P.PROJECT_FLAGS))
    return hits.join(files, KEY).join(projects, "project_id")


def line_checks(hits: DataFrame, of_pdo: bool | None = None) -> DataFrame:
    """Findings of single lines with their neighbours and flags. What is told once a file keeps its first line. of_pdo: the
    checks of PDO only, or all others."""
    at = Window.partitionBy(*KEY).orderBy("line_no")
    rows = with_flags(hits).withColumn("near_sql", F.max(has("sql_word")).over(at.rangeBetween(-2, 2))).withColumn("near_query", F.max(has("query_call")).over(at.rangeBetween(0, 5)))
    f = lambda tag: F.col(f"f_{tag}")
    sql = ["sql_injection"]
    shaky, pdo = ~F.col("p_emulate_off"), f("pdo")
    escaped = f("sql_call") | f("addslashes")
    wide = F.col("p_gbk") & ~f("gbk_local")
    once = True
    # (condition, pattern, confidence, types, safe, once a file)
    checks = [
        (has("parameterized") & F.col("near_sql"), "parameterized_query", 0.85, sql, True, False),
        (has("allowlist"), "allowlist_check", 0.85, P.SAFE_COVERS["allowlist_check"], True, False),
        (has("blacklist"), "blacklist_filter", 0.9, ["sql_injection", "xss"], False, False),
        (has("extract"), "extract_override", 0.95, ["command_execution", "path_traversal"], False, False),
        (has("weak_escape") & F.col("near_query"), "blacklist_filter", 0.75, sql, False, False),
        (has("credential"), "hardcoded_credentials", 0.9, ["hardcoded_credentials"], False, False),
        (has("debug"), "debug_mode", 0.85, ["debug_mode"], False, False),
        (has("archive") & ~f("archive_safe"), "archive_extract", 0.6, ["path_traversal"], False, False),
        (pdo & has("concat_query"), "string_concat_sql", 0.9, sql, False, False),
        (pdo & has("concat_exec") & ~has("concat_query"), "string_concat_sql", 0.85, sql, False, False),
        (pdo & has("concat_prepare") & ~has("concat_query") & ~has("concat_exec"), "string_concat_sql", 0.7, sql, False, False),
        (f("gbk_local") & escaped & has("charset_set"), "dangerous_combo", 0.85, sql, False, once),
        (wide & escaped & has("sql_use"), "dangerous_combo", 0.75, sql, False, once),
        (pdo & f("emulate_on") & has("emulate"), "dangerous_combo", 0.8, sql, False, once),
        (pdo & f("gbk") & ~f("emulate_on") & has("charset_gbk"), "dangerous_combo", 0.65, sql, False, once),
        (pdo & F.col("p_gbk") & shaky & has("pdo_use"), "dangerous_combo", 0.85, sql, False, once),
        (pdo & f("prepare") & f("bound") & shaky & has("pdo_charset"), "dangerous_combo", 0.7, sql, False, once),
    ]
    pdo_checks = range(8, 11), range(13, 17)
    wanted = [of_pdo is None or of_pdo == any(k in r for r in pdo_checks) for k in range(len(checks))]
    array = F.array(*(F.when(c, F.struct(F.lit(k).alias("check"), F.lit(p).alias("pattern"), F.lit(conf).alias("confidence"), F.array(*map(F.lit, types)).alias("related_types"), F.lit(safe).alias("is_safe"), F.lit(one).alias("once"))) for k, (c, p, conf, types, safe, one) in enumerate(checks) if wanted[k]))
    each = rows.select(*KEY, "line_no", F.trim("code").alias("evidence"), F.explode(F.filter(array, lambda x: x.isNotNull())).alias("c")).select(*KEY, "line_no", "evidence", "c.*")
    first = first_wins(each.where("once"), [*KEY, "check"], ["line_no"])
    return each.where("not once").unionByName(first).select(*KEY, F.col("line_no").alias("line_number"), *FOUND[3:])


def pdo_elsewhere(hits: DataFrame) -> DataFrame:
    """The project's first file that opens a connection with a charset, if another file prepares statements while
    emulation isn't off."""
    rows = with_flags(hits)
    remote = rows.where(F.col("f_pdo") & F.col("f_prepare") & F.col("f_bound") & ~F.col("p_emulate_off") & ~F.col("f_pdo_charset")).select("project_id").distinct()
    opened = first_wins(rows.where(F.col("f_pdo_charset") & has("pdo_new")), ["project_id"], ["path", "line_no"])
    return opened.join(remote, "project_id", "left_semi").select(*KEY, F.col("line_no").alias("line_number"), F.lit("dangerous_combo").alias("pattern"), F.lit(0.65).alias("confidence"), F.array(F.lit("sql_injection")).alias("related_types"), F.trim("code").alias("evidence"), F.lit(False).alias("is_safe"))


def pdo(lines: DataFrame) -> DataFrame:
    """PDO checks: concatenated queries, emulated prepares, wide-byte charsets in the file or its project, and prepared
    calls while emulation isn't off."""
    hits = cut(tagged(lines))
    return line_checks(hits, True).unionByName(pdo_elsewhere(hits)).withColumnRenamed("path", "file_path")


def combos(hits: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """The first line per file of each pair of patterns that stand within COMBO_WINDOW lines or in one span (project_id, path,
    kind, start, end): class bodies for pairs of PHP, functions for those of Python. All pairs share one join on buckets
    of lines and one on spans."""
    sides = []
    for side in ("a", "b"):
        pairs = F.filter(F.array(*(F.when(has(f"combo_{side}{k}"), F.lit(k)) for k in range(len(P.COMBOS)))), lambda x: x.isNotNull())
        sides.append(hits.select(*KEY, "line_no", F.explode(pairs).alias("pair")))
    near = proximity_first(sides[0], sides[1], [*KEY, "pair"], "line_no", P.COMBO_WINDOW)
    if spans is not None:
        kind = F.element_at(F.array(*(F.lit(k) for _, _, k, _, _ in P.COMBOS)), F.col("pair") + 1)
        held = [x.withColumn("kind", kind).join(spans, [*KEY, "kind"]).where("line_no between start and end").select(*KEY, "pair", "start", "end", "line_no") for x in sides]
        both = held[0].join(held[1].drop("line_no").distinct(), [*KEY, "pair", "start", "end"], "left_semi")
        near = near.unionByName(both.select(*KEY, "pair", "line_no")).groupBy(*KEY, "pair").agg(F.min("line_no").alias("line_no"))
    facts = F.array(*(F.struct(F.lit(conf).alias("confidence"), F.array(*map(F.lit, types)).alias("related_types")) for _, _, _, conf, types in P.COMBOS))
    code = hits.select(*KEY, "line_no", F.trim("code").alias("evidence"))
    out = near.join(code, [*KEY, "line_no"]).withColumn("c", F.element_at(facts, F.col("pair") + 1))
    return out.select(*KEY, F.col("line_no").alias("line_number"), F.lit("dangerous_combo").alias("pattern"), "c.confidence", "c.related_types", "evidence", F.lit(False).alias("is_safe"))


def detect(lines: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """All findings of the detectors, safe ones too."""
    hits = cut(tagged(lines))
    return line_checks(hits).unionByName(pdo_elsewhere(hits)).unionByName(combos(hits, spans)).withColumnRenamed("path", "file_path")


def block_spans(facts: DataFrame) -> DataFrame:
    """(project_id, path, kind, start, end): lines of classes and functions, from the facts of files."""
    return facts.where("kind = 'span'").select(*KEY, F.col("dst").alias("kind"), F.col("line").alias("start"), "end")


def _is_pattern(spark: SparkSession, pattern: str) -> bool:
    """Is it a regular expression to the JVM? Whatever its error is there, the answer is no."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:  # the class differs with the way the JVM's error comes over
        return False
    return True


def search(lines: DataFrame, pattern: str, glob: str | None = None, most: int = 50) -> DataFrame:
    """(path, line_no, code, total, error): a case-insensitive search, the first `most` hits with code cut to 200
    characters, and the number of all hits. A pattern that isn't one gives one row with `error`."""
    from taintloom.functions.text import glob_pattern

    from .report import top_with_total

    spark = lines.sparkSession
    if not _is_pattern(spark, pattern):
        said = f"not a regular expression: {pattern}"
        return spark.createDataFrame([(None, None, None, 0, said)], "path string, line_no int, code string, total long, error string")
    hit = lines.where(F.col("code").rlike(f"(?i){pattern}"))
    if glob:
        hit = hit.where(F.col("path").rlike(glob_pattern(glob)))
    top = top_with_total(hit.select("path", "line_no", F.substring(F.trim("code"), 1, 200).alias("code")), ["path", "line_no"], most)
    return top.withColumn("error", F.lit(None).cast("string"))


def tagged_calls(lines: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    """(path, line_no, category, code): a hit for each category that a line holds, once."""
    tags = F.filter(F.array(*(F.when(F.col("code").rlike(p), F.lit(c)) for c, p in table)), lambda x: x.isNotNull())
    return lines.where(F.col("code").rlike(P.any_of([p for _, p in table]))).select("path", "line_no", F.explode(tags).alias("category"), "code")


def user_inputs(lines: DataFrame) -> DataFrame:
    """(path, line_no, category, code): one hit a line, the first category in the table's order."""
    first = F.coalesce(*(F.when(F.col("code").rlike(p), F.lit(c)) for c, p in P.USER_INPUTS))
    return lines.where(F.col("code").rlike(P.any_of([p for _, p in P.USER_INPUTS]))).select("path", "line_no", first.alias("category"), "code")


def variable_trace(lines: DataFrame, name: str) -> DataFrame:
    """(path, line_no, use, code): lines with a variable, told apart by whether they assign it."""
    import re

    v = re.escape(name)
    hit = lines.where(F.col("code").rlike(rf"(?<!\w){v}(?!\w)"))
    return hit.select("path", "line_no", F.when(F.col("code").rlike(rf"(?<!\w){v}\s*(?:[-+.*/]?=)(?!=)"), "assign").otherwise("reference").alias("use"), "code")


def safe_spots(findings: DataFrame, spots: DataFrame) -> DataFrame:
    """Findings with a safe spot at their sink, source or line, or a line beside it: severity goes down two grades, to low
    at the lowest."""
    at = F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1) for c in ("sink_line", "source_line", "line_number"))))))
    hit = findings.select("finding_id", "file_path", at.alias("line_number")).join(spots.select("file_path", "line_number").distinct(), ["file_path", "line_number"], "left_semi").select("finding_id").distinct().withColumn("__hit", F.lit(True))
    grade = F.array_position(F.array(*(F.lit(x) for x in ("low", "medium", "high", "critical"))), F.col("severity"))
    lower = F.element_at(F.array(*(F.lit(x) for x in ("low", "medium", "high", "critical"))), F.greatest(grade - 2, F.lit(1)).cast("int"))
    return findings.join(hit, "finding_id", "left").withColumn("severity", F.when(F.col("__hit") & (grade > 0), lower).otherwise(F.col("severity"))).drop("__hit")
