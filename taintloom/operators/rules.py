"""Line rules and language versions: rules active for a version, severities by version, versions read off the code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taintloom.functions import text as T
from taintloom.functions.patterns import any_of
from taintloom.functions.rule_tables import DEFAULT_VERSION, PHP_VERSIONS, RULES, SIGNATURES, VERSIONS

from .literals import indexed_join

SCHEMA = "language string, ord int, rule_id string, category string, default_severity string, min_version string, max_version string, severity_overrides map<string,string>, pattern string, confidence double"


def rules(spark: SparkSession) -> DataFrame:
    """All rules; those of C are there for C++ too."""
    rows = [(lang, k, *r) for lang, family in (("php", "php"), ("python", "python"), ("c", "c"), ("cpp", "c")) for k, r in enumerate(RULES[family])]
    return spark.createDataFrame(rows, SCHEMA)


def lookup(table: DataFrame, rule_id: str | None = None, category: str | None = None, version: str | None = None) -> DataFrame:
    """Rules by id, by category, or active for a version, and any of these together."""
    from .report import optional_filter

    table = optional_filter(table, rule_id=rule_id, category=category)
    return table if version is None else active(table.withColumn("version", F.lit(version))).drop("version", "severity")


def active(table: DataFrame, version: str = "version") -> DataFrame:
    """Rules whose bounds hold the row's version, with `severity` for it. C and C++ compare by the order of standards,
    the others number by number; an unknown version passes everything."""
    v, low, high = F.col(version), F.col("min_version"), F.col("max_version")
    held = F.when(F.col("language").isin("c", "cpp"), T.standard_in_range(v, low, high)).otherwise(T.version_in_range(v, low, high))
    return table.where(held).withColumn("severity", T.overridden(F.col("severity_overrides"), v, F.col("default_severity")))


def scan(lines: DataFrame, table: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    """(project_id, path, line_no, rule_id, category, severity, confidence, code) of lines that hold an active rule.

    versions: project_id, language, version; which rules are active is settled before a literal pattern is matched; an unknown
    version passes everything. Without a `table` the rules are those of this package: literal
    patterns, compiled once, behind one alternation that most lines fail. With one, of any size, lines meet those rules of
    their language whose literals they hold by an equi-join (`literals.indexed_join`), and what matches is held against the
    project's version.
    """
    if table is None:
        return _scan_literal(lines, versions)
    hit = indexed_join(lines, table, "code", ["language"])
    if versions is None:
        hit = hit.withColumn("version", F.lit(None).cast("string"))
    else:
        hit = hit.join(versions.select("project_id", "language", "version"), ["project_id", "language"], "left")
    return active(hit).select("project_id", "path", "line_no", "rule_id", "category", "severity", "confidence", F.trim("code").alias("code"))


def _scan_literal(lines: DataFrame, versions: DataFrame | None) -> DataFrame:
    """Which rules a project's version has is an array of their places in the table, one row a project and language; a line
    tests a rule's pattern only where its place is in there."""
    version = F.col("version")
    if versions is None:
        rows = lines.withColumn("version", F.lit(None).cast("string"))
    else:
        rows = lines.join(versions.select("project_id", "language", "version"), ["project_id", "language"], "left")
    out = None
    for family, languages in (("php", ["php"]), ("python", ["python"]), ("c", ["c", "cpp"])):
        found = []
        for rule_id, category, severity, low, high, overrides, pattern, confidence in RULES[family]:
            bounds = F.lit(low).cast("string"), F.lit(high).cast("string")
            held = T.standard_in_range(version, *bounds) if family == "c" else T.version_in_range(version, *bounds)
            ok = F.col("code").rlike(pattern) & (F.coalesce(held, F.lit(True)) if low or high else F.lit(True))
            grade = F.coalesce(*(F.when(version == v, F.lit(g)) for v, g in overrides.items()), F.lit(severity))
            found.append(F.when(ok, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), grade.alias("severity"), F.lit(float(confidence)).alias("confidence"))))
        some = rows.where(F.col("language").isin(languages) & F.col("code").rlike(any_of([r[6] for r in RULES[family]])))
        each = some.select("project_id", "path", "line_no", F.explode(F.array_compact(F.array(*found))).alias("r"), F.trim("code").alias("code"))
        part = each.select("project_id", "path", "line_no", "r.*", "code")
        out = part if out is None else out.unionByName(part)
    return out


def detected_versions(files: DataFrame) -> DataFrame:
    """(project_id, language, detected): the highest PHP version, or the first of the other languages' lists, that any
    file of a project gives away; else the default. Comments don't count. One flag per signature and file is summed
    map-side, so no project's text is put together."""
    text = F.col("text")
    plain = F.when(F.col("language") == "php", T.strip_php_comments(text)).when(F.col("language") == "python", F.regexp_replace(T.strip_python_comments(text), r"(?s)\"\"\".*?\"\"\"|'''.*?'''", "")).otherwise(T.strip_c_comments(text))
    rows = files.select("project_id", "language", plain.alias("plain"))
    best = []
    for lang, table in SIGNATURES.items():
        order = sorted(range(len(table)), key=lambda k: (-float(table[k][0]), k)) if lang == "php" else range(len(table))
        flag = "(?i)" if lang == "php" else ""
        first = F.coalesce(*(F.when(F.col("plain").rlike(flag + table[k][1]), F.lit(place)) for place, k in enumerate(order)))
        names = F.array(*(F.lit(table[k][0]) for k in order))
        found = rows.where(F.col("language") == lang).groupBy("project_id", "language").agg(F.min(first).alias("at"))
        best.append(found.select("project_id", "language", F.coalesce(F.get(names, F.col("at")), F.lit(DEFAULT_VERSION[lang])).alias("detected")))
    out = best[0]
    for b in best[1:]:
        out = out.unionByName(b)
    return out


def resolved_versions(detected: DataFrame, chosen: DataFrame) -> DataFrame:
    """(project_id, language, version, detected_by_code): a user's choice (project_id, language, chosen), else what the
    code gave away."""
    both = detected.join(chosen, ["project_id", "language"], "left").withColumn("chosen", F.nullif("chosen", F.lit("")))
    return both.select("project_id", "language", F.coalesce("chosen", "detected").alias("version"), F.col("chosen").isNull().alias("detected_by_code"))


def php_context(version: Column) -> Column:
    """What a PHP version has: states of its old APIs, what its connections trust, and whether its defaults are modern."""
    v = T.version_array(version)
    at_least = lambda x: v >= F.array(*(F.lit(int(n)) for n in x.split(".")))
    state = lambda gone, old: F.when(at_least(gone), "removed").when(at_least(old), "deprecated").otherwise("available")
    trusted = at_least("5.3.6")
    return F.struct(trusted.alias("dsn_charset_trusted"), F.when(trusted, "medium").otherwise("critical").alias("emulate_risk_level"), state("7.0", "5.5").alias("mysql_functions"), state("7.0", "5.5").alias("preg_replace_e"), state("7.4", "7.2").alias("create_function"), at_least("7.0").alias("is_php7"), at_least("8.0").alias("is_php8"))


def python_context(version: Column) -> Column:
    """What a Python version has."""
    v = T.version_array(version)
    at_least = lambda *x: v >= F.array(*(F.lit(n) for n in x))
    return F.struct((~at_least(3)).alias("is_python2"), at_least(3, 6).alias("has_fstring"), at_least(3, 8).alias("has_walrus"), at_least(3, 10).alias("has_match"), at_least(3).alias("input_is_safe"))


def c_context(standard: Column) -> Column:
    """What a C or C++ standard has. Standards compare by their order, in which every C++ stands behind every C."""
    at_least = lambda x: T.standard_rank(standard) >= T.standard_rank(F.lit(x))
    return F.struct(standard.startswith("c++").alias("is_cpp"), at_least("c++11").alias("has_nullptr"), at_least("c++11").alias("has_smart_ptr"), at_least("c++17").alias("has_string_view"), at_least("c11").alias("gets_removed"))


def labels(spark: SparkSession) -> DataFrame:
    """(language, version, label, note): the versions that a user can choose from."""
    rows = [("php", *r) for r in PHP_VERSIONS] + [(lang, v, "", "") for lang, vs in VERSIONS.items() for v in vs]
    return spark.createDataFrame(rows, "language string, version string, label string, note string")
