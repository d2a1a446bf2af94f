"""Flow enrichment: protections and transformations between source and sink, exploitability, downgrades and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintloom.functions import patterns as P

from .relational import band_covered


def between(rows: Column, a: Column, b: Column) -> Column:
    """Text of the lines (an array) from the smaller to the larger of two line numbers."""
    start = F.greatest(F.least(a, b), F.lit(1))
    n = F.greatest(F.greatest(a, b) - start + 1, F.lit(0))
    return F.coalesce(F.array_join(F.slice(rows, start, n), "\n"), F.lit(""))


def categories(context: Column, table: dict[str, list[str]]) -> Column:
    """Names of a table's categories that have a pattern in the context, in the table's order."""
    return F.filter(F.array(*(F.when(context.rlike("(?i)" + P.any_of(ps)), F.lit(c)) for c, ps in table.items())), lambda x: x.isNotNull())


def protection_level(found: Column, vuln_type: Column) -> Column:
    has = lambda c: F.array_contains(found, c)
    sql, command, xss = (vuln_type == t for t in ("sql_injection", "command_execution", "xss"))
    return (
        F.when(F.size(found) == 0, "none")
        .when(sql & (has("prepared_statement") | has("sql_parameterized")), "strong")
        .when(sql & has("sql_escape"), "partial")
        .when(command & has("command_allowlist"), "strong")
        .when(command & has("escapeshellarg"), "partial")
        .when(xss & has("html_encode"), "strong")
        .when(has("allowlist_check") | has("type_validation"), "strong")
        .otherwise("partial")
    )


def difficulty(level: Column) -> Column:
    return F.when(level == "none", "easy").when(level == "strong", "unlikely").otherwise("medium")


def notes(level: Column, transforms: Column) -> Column:
    base = F.when(level == "none", "no protection on the way").when(level == "partial", "protected in part").when(level == "strong", "protected")
    more = [F.when(F.array_contains(transforms, t), s) for t, s in (("encode", "the value is encoded"), ("truncate", "the value is cut"), ("type_cast", "the value is cast"))]
    return F.concat_ws("; ", base, *more)


def enrich(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Adds protection_level, transforms, is_exploitable, exploit_difficulty, data_flow_notes, and moves the stage on.

    The text joins in once for each file with findings, with all pairs of lines that they ask for; what stands between
    each pair becomes names of categories, which is all that goes back to the findings.
    """
    key, spot = ["project_id", "file_path"], ["source_line", "sink_line"]
    text = files.select("project_id", F.col("path").alias("file_path"), F.split("text", "\n", -1).alias("__rows"))
    asked = findings.select(*key, F.struct(*spot).alias("__s")).distinct().groupBy(*key).agg(F.collect_list("__s").alias("__s"))
    read = asked.join(text, key).select(*key, F.explode(F.transform("__s", lambda s: F.struct(s["source_line"].alias("source_line"), s["sink_line"].alias("sink_line"), between(F.col("__rows"), s["source_line"], s["sink_line"]).alias("c")))).alias("__x"))
    found = [F.col("project_id"), F.col("file_path"), F.col("__x.source_line"), F.col("__x.sink_line")]
    seen = read.select(*(c.alias(f"__k{n}") for n, c in enumerate(found)), categories(F.col("__x.c"), P.PROTECTIONS).alias("__p"), categories(F.col("__x.c"), P.TRANSFORMS).alias("__t"))
    none = F.array().cast("array<string>")
    same = [F.col(c).eqNullSafe(F.col(f"__k{n}")) for n, c in enumerate(key + spot)]
    joined = findings.join(seen, same[0] & same[1] & same[2] & same[3], "left").withColumns({c: F.coalesce(c, none) for c in ("__p", "__t")}).drop(*(f"__k{n}" for n in range(4)))
    out = joined.withColumn("protection_level", protection_level(F.col("__p"), F.col("vuln_type"))).withColumn("transforms", F.when(F.size("__t") > 0, F.col("__t")).otherwise(F.array(F.lit("none")))).drop("__p", "__t")
    level = F.col("protection_level")
    return out.withColumns({"is_exploitable": level != "strong", "exploit_difficulty": difficulty(level), "data_flow_notes": notes(level, F.col("transforms")), "pipeline_stage": F.lit("data_flow"), "source_var": F.get("path", F.lit(0)), "sink_var": F.try_element_at("path", F.lit(-1))})


def downgrade(findings: DataFrame, detected: DataFrame) -> DataFrame:
    """Findings with a safe pattern of their type within three lines become info, with a note on their flow."""
    covers = F.create_map(*(x for k, v in P.SAFE_COVERS.items() for x in (F.lit(k), F.array(*(F.lit(t) for t in v)))))
    spots = detected.where("is_safe").select("project_id", "file_path", "line_number", F.explode(F.try_element_at(covers, F.col("pattern"))).alias("vuln_type"))
    out = band_covered(findings, spots, ["project_id", "file_path", "vuln_type"], "line_number", "line_number", 3)
    return out.withColumn("severity", F.when(F.col("covered"), "info").otherwise(F.col("severity"))).withColumn("data_flow", F.when(F.col("covered"), F.concat(F.lit("[safe pattern] "), F.coalesce("data_flow", F.lit("")))).otherwise(F.col("data_flow"))).drop("covered")


def without_sourceless(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Drops findings of input-dependent types whose file shows no sign of user input, unless their stage has proven it or
    their type needs none. A missing or empty file keeps its findings."""
    text = F.col("text")
    sign = F.when(F.col("language") == "php", text.rlike(P.any_of(P.PHP_INPUT))).otherwise(text.rlike(P.any_of(P.PYTHON_INPUT)))
    flags = files.where("text <> ''").select("project_id", F.col("path").alias("file_path"), sign.alias("__sign"))
    proven = F.col("pipeline_stage").isin("taint", "data_flow", "ast") | F.col("vuln_type").isin(P.EXEMPT_TYPES) | ~F.col("vuln_type").isin(P.INPUT_TYPES)
    return findings.join(flags, ["project_id", "file_path"], "left").where(proven | F.coalesce("__sign", F.lit(True))).drop("__sign")
