"""The analysis of projects: taint flows, enrichment, safe patterns, detectors, call graph, dedup and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintloom.functions.catalog import SEVERITY, cwe, lookup, severity
from taintloom.operators import callgraph, detectors, enrich, facts, taint, templates
from taintloom.operators.graph import cut
from taintloom.operators.relational import first_wins, supplement
from taintloom.sources.corpus import code_lines

FINDING = "finding_id long, project_id string, file_path string, line_number int, source_file string, source_line int, sink_line int, vuln_type string, severity string, cwe string, language string, source_func string, sink_func string, source_code string, sink_code string, data_flow string, path array<string>, description string, confidence double, pipeline_stage string, protection_level string, is_exploitable boolean, exploit_difficulty string, data_flow_notes string, status string, seq string"
ROW = ["project_id", "file_path", "line_number", "vuln_type", "sink_line"]


def by_language(vuln_type, language):
    """Severity by the tables of a finding's language."""
    return F.when(language == "php", severity("php", vuln_type)).when(language.isin("c", "cpp"), severity("c", vuln_type)).otherwise(severity("python", vuln_type))


def taint_findings(extracted: DataFrame, mode: str = "declarative") -> DataFrame:
    """Stage one: flows, one per (file, line, type), with severity and weakness number."""
    return graded(taint.flows(extracted, mode))


def graded(flows: DataFrame) -> DataFrame:
    """The first flow of each (file, line, type), with severity and weakness number."""
    found = first_wins(flows, ["project_id", "file_path", "line_number", "vuln_type"], ["seq"])
    runs_code = (F.col("vuln_type") == "command_execution") & F.col("sink_func").rlike("eval|exec|compile") & (F.col("language") == "python")
    number = F.when(runs_code, "CWE-94").otherwise(cwe(F.col("vuln_type")))
    return found.withColumns({"severity": by_language(F.col("vuln_type"), F.col("language")), "cwe": F.when(F.col("language") == "python", number), "pipeline_stage": F.lit("taint")})


def pattern_findings(detected: DataFrame, files: DataFrame) -> DataFrame:
    """Detectors' findings as findings: the first related type names them; safe and unreliable ones are none."""
    kind = F.coalesce(F.get("related_types", F.lit(0)), F.lit("command_execution"))
    grade = lookup({"dangerous_combo": "medium", "string_concat_sql": "high", "extract_override": "high", "hardcoded_credentials": "high", "debug_mode": "low", "archive_extract": "medium"}, F.col("pattern"), "medium")
    lang = files.select("project_id", F.col("path").alias("file_path"), "language")
    rows = detected.where(~F.col("is_safe") & (F.col("pattern") != "blacklist_filter"))
    rows = rows.select("project_id", "file_path", "line_number", F.col("line_number").alias("sink_line"), kind.alias("vuln_type"), grade.alias("severity"), F.col("evidence").alias("sink_code"), "confidence", F.lit("ast").alias("pipeline_stage"), F.concat_ws(" ", F.lit("pattern"), "pattern").alias("description"))
    return rows.join(lang, ["project_id", "file_path"], "left")


def analyse(files: DataFrame, mode: str = "declarative") -> DataFrame:
    """Findings of all stages for files (project_id, path, language, text), in the schema FINDING.

    What several stages read (facts, detections, flows, call graph) is checkpointed once, so no parse runs twice.
    """
    extracted = cut(facts.extract(files))
    flows = enrich.enrich(taint_findings(extracted, mode), files)
    detected = cut(detectors.detect(code_lines(files), detectors.block_spans(extracted)))
    flows = cut(enrich.downgrade(flows, detected))
    key = ["project_id", "file_path", "line_number", "vuln_type"]
    found = supplement(flows, pattern_findings(detected, files), key)
    found = supplement(found, templates.findings(files), key)
    found = supplement(found, callgraph.findings(callgraph.nodes(callgraph.functions(files))), key)
    stage = F.when(F.col("pipeline_stage") == "data_flow", 0).when(F.col("pipeline_stage") == "ast", 1).otherwise(2)
    found = first_wins(found.withColumn("sink_line", F.coalesce("sink_line", F.lit(0))), ROW, [stage, F.coalesce("seq", F.lit("\uffff")), "data_flow", "sink_code"])
    found = enrich.without_sourceless(found, files)
    found = found.withColumn("cwe", F.coalesce(F.nullif("cwe", F.lit("")), cwe(F.col("vuln_type")))).withColumn("status", F.lit("pending"))
    found = found.withColumn("finding_id", F.xxhash64(*ROW, "pipeline_stage"))
    names = [c.split(" ") for c in FINDING.split(", ")]
    return found.select(*((F.col(n) if n in found.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names))


LANGUAGES = sorted(SEVERITY)
