"""Verdicts: the heuristic one as a column rule, and what a verdict sets on a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heuristic(findings: DataFrame, filtered: str | None = None) -> DataFrame:
    """Adds (verdict, confidence): filtered or strongly protected ones are false positives (0.7), exploitable ones of easy
    or medium difficulty are confirmed (0.6), the rest is potential (0.4)."""
    safe = F.col("protection_level") == "strong"
    if filtered is not None:
        safe = safe | F.col(filtered)
    real = F.col("is_exploitable") & F.col("exploit_difficulty").isin("easy", "medium")
    verdict = F.when(safe, "false_positive").when(real, "confirmed").otherwise("potential")
    confidence = F.when(safe, 0.7).when(real, 0.6).otherwise(0.4)
    return findings.withColumn("verdict", verdict).withColumn("confidence", confidence)


def applied(judged: DataFrame) -> DataFrame:
    """Adds (status, is_vulnerable) from `verdict`; is_vulnerable has three values and stays a string."""
    v = F.col("verdict")
    status = F.when(v == "confirmed", "confirmed").when(v == "false_positive", "false_positive").otherwise("pending")
    vulnerable = F.when(v == "confirmed", "true").when(v == "false_positive", "false").otherwise("uncertain")
    return judged.withColumn("status", status).withColumn("is_vulnerable", vulnerable)
