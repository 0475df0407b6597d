"""What reviewers decide: values approved or rejected, and texts they add."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import matches, normalise


def decide(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Approved values are redacted and rejected ones dropped, wherever they stand. Only live findings change.

    decisions: entity_type, value_key, verdict ("approve" or "reject"), one row a value; a value with both is approved.
    """
    verdicts = decisions.groupBy("entity_type", "value_key").agg(F.min("verdict").alias("verdict"))
    own = findings.withColumn("value_key", normalise(F.col("entity_type"), F.col("value"))).join(verdicts, ["entity_type", "value_key"], "left")
    live = F.col("decision").isin("redact", "review")
    told = F.when(live & (F.col("verdict") == "approve"), "redact").when(live & (F.col("verdict") == "reject"), "drop").otherwise(F.col("decision"))
    return own.withColumn("decision", told).drop("verdict", "value_key")


def term_pattern(terms: list[str]) -> str:
    """Longest term first, any case, any white space between words; terms under three characters are left out."""
    kept = sorted({" ".join(t.split()) for t in terms if len(t.strip()) >= 3}, key=lambda t: (-len(t), t))
    return r"(?i)\b(?:" + "|".join(r"\s+".join(re.escape(w) for w in t.split()) for t in kept) + r")\b"


def add(spans: DataFrame, terms: list[str], entity: str = "CONFIDENTIAL_TERM", score: float = 1.0) -> DataFrame:
    """Findings of literal texts: spans' columns (without text), start, end, value, entity_type, recognizer, score."""
    keep = [c for c in spans.columns if c != "text"]
    pattern = term_pattern(terms)
    hit = spans.where(F.col("text").rlike(pattern)).select(*keep, F.explode(matches(F.col("text"), pattern)).alias("m"))
    return hit.select(*keep, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("value"), F.lit(entity).alias("entity_type"), F.lit("term").alias("recognizer"), F.lit(score).alias("score"))
