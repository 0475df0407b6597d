"""Aggregates over findings: exposure, residual risk, summaries, review, evaluation, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import mask, normalise
from veilframe.operators.redact import live
from veilframe.operators.resolve import lookup
from veilframe.operators.vocab import CRITICAL_WEIGHT, DEFAULT_SENSITIVITY, HIGH_DENSITY, MEDIUM_DENSITY, MISS_OTHER, MISS_PERSON, SENSITIVITY


def weight(entity: Column) -> Column:
    return lookup(SENSITIVITY, entity, DEFAULT_SENSITIVITY).cast("int")


def exposure(findings: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """A row a file: score (weights of distinct values), density a thousand words, rating. sizes has key and words."""
    values = live(findings).select(key, "entity_type", normalise(F.col("entity_type"), F.col("value")).alias("v")).distinct().withColumn("w", weight(F.col("entity_type")))
    sums = values.groupBy(key).agg(F.sum("w").alias("score"), F.count("*").alias("distinct_values"), F.max("w").alias("max_weight"))
    density = F.round(F.col("score") * 1000.0 / F.greatest(F.col("words"), F.lit(1)), 3)
    rating = F.when(F.col("max_weight") >= CRITICAL_WEIGHT, "critical").when(F.col("density") >= HIGH_DENSITY, "high").when(F.col("density") >= MEDIUM_DENSITY, "medium").otherwise("low")
    return sizes.join(sums, key).withColumn("density", density).withColumn("rating", rating)


def residual(findings: DataFrame, key: str) -> DataFrame:
    """Values expected to have been missed: r / (1 - r) for each distinct value found."""
    values = live(findings).select(key, "entity_type", normalise(F.col("entity_type"), F.col("value")).alias("v")).distinct()
    rate = F.when(F.col("entity_type") == "PERSON", MISS_PERSON / (1 - MISS_PERSON)).otherwise(MISS_OTHER / (1 - MISS_OTHER))
    return values.groupBy(key).agg(F.round(F.sum(rate), 6).alias("expected_missed"), F.count("*").alias("distinct_values"))


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("entity_type", "decision").agg(F.count("*").alias("n"), F.round(F.max("score"), 3).alias("max_score"))


def pivot(findings: DataFrame, column: str, values: list[str]) -> DataFrame:
    return findings.groupBy("entity_type").pivot(column, values).count().na.fill(0)


def review_queue(findings: DataFrame, key: str) -> DataFrame:
    """Values in the review band, each once, masked."""
    queued = findings.where("decision = 'review'").withColumn("value_key", normalise(F.col("entity_type"), F.col("value")))
    return queued.groupBy("entity_type", "value_key").agg(F.count("*").alias("occurrences"), F.countDistinct(key).alias("files"), F.max("score").alias("max_score")).withColumn("masked", mask(F.col("value_key")))


def activity(events: DataFrame) -> DataFrame:
    """Counts of guard events at several levels at once: by operator, by day, by type, by day and type, in all."""
    day = F.col("ts").cast("date").cast("string")
    rows = events.select(F.col("user_id").cast("string").alias("user_id"), day.alias("day"), "event_type", "value")
    u, d, e = F.col("user_id"), F.col("day"), F.col("event_type")
    return rows.groupingSets([[u], [d], [e], [d, e], []], u, d, e).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def guard_record(checks: DataFrame, keys: list[str]) -> DataFrame:
    """What is kept of a check for good: counts, never text."""
    return checks.select(*keys, "verdict", "blocked_by", "warned", "bytes", "code_lines", "n_values", "findings")


def by_rule(checks: DataFrame) -> DataFrame:
    """How often each rule refused a prompt or warned of it."""
    fired = checks.select(F.explode(F.concat(F.transform("blocked_by", lambda r: F.struct(r.alias("rule"), F.lit("blocked").alias("action"))), F.transform("warned", lambda r: F.struct(r.alias("rule"), F.lit("warned").alias("action"))))).alias("f"))
    return fired.select("f.*").groupBy("rule", "action").agg(F.count("*").alias("n"))


def by_category(findings: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Live findings by category; categories that a policy names are counted even at zero by the caller's join."""
    found = live(findings)
    if categories is not None:
        found = found.where(F.col("entity_type").isin(categories))
    return found.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct(normalise(F.col("entity_type"), F.col("value"))).alias("values"))


def file_summary(findings: DataFrame, key: str) -> DataFrame:
    """A row a file: counts by decision, and maps of live counts by category, context_type and layer, where there are such
    columns."""
    rows = findings.groupBy(key).agg(*[F.sum((F.col("decision") == d).cast("long")).alias(d) for d in ("redact", "review", "drop")])
    for name, column in (("categories", "entity_type"), ("contexts", "context_type"), ("layers", "layer")):
        if column in findings.columns:
            counted = live(findings).groupBy(key, column).agg(F.count("*").alias("n"))
            rows = rows.join(counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name)), key, "left")
    return rows


def exposure_by(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of distinct values by file and page, or file and category."""
    values = live(findings).select(*dict.fromkeys([*keys, "entity_type"]), normalise(F.col("entity_type"), F.col("value")).alias("v")).distinct()
    return values.groupBy(*keys).agg(F.sum(weight(F.col("entity_type"))).alias("score"), F.count("*").alias("distinct_values"))


def exposure_ranking(exposures: DataFrame, key: str) -> DataFrame:
    """Most exposed first, by rating, then score."""
    order = F.when(F.col("rating") == "critical", 0).when(F.col("rating") == "high", 1).when(F.col("rating") == "medium", 2).otherwise(3)
    return exposures.orderBy(order, F.desc("score"), key)


def image_only(findings: DataFrame, keys: tuple[str, ...] = ("entity_type", "norm_value")) -> DataFrame:
    """Values that stand in pictures and nowhere in text. findings have a column source."""
    values = live(findings).withColumn("norm_value", normalise(F.col("entity_type"), F.col("value")))
    return values.where("source = 'image_ocr'").join(values.where("source <> 'image_ocr'").select(*keys), list(keys), "left_anti").select(*keys).distinct()


def most_common(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def evaluate(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row: true and false positives and negatives, recall, precision, F1 of `label` against `guess` (0/1)."""
    both = gold.join(predicted, key)
    count = lambda g, p: F.sum(((F.col("label") == g) & (F.col("guess") == p)).cast("long"))
    row = both.agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return row.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
