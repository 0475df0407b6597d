"""From overlapping raw findings to those that stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.rules import route
from veilframe.operators.vocab import PRIORITY, REVIEW

#: How far below the winner's score a finding may still widen it, how much wider it may become, and what
#: each further layer that agrees adds.
WIDEN_SCORE, WIDEN_FACTOR, WIDEN_MORE, LAYER_BONUS, MOST_BONUS = 0.15, 1.8, 3, 0.1, 0.2
LABEL_BEFORE = r"[A-Za-z][A-Za-z .#/()'-]{1,40}[ \t]*[:：][ \t]*$"


def lookup(values: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def clusters(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds cluster: findings of a span that overlap, directly or through others, share one."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "recognizer")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return findings.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("cluster", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def resolve(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each cluster the winner and the survivors, with their decisions.

    The winner has the category of the highest priority (if its score is plausible), then the highest score, the greatest
    length, the first place, the first name. Findings of its category that overlap it and score little less widen it, in
    their order; further layers that agree raise the highest score among them by 0.1 each, 0.2 at most. What the winner
    then does not hold survives, if of its category; of another category, if it lies apart or has a higher priority. The
    column `layer`, where there is none, counts as one layer for all.
    """
    given = findings if "layer" in findings.columns else findings.withColumn("layer", F.lit("L1"))
    grouped = clusters(given, keys)
    order = lookup(PRIORITY, F.col("entity_type"), 3)
    group = Window.partitionBy(*keys, "cluster")
    best = group.orderBy((order * (F.col("score") >= REVIEW).cast("int")).desc(), F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "recognizer")
    ranked = grouped.withColumn("n", F.row_number().over(best)).withColumn("first", F.first(F.struct("start", "end", "score", "entity_type")).over(best))
    same = F.col("entity_type") == F.col("first.entity_type")
    agree = F.sort_array(F.collect_list(F.when(same & (F.col("n") > 1), F.struct("start", F.negative("end").alias("back"), "recognizer", "end", "score"))).over(group))
    layers = F.size(F.collect_set(F.when(same, F.col("layer"))).over(group))
    top = F.max(F.when(same, F.col("score"))).over(group)
    ranked = ranked.withColumns({"agree": agree, "layers": layers, "top": top})

    def widen(w: Column, f: Column) -> Column:
        start, end = F.least(w["start"], f["start"]), F.greatest(w["end"], f["end"])
        fits = (f["start"] < w["end"]) & (f["end"] > w["start"]) & (f["score"] >= F.col("first.score") - WIDEN_SCORE) & (end - start <= (w["end"] - w["start"]) * WIDEN_FACTOR + WIDEN_MORE)
        return F.struct(F.when(fits, start).otherwise(w["start"]).alias("start"), F.when(fits, end).otherwise(w["end"]).alias("end"))

    ranked = ranked.withColumn("wide", F.aggregate("agree", F.struct(F.col("first.start").alias("start"), F.col("first.end").alias("end")), widen)).drop("agree")
    bonus = F.least((F.col("layers") - 1) * LAYER_BONUS, F.lit(MOST_BONUS))
    raised = F.when(F.col("layers") > 1, F.round(F.least(F.lit(1.0), F.col("top") + bonus), 3)).otherwise(F.col("score"))
    won = F.col("n") == 1
    inside = (F.col("start") >= F.col("wide.start")) & (F.col("end") <= F.col("wide.end"))
    apart = (F.col("start") >= F.col("wide.end")) | (F.col("end") <= F.col("wide.start"))
    stays = won | (~inside & (same | apart | (order > lookup(PRIORITY, F.col("first.entity_type"), 3))))
    text_wide = won & ((F.col("wide.start") != F.col("start")) | (F.col("wide.end") != F.col("end")))
    kept = ranked.where(stays).withColumn("widened", text_wide)
    out = kept.select(*[c for c in findings.columns if c not in ("start", "end", "score")], F.when(won, F.col("wide.start")).otherwise(F.col("start")).alias("start"), F.when(won, F.col("wide.end")).otherwise(F.col("end")).alias("end"), F.when(won, raised).otherwise(F.col("score")).alias("score"), "widened")
    return out.withColumn("decision", route(F.col("score")))


def rewritten(resolved: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """resolved, with the value of widened findings read from the text of their span."""
    both = resolved.join(spans.select(*keys, "text"), keys)
    return both.withColumn("value", F.when(F.col("widened"), F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.col("value"))).drop("text", "widened")


def annotate(findings: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds context_type: table, image, metadata, labelled or narrative. spans may have the columns kind and source."""
    kind, source = (F.col(c) if c in spans.columns else F.lit("") for c in ("kind", "source"))
    told = spans.select(*keys, "text", kind.alias("span_kind"), source.alias("span_source"))
    before = F.regexp_extract(F.substr(F.col("text"), F.lit(1), F.col("start")), r"([^\n]*)$", 1)
    context = F.when(F.col("span_kind") == "table_cell", "table").when((F.col("span_source") == "image_ocr") | (F.col("span_kind") == "image_ocr"), "image").when(F.col("span_kind") == "metadata", "metadata").when(before.rlike(LABEL_BEFORE), "labelled").otherwise("narrative")
    return findings.join(told, keys).withColumn("context_type", context).drop("text", "span_kind", "span_source")
