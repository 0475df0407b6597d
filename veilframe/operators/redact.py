"""Tokens in place of values, the text with them, and the gate that looks for values left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from veilframe.functions.checks import digits
from veilframe.functions.text import hmac_sha256, normalise
from veilframe.operators.resolve import lookup
from veilframe.operators.vocab import PROFILES, SHORT_NAMES
from veilframe.sources.kept import kept


def live(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("decision").isin("redact", "review"))


def keyed_token(entity: Column, value: Column, key: bytes) -> Column:
    """A pseudonym that only the key's holder can link across runs: [EMAIL_1A2B3C4D]."""
    norm = F.concat_ws("|", entity, normalise(entity, value))
    return F.concat(F.lit("["), lookup(SHORT_NAMES, entity, "VALUE"), F.lit("_"), F.upper(F.left(hmac_sha256(key, norm), F.lit(8))), F.lit("]"))


#: Ranges of the first ordering column within which values are numbered side by side.
CELLS = 4096


def numbered_vault(findings: DataFrame, order: list[str]) -> DataFrame:
    """entity_type, norm_value, token, occurrences, forms: values are numbered within their category by first appearance.

    No category is sorted in one task: values are ranked within ranges of the first ordering column (if it is a number),
    and the counts of the ranges before are added.
    """
    # used several times below: written once, rather than found again
    values = kept(live(findings).select(*dict.fromkeys([*order, "entity_type", "value"])), "live")
    values = values.withColumn("norm_value", normalise(F.col("entity_type"), F.col("value")))
    first = values.groupBy("entity_type", "norm_value").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("occurrences"), F.array_sort(F.collect_set("value")).alias("forms"))
    lead = F.col(f"first.{order[0]}")
    if isinstance(findings.schema[order[0]].dataType, NumericType):
        bounds = values.agg(F.min(order[0]).cast("double").alias("low"), F.max(order[0]).cast("double").alias("high"))
        cell = F.coalesce(F.floor((lead - F.col("low")) / (F.col("high") - F.col("low") + 1) * CELLS), F.lit(-1))
        first = first.join(F.broadcast(bounds)).withColumn("cell", cell).drop("low", "high")  # one row
    else:
        first = first.withColumn("cell", F.lit(0))
    before = Window.partitionBy("entity_type").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy("entity_type", "cell").agg(F.count("*").alias("here")).withColumn("earlier", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    inner = F.row_number().over(Window.partitionBy("entity_type", "cell").orderBy("first", "norm_value"))
    ranked = first.withColumn("inner", inner).join(counts, ["entity_type", "cell"])
    number = (F.col("inner") + F.col("earlier")).cast("string")
    number = F.when(F.char_length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    token = F.concat(F.lit("["), lookup(SHORT_NAMES, F.col("entity_type"), "VALUE"), F.lit("_U"), number, F.lit("]"))
    return ranked.select("entity_type", "norm_value", token.alias("token"), "occurrences", "forms")


def replacement(entity: Column, value: Column, token: Column, profile: str) -> Column:
    """What a profile puts in the value's place."""
    action = lookup(PROFILES[profile], entity, "token") if PROFILES[profile] else F.lit("token")
    short = lookup(SHORT_NAMES, entity, "VALUE")
    year = F.regexp_extract(value, "((?:19|20)[0-9]{2})", 1)
    return (
        F.when(action == "mask", F.concat(F.lit("["), short, F.lit("]")))
        .when((action == "last4") & (F.length(digits(value)) >= 4), F.concat(F.lit("["), short, F.lit("_****"), F.right(digits(value), F.lit(4)), F.lit("]")))
        .when(action == "last4", F.concat(F.lit("["), short, F.lit("]")))
        .when((action == "year") & (year != ""), F.concat(F.lit("["), short, F.lit("_"), year, F.lit("]")))
        .when(action == "year", F.concat(F.lit("["), short, F.lit("]")))
        .otherwise(token)
    )


def splice(spans: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """spans with safe_text: each live finding's stretch replaced by its `replacement`; overlapping stretches become one,
    with the first one's replacement."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = live(findings).withColumn("new", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = marked.groupBy(*keys, "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("replacement", F.struct("start", -F.col("end"))).alias("by"))
    edits = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", "by"))).alias("edits"))
    step = lambda a, e: F.struct(F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.greatest(e["start"] - a["at"], F.lit(0))), e["by"]).alias("out"), e["end"].alias("at"))
    done = F.aggregate("edits", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    text = F.concat(done["out"], F.substr(F.col("text"), done["at"] + 1, F.char_length("text")))
    return spans.join(edits, keys, "left").withColumn("safe_text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(text)).drop("edits")
