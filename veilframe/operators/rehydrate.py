"""Values back in the place of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import matches

TOKEN = r"\[[A-Z][A-Z_]*_(?:U?[0-9]{3,}|[0-9A-F]{8})(?:_[0-9]+)?\]"
#: What a model makes of a token: other brackets, case, blanks or hyphens in place of the underscore.
DAMAGED = r"[\[({<]\s*([A-Za-z]+(?:[\s_-]+[A-Za-z]+)*)[\s_-]+([Uu]?[0-9]{3,})\s*[\])}>]"


def repair(text: Column) -> Column:
    """Tokens in the form that the vault knows: [PERSON_001]."""
    found = F.transform(matches(text, DAMAGED), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit("["), F.upper(F.regexp_replace(F.trim(F.regexp_replace(m["text"], r"[\[({<>})\]]", "")), r"[\s_-]+", "_")), F.lit("]")).alias("put")))
    return spliced(text, found)


def spliced(text: Column, edits: Column) -> Column:
    """text with each stretch of edits (start, end, put; in order, apart) replaced."""
    step = lambda a, e: F.struct(F.concat(a["out"], F.substr(text, a["at"] + 1, e["start"] - a["at"]), e["put"]).alias("out"), e["end"].alias("at"))
    done = F.aggregate(edits, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.char_length(text)))


def rehydrate(texts: DataFrame, keys: list[str], vault: DataFrame, text_col: str = "safe_text") -> DataFrame:
    """keys, restored, n_restored, unknown (tokens that the vault lacks), ambiguous (tokens of several written forms, left
    as they are unless they name a person). vault: entity_type, token, forms. keys identify a row of texts."""
    longest = F.element_at(F.array_sort("forms", lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(a) - F.char_length(b)).when(a < b, -1).when(a > b, 1).otherwise(0)), -1)
    known = vault.select("token", F.when((F.size("forms") == 1) | (F.col("entity_type") == "PERSON"), longest).alias("value"), F.lit(True).alias("known"))
    placed = texts.where(F.col(text_col).rlike(TOKEN)).select(*keys, F.explode(matches(F.col(text_col), TOKEN)).alias("m"))
    found = placed.select(*keys, "m.start", "m.end", F.col("m.text").alias("token")).join(known, "token", "left")
    edit = F.struct("start", "end", F.coalesce("value", "token").alias("put"))
    edits = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(edit)).alias("edits"),
        F.count("value").cast("int").alias("n"),
        F.array_sort(F.collect_set(F.when(F.col("known").isNull(), F.col("token")))).alias("unknown"),
        F.array_sort(F.collect_set(F.when(F.col("known") & F.col("value").isNull(), F.col("token")))).alias("ambiguous"),
    )
    none = F.array().cast("array<string>")
    restored = F.when(F.col("edits").isNull(), F.col(text_col)).otherwise(spliced(F.col(text_col), F.col("edits")))
    return texts.join(edits, keys, "left").select(*keys, restored.alias("restored"), F.coalesce("n", F.lit(0)).alias("n_restored"), F.coalesce("unknown", none).alias("unknown"), F.coalesce("ambiguous", none).alias("ambiguous"))
