"""Tables as spans: (key, span_ord, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str) -> DataFrame:
    """A span a line that is not blank."""
    return docs.select(key, F.posexplode(F.split("text", "\n")).alias("span_ord", "text")).where(F.trim("text") != "")


def paragraphs(docs: DataFrame, key: str) -> DataFrame:
    """A span for each stretch between blank lines."""
    return docs.select(key, F.posexplode(F.split("text", "\n\n")).alias("span_ord", "text")).where(F.trim("text") != "")


def prompt_blocks(turns: DataFrame, keys: list[str]) -> DataFrame:
    """A span for each block of lines, with its place in the prompt."""
    from veilframe.functions.text import matches

    found = turns.select(*keys, F.posexplode(matches(F.col("text"), r"(?:[^\n]+\n?)+")).alias("span_ord", "m"))
    return found.select(*keys, "span_ord", F.col("m.start").alias("start"), F.col("m.text").alias("text"))


def html_text(html):
    """Text of a page: scripts and styles dropped, block ends become line ends, tags removed, common entities read."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", "")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t
