"""Transcripts and delimited files as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMES = r"(\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3})\s+-->\s+(\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3})"


def transcript(files: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Cues of .vtt and .srt texts: id_col, span_ord, begins, ends, speaker (null if unnamed), text.

    A speaker is a voice tag, or a name of at most five words before a colon. Blocks without times (titles, notes,
    styles) are no cues.
    """
    body = F.replace(F.col(text_col), F.lit("\r"), F.lit(""))
    blocks = files.select(id_col, F.posexplode(F.split(body, r"\n\s*\n")).alias("span_ord", "block")).where(F.col("block").rlike(TIMES) & ~F.col("block").rlike(r"^\s*(?:NOTE|STYLE|REGION)\b"))
    speech = F.trim(F.regexp_replace("block", r"(?s)^.*?" + TIMES + r"[^\n]*\n?", ""))
    voice = F.regexp_extract(speech, r"^<v(?:\.[^ >]*)?\s+([^>]+)>", 1)
    plain = F.regexp_replace(speech, r"</?[vcbiu](?:\.[^ >]*)?(?:\s[^>]*)?>", "")
    named = F.regexp_extract(plain, r"^(\p{Lu}[\p{L}.'’-]*(?: [\p{L}.'’-]+){0,4}):\s", 1)
    speaker = F.when(voice != "", voice).when(named != "", named)
    text = F.when((voice == "") & (named != ""), F.regexp_replace(plain, r"^[^:]+:\s+", "")).otherwise(plain)
    return blocks.select(id_col, "span_ord", F.regexp_extract("block", TIMES, 1).alias("begins"), F.regexp_extract("block", TIMES, 2).alias("ends"), speaker.alias("speaker"), text.alias("text"))


def csv_cells(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Cells that are not blank, under their headers: file, header, col, text. Files are split and read by Spark."""
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).csv(path)
    cells = F.array(*[F.struct(F.lit(c).alias("header"), F.lit(i).alias("col"), F.col(f"`{c}`").alias("text")) for i, c in enumerate(rows.columns)])
    return rows.select(F.input_file_name().alias("file"), F.explode(cells).alias("c")).select("file", "c.*").where(F.trim("text") != "")
