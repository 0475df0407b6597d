"""Findings against labels made by hand: matches, recall, precision, leaks, what structure survived."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.operators.fuzzy import ratio
from veilframe.operators.redact import live
from veilframe.sources.kept import kept

#: Columns of the labels; categories that count as one another; scores of matches.
GOLD_COLUMNS = ["file", "page", "text", "category", "context_type", "note"]
EQUIVALENT = [("EMPLOYEE_ID", "VENDOR_ID"), ("EMPLOYEE_ID", "NATIONAL_ID"), ("TAX_ID", "US_SSN"), ("TAX_ID", "NATIONAL_ID"), ("NATIONAL_ID", "PL_PESEL"), ("NATIONAL_ID", "US_SSN"), ("NATIONAL_ID", "IN_PAN"), ("NATIONAL_ID", "PASSPORT")]
WIDER, FAR_WIDER, NARROWER, LIKE = 0.9, 0.5, 0.8, 0.85


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file with the columns GOLD_COLUMNS; a page that is no number is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip("﻿ ").lower(): c for c in rows.columns}
    picked = rows.select(*[(F.col(f"`{have[c]}`") if c in have else F.lit(None).cast("string")).alias(c) for c in GOLD_COLUMNS])
    return picked.withColumns({"file": F.trim("file"), "page": F.when(F.trim("page").rlike("^[0-9]+$"), F.trim("page").cast("int")), "category": F.upper(F.trim("category")), "context_type": F.coalesce(F.nullif(F.trim("context_type"), F.lit("")), F.lit("unspecified"))})


def gold_template(findings: DataFrame) -> DataFrame:
    """Findings as a table of labels to be put right by hand."""
    page = F.col("page") if "page" in findings.columns else F.lit(None).cast("int")
    return live(findings).select("file", page.alias("page"), F.col("value").alias("text"), F.col("entity_type").alias("category"), F.lit("").alias("context_type"), F.lit("").alias("note"))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9@]", "")


def same_category(a: Column, b: Column) -> Column:
    pairs = F.array(*[F.concat(F.lit(x), F.lit("|"), F.lit(y)) for p in EQUIVALENT for x, y in (p, p[::-1])])
    return (a == b) | F.array_contains(pairs, F.concat(a, F.lit("|"), b))


def score_sure(g: Column, t: Column) -> Column:
    """The score of a match as far as it needs no comparison letter by letter; null otherwise."""
    return (
        F.when((g == "") | (t == ""), 0.0)
        .when(g == t, 1.0)
        .when(F.contains(t, g), F.when(F.char_length(t) <= 3 * F.char_length(g) + 10, WIDER).otherwise(FAR_WIDER))
        .when(F.contains(g, t) & (F.char_length(t) >= 0.6 * F.char_length(g)), NARROWER)
    )


def scored(pairs: DataFrame) -> DataFrame:
    """pairs (g, t) with score: sure matches by columns, the rest by the share of letters in common."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    told = pairs.withColumn("score", score_sure(F.col("g"), F.col("t")))
    # texts whose lengths are far apart cannot be alike
    low, high = F.least(F.char_length("g"), F.char_length("t")), F.greatest(F.char_length("g"), F.char_length("t"))
    near = told.where("score is null").where(2 * low >= LIKE * (low + high)).drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, t = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("g", "t"))
            s = [ratio(x, y) / 100 for x, y in zip(g, t, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x if x >= LIKE else 0.0 for x in s], pa.float64())], [*b.schema.names, "score"])

    return told.where("score is not null").unionByName(near.mapInArrow(run, f"{fields}, score double")).where("score > 0")


def matched(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """One-to-one matches of labels (gold_id, file, page, text, category) and live findings (finding_id, file, page, value,
    entity_type): best scores first, of equal ones those of the same category, then by number. Ids are unique within a file."""
    g = gold.select("gold_id", F.col("file").alias("g_file"), F.col("page").alias("g_page"), plain(F.col("text")).alias("g"), F.col("category"))
    f = live(findings).select("finding_id", F.col("file").alias("f_file"), F.col("page").alias("f_page"), plain(F.col("value")).alias("t"), "entity_type")
    here = (F.col("g_file") == F.col("f_file")) & (F.col("g_page").isNull() | F.col("f_page").isNull() | (F.col("g_page") == F.col("f_page")))
    pairs = scored(g.join(f, here)).withColumn("same", same_category(F.col("category"), F.col("entity_type"))).select("g_file", "gold_id", "finding_id", "score", "same")
    return one_to_one(pairs, ["g_file", "gold_id"], ["g_file", "finding_id"], [F.col("score").desc(), F.col("same").desc(), F.col("gold_id"), F.col("finding_id")]).drop("g_file")


def one_to_one(pairs: DataFrame, left: list[str], right: list[str], order: list[Column]) -> DataFrame:
    """Pairs taken best first, each end once: what a walk down all pairs in `order` would take, an order without ties.

    A pair that is the best one of both its ends is taken by that walk whatever else there is, so all such pairs are taken at once,
    and with them go the others of their ends; then again. The best pair left is always among them, so every round takes some;
    a round is two groupings and two anti-joins, and no group, file or table is ever in one task. No pairs: none.
    """
    rank = F.row_number().over
    left_, right_ = Window.partitionBy(*left).orderBy(*order), Window.partitionBy(*right).orderBy(*order)
    columns, pairs, rounds = pairs.columns, kept(pairs, "pairs"), []
    while not pairs.isEmpty():
        both = pairs.withColumns({"of_left": rank(left_), "of_right": rank(right_)})
        rounds.append(kept(both.where("of_left = 1 AND of_right = 1").drop("of_left", "of_right"), "taken"))
        gone = rounds[-1]
        pairs = kept(pairs.join(gone.select(*left), left, "left_anti").join(gone.select(*right), right, "left_anti"), "pairs")
    out = pairs
    for taken in rounds:
        out = out.unionByName(taken)
    return out.select(*columns)


def evaluate(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: gold, recalled, category_correct, findings, true_positives, auto_findings, auto_true_positives, recall,
    category_recall, precision, auto_precision, f1."""
    hits = matched(gold, findings)
    found = live(findings)
    g = gold.select("file", plain(F.col("text")).alias("g")).distinct()
    f = found.select("finding_id", "file", "decision", plain(F.col("value")).alias("t"))
    right = scored(f.join(g, "file")).select("finding_id").distinct()
    judged = f.join(right.withColumn("ok", F.lit(True)), "finding_id", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    recalled = hits.agg(F.count("*").alias("recalled"), n(F.col("same")).alias("category_correct"))
    precision = judged.agg(F.count("*").alias("findings"), n(F.col("ok")).alias("true_positives"), n(F.col("decision") == "redact").alias("auto_findings"), n((F.col("decision") == "redact") & F.col("ok")).alias("auto_true_positives"))
    row = gold.agg(F.count("*").alias("gold")).join(F.broadcast(recalled)).join(F.broadcast(precision))  # one row each
    share = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    row = row.withColumns({"recall": share("recalled", "gold"), "category_recall": share("category_correct", "gold"), "precision": share("true_positives", "findings"), "auto_precision": share("auto_true_positives", "auto_findings")})
    return row.withColumn("f1", F.round(F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0), 4))


def by(gold: DataFrame, hits: DataFrame, column: str) -> DataFrame:
    """Recall by category, context_type or file."""
    both = gold.join(hits.select("gold_id", "same"), "gold_id", "left")
    out = both.groupBy(column).agg(F.count("*").alias("gold"), F.count("same").alias("recalled"), F.sum(F.coalesce(F.col("same").cast("long"), F.lit(0))).alias("category_correct"))
    return out.withColumn("recall", F.round(F.col("recalled") / F.col("gold"), 4))


def leaks(gold: DataFrame, redacted: DataFrame) -> DataFrame:
    """Labels whose text, three characters or more, still stands between word edges in the redacted text of its file."""
    both = gold.where(F.char_length("text") >= 3).join(redacted.select("file", F.col("text").alias("redacted")), "file")
    parts = F.split("redacted", F.concat(F.lit(r"\Q"), F.replace(F.col("text"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    # between two neighbouring parts the text stands; its edges are the last and the first letter there
    edge = lambda c: ~c.rlike(r"(?U)^\w$")
    ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: edge(F.right(p, F.lit(1))))
    begins = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: edge(F.left(p, F.lit(1))))
    open_ = F.exists(F.zip_with(ends, begins, lambda a, b: a & b), lambda x: x)
    return both.where(F.contains("redacted", F.col("text"))).where(open_).drop("redacted")


def held_out(findings: DataFrame, values: DataFrame) -> DataFrame:
    """Leak rate by category and variant of made-up values (file, text, category, variant): not found by any live finding."""
    f = live(findings).select("file", plain(F.col("value")).alias("t"))
    v = values.withColumn("g", plain(F.col("text")))
    caught = v.join(f, (v["file"] == f["file"]) & F.contains(F.col("t"), F.col("g")), "left_semi").select("file", "text").distinct().withColumn("caught", F.lit(1))
    out = v.join(caught, ["file", "text"], "left").groupBy("category", "variant").agg(F.count("*").alias("values"), F.count("caught").alias("caught"))
    return out.withColumn("leak_rate", F.round(1 - F.col("caught") / F.col("values"), 4))


def structure(spans: DataFrame, key: str = "path") -> DataFrame:
    """Counts of what a file is made of: paragraphs, headings, tables, rows, cells, by the anchors of its spans."""
    table = F.when(F.col("kind") == "table_cell", F.regexp_extract("anchor", r"^(.*?)r\d+c\d+$", 1))
    row = F.when(F.col("kind") == "table_cell", F.regexp_extract("anchor", r"^(.*?r\d+)c\d+$", 1))
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return spans.groupBy(key).agg(n("paragraph").alias("paragraphs"), n("heading").alias("headings"), F.countDistinct(table).alias("tables"), F.countDistinct(row).alias("rows"), n("table_cell").alias("cells"))


def retention(got: DataFrame, reference: DataFrame, key: str = "path") -> DataFrame:
    """The mean share of each kind of structure of the reference that is still there."""
    names = [c for c in reference.columns if c != key]
    both = reference.join(got.select(key, *[F.col(c).alias(f"got_{c}") for c in names]), key, "left")
    shares = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.least(F.coalesce(F.col(f"got_{c}"), F.lit(0)), F.col(c)) / F.col(c)) for c in names]))
    return both.select(key, F.round(F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares)), 4).alias("retention"))

