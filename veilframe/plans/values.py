"""Queries of review, rehydration, structure and the dashboard, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.functions import text
from veilframe.operators import protected, redact, rehydrate, residue, review, structure
from veilframe.plans.registry import CLUSTER_SQL, LINES_SQL, NORM_SQL, WORDS_SQL, document_lines, occurrences_sql, query, resolved, table
from veilframe.sources.kept import kept

TERMS = ["All rights reserved", "licensed under", "permission is hereby granted"]


@query(f"""WITH {CLUSTER_SQL}, k AS (SELECT *, {NORM_SQL} AS value_key FROM won)
SELECT doc_id, span_ord, start, value, entity_type, CASE WHEN decision = 'drop' OR NOT bool_or(decision = 'review') OVER (PARTITION BY entity_type, value_key) THEN decision WHEN length(value_key) % 2 = 0 THEN 'redact' ELSE 'drop' END AS decision FROM k""")
def review_applied(spark, sf_dir):
    """Each value in review is decided by the parity of its length, for want of reviewers."""
    won = resolved(spark, sf_dir)
    keys = won.where("decision = 'review'").select("entity_type", text.normalise(F.col("entity_type"), F.col("value")).alias("value_key")).distinct()
    told = keys.withColumn("verdict", F.when(F.char_length("value_key") % 2 == 0, "approve").otherwise("reject"))
    return review.decide(won, told).select("doc_id", "span_ord", "start", "value", "entity_type", "decision")


@query(occurrences_sql(review.term_pattern(TERMS)))
def confidential_terms(spark, sf_dir):
    return review.add(document_lines(spark, sf_dir), TERMS).select("doc_id", "span_ord", "value", "start")


@query(f"WITH {LINES_SQL} SELECT doc_id, span_ord, md5(text) AS digest, 0 AS unknown FROM spans")
def rehydrated(spark, sf_dir):
    """Redacted and restored: every line is as it was, as no value here has two written forms."""
    won = resolved(spark, sf_dir)
    vault = redact.numbered_vault(won, ["doc_id", "span_ord", "start"])
    own = won.withColumn("norm_value", text.normalise(F.col("entity_type"), F.col("value"))).join(vault.select("entity_type", "norm_value", F.col("token").alias("replacement")), ["entity_type", "norm_value"])
    safe = redact.splice(document_lines(spark, sf_dir), own, ["doc_id", "span_ord"])
    back = rehydrate.rehydrate(safe, ["doc_id", "span_ord"], vault)
    return back.select("doc_id", "span_ord", F.md5("restored").alias("digest"), F.size("unknown").alias("unknown"))


def category_sql(label: str) -> str:
    """SQL engines here know no look-ahead: what one forbids is taken out of the label first."""
    low = f"lower(trim({label}))"

    def case(category: str, rx: str) -> str:
        rx, of = rx.replace("'", "''"), low
        if "(?! ?card)" in rx:
            rx, of = rx.replace("(?! ?card)", ""), f"regexp_replace({low}, '\\bpan ?card', '#', 'g')"
        return f"WHEN regexp_matches({of}, '{rx}') THEN " + (f"CASE WHEN NOT regexp_matches({low}, '{structure.NOT_PERSON}') THEN 'PERSON' END" if category == "PERSON" else f"'{category}'")

    return f"CASE WHEN length({low}) > {structure.LONGEST_HEADER} THEN NULL " + " ".join(case(c, rx) for c, rx in structure.HEADERS) + " END"


@query(f"""WITH {LINES_SQL}, l AS (SELECT *, regexp_extract(text, '{structure.LABEL}', 1) AS label, rtrim(regexp_extract(text, '{structure.LABEL}', 2), ' ') AS whole FROM spans WHERE regexp_matches(text, '{structure.LABEL}')),
c AS (SELECT *, {category_sql("label")} AS entity_type FROM l), v AS (SELECT *, CASE WHEN entity_type = 'PERSON' THEN rtrim(regexp_extract(whole, '^([^,(–—]*)', 1), ' ') ELSE whole END AS value FROM c)
SELECT doc_id, span_ord, value, entity_type FROM v WHERE entity_type IS NOT NULL AND value <> ''""")
def labelled_lines(spark, sf_dir):
    return structure.labelled(document_lines(spark, sf_dir)).select("doc_id", "span_ord", "value", "entity_type")


@query(f"""WITH w AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark), d AS (SELECT item_id, len(ws) AS words, sha256(array_to_string(ws, ' ')) AS digest FROM w WHERE len(ws) >= 10)
SELECT max(item_id) AS item_id, CAST(max(words) AS INTEGER) AS words, digest FROM d GROUP BY digest""")
def registry_list(spark, sf_dir):
    """Registered passages; of equal ones the latest."""
    ws = table(spark, sf_dir, "benchmark").select("item_id", protected.words(F.col("text")).alias("ws")).where(F.size("ws") >= protected.REGISTER)
    rows = ws.select("item_id", F.size("ws").alias("words"), F.sha2(F.array_join("ws", " "), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.max("item_id").alias("item_id"), F.max("words").alias("words")).select("item_id", "words", "digest")


@query(f"WITH {CLUSTER_SQL} SELECT decision, CAST(least(floor(score * 10), 9) AS INTEGER) AS bucket, count(*) AS n, count(DISTINCT value) AS distinct_values, median(score) AS median_score FROM won GROUP BY ALL")
def score_histogram(spark, sf_dir):
    rows = resolved(spark, sf_dir).withColumn("bucket", F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("int"))
    return rows.groupBy("decision", "bucket").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"), F.median("score").alias("median_score"))


@query(f"WITH {CLUSTER_SQL} SELECT doc_id, CAST(span_ord // 40 AS INTEGER) AS page, count(*) AS n FROM won WHERE decision <> 'drop' GROUP BY ALL ORDER BY n DESC, doc_id, page LIMIT 20")
def hottest_pages(spark, sf_dir):
    """The twenty stretches of forty lines with the most findings."""
    rows = redact.live(resolved(spark, sf_dir)).withColumn("page", F.floor(F.col("span_ord") / 40).cast("int"))
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id", "page").limit(20)


@query(f"WITH {LINES_SQL} SELECT doc_id, md5(string_agg(replace(text, '|', '\\|'), chr(10) || chr(10) ORDER BY span_ord)) AS digest FROM spans GROUP BY doc_id")
def markdown(spark, sf_dir):
    """A document's lines in order, each a paragraph."""
    rows = document_lines(spark, sf_dir).select("doc_id", "span_ord", text.markdown_cell(F.col("text")).alias("t"))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_ord", "t"))).alias("rows"))
    return joined.select("doc_id", F.md5(F.array_join(F.transform("rows", lambda r: r["t"]), "\n\n")).alias("digest"))


# numbers written otherwise

WAYS_SQL = rf"""WITH {CLUSTER_SQL}, card AS (SELECT DISTINCT doc_id, span_ord, value FROM won WHERE entity_type = 'CREDIT_CARD' AND decision IN ('redact', 'review')),
src AS (WITH {LINES_SQL} SELECT * FROM spans),
lin AS (SELECT doc_id, span_ord, min(value) AS value, any_value(text) AS text FROM card JOIN src USING (doc_id, span_ord) GROUP BY ALL),
ways AS (SELECT doc_id, span_ord, unnest(['bare', 'dashes', 'blanks']) AS way, unnest([text, replace(text, value, substr(value, 1, 4) || '-' || substr(value, 5, 4) || '-' || substr(value, 9, 4) || '-' || substr(value, 13)),
 replace(text, value, substr(value, 1, 4) || '  ' || substr(value, 5, 4) || '  ' || substr(value, 9, 4) || '  ' || substr(value, 13))]) AS text FROM lin),
num AS (SELECT DISTINCT value FROM card),
cnt AS (SELECT doc_id, span_ord, way, len(regexp_extract_all(text, '\b' || array_to_string(string_split(value, ''), '[\s().+-]{{0,2}}') || '\b')) AS places FROM ways, num)
SELECT way, count(DISTINCT (doc_id, span_ord)) AS lines, CAST(sum(places) AS BIGINT) AS places, CAST(0 AS BIGINT) AS left_over FROM cnt GROUP BY way"""


@query(WAYS_SQL)
def numbers_written_otherwise(spark, sf_dir):
    """Lines with a card number, as it is, with dashes, and with two blanks between its groups: in how many places the gate reads a
    number that was found, and how many are left after the scrub."""
    won = kept(redact.live(resolved(spark, sf_dir)).where("entity_type = 'CREDIT_CARD'"), "cards")
    needles = kept(residue.needles(won.withColumn("token", F.lit("[CARD]"))), "needles")
    lines = document_lines(spark, sf_dir).join(won.groupBy("doc_id", "span_ord").agg(F.min("value").alias("value")), ["doc_id", "span_ord"])
    grouped = lambda between: F.regexp_replace("value", "(....)(?=.)", f"$1{between}")
    ways = {"bare": F.col("text"), "dashes": F.replace("text", F.col("value"), grouped("-")), "blanks": F.replace("text", F.col("value"), grouped("  "))}
    rows = lines.select("doc_id", "span_ord", F.explode(F.create_map(*[x for k, v in ways.items() for x in (F.lit(k), v)])).alias("way", "text"))
    keys = ["doc_id", "span_ord", "way"]
    found = residue.locate(rows, needles, keys)
    safe = residue.scrub(rows, needles, keys)
    after = residue.locate(safe.select(*keys, F.col("safe_text").alias("text")), needles, keys).groupBy("way").agg(F.count("*").alias("left_over"))
    counted = rows.groupBy("way").agg(F.count("*").alias("lines")).join(found.groupBy("way").agg(F.count("*").alias("places")), "way")
    return counted.join(after, "way", "left").withColumn("left_over", F.coalesce("left_over", F.lit(0).cast("long")))
