"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import checks, text
from veilframe.operators import guard, protected, redact, report, residue, resolve, rules
from veilframe.sources import spans
from veilframe.sources.kept import kept
from veilframe.streaming import activity

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.lines(table(spark, sf_dir, "documents"), "doc_id")


# scans

LINES_SQL = """lines AS (SELECT doc_id, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 AS INTEGER) AS span_ord,
 unnest(string_split(text, chr(10))) AS text FROM documents), spans AS (SELECT * FROM lines WHERE trim(text, ' ') <> '')"""


@query(f"WITH {LINES_SQL} SELECT doc_id, count(*) AS spans, CAST(sum(length(text)) AS BIGINT) AS chars FROM spans GROUP BY doc_id")
def scan_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.char_length("text")).cast("long").alias("chars"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS text FROM documents)
SELECT doc_id, count(*) AS spans, CAST(max(length(text)) AS INTEGER) AS longest FROM p WHERE trim(text, ' ') <> '' GROUP BY doc_id""")
def scan_paragraphs(spark, sf_dir):
    return spans.paragraphs(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("spans"), F.max(F.char_length("text")).alias("longest"))


HTML_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])\s*/?>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM b)
SELECT page_id, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM c"""


@query(HTML_SQL)
def scan_html(spark, sf_dir):
    t = spans.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.char_length("t").alias("chars"), F.md5("t").alias("digest"))


@query(r"""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '(?:[^\n]+\n?)+')) AS INTEGER) AS blocks, CAST(length(text) AS INTEGER) AS chars FROM conversations""")
def scan_prompts(spark, sf_dir):
    blocks = F.regexp_extract_all("text", F.lit(r"(?:[^\n]+\n?)+"), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(blocks).alias("blocks"), F.char_length("text").alias("chars"))


# checks of values, over keys and numbers of the structured tables

NUMBERS_SQL = "SELECT o_orderkey AS id, lpad(CAST(o_orderkey * 7919 + 4000000000000000 AS VARCHAR), 16, '0') AS v FROM orders"


def numbers(spark, sf_dir):
    v = F.lpad((F.col("o_orderkey") * 7919 + 4000000000000000).cast("string"), 16, "0")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), v.alias("v"))


LUHN_SUM = "list_sum(list_transform(generate_series(1, 16), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(substr(v, CAST(i AS INTEGER), 1) AS INTEGER) * 2) % 10 + (CAST(substr(v, CAST(i AS INTEGER), 1) AS INTEGER) * 2) // 10 ELSE CAST(substr(v, CAST(i AS INTEGER), 1) AS INTEGER) END)) % 10 = 0"


@query(f"WITH n AS ({NUMBERS_SQL}) SELECT id, {LUHN_SUM} AS luhn, CASE WHEN len(list_distinct(string_split(v, ''))) = 1 THEN -0.5::DOUBLE WHEN {LUHN_SUM} THEN 0.35::DOUBLE ELSE 0.05::DOUBLE END AS delta FROM n")
def check_cards(spark, sf_dir):
    return numbers(spark, sf_dir).select("id", checks.luhn(F.col("v")).alias("luhn"), checks.card_delta(F.col("v")).alias("delta"))


@query("""WITH n AS (SELECT c_custkey AS id, lpad(CAST(c_custkey * 104729 % 1000000000 AS VARCHAR), 9, '0') AS v FROM customer)
SELECT id, CASE WHEN regexp_matches(v, '^(?:000|666)|^...00|0000$') THEN -0.3::DOUBLE WHEN v LIKE '9%' THEN -0.1::DOUBLE ELSE 0.1::DOUBLE END AS delta FROM n""")
def check_ssn(spark, sf_dir):
    v = F.lpad((F.col("c_custkey") * 104729 % 1000000000).cast("string"), 9, "0")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), checks.ssn_delta(v).alias("delta"))


@query("""WITH n AS (SELECT p_partkey AS id, p_partkey * 7919 % 100000000 AS k FROM part), v AS (SELECT id, 'GB' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || 'WEST' || lpad(CAST(k AS VARCHAR), 14, '0') AS x FROM n)
SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda c: CASE WHEN regexp_matches(c, '[0-9]') THEN CAST(c AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END)), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1 AS ok FROM v""")
def check_iban(spark, sf_dir):
    k = F.col("p_partkey") * 7919 % 100000000
    x = F.concat(F.lit("GB"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("WEST"), F.lpad(k.cast("string"), 14, "0"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), checks.iban_ok(x).alias("ok"))


def verhoeff_sql() -> str:
    times, powers = checks._dihedral()
    d = "[" + ", ".join(str(v) for row in times for v in row) + "]"
    p = "[" + ", ".join(str(v) for row in powers for v in row) + "]"
    return f"""WITH v AS (SELECT s_suppkey AS id, reverse(lpad(CAST(s_suppkey * 1299709 + 234100000000 AS VARCHAR), 12, '0')) AS x FROM supplier)
SELECT id, list_reduce(list_prepend(0, list_transform(generate_series(0, 11), lambda i: {p}[CAST((i % 8) * 10 + CAST(substr(x, CAST(i + 1 AS INTEGER), 1) AS INTEGER) + 1 AS INTEGER)])), lambda a, b: {d}[CAST(a * 10 + b + 1 AS INTEGER)]) = 0 AS ok FROM v"""


@query(verhoeff_sql())
def check_verhoeff(spark, sf_dir):
    x = F.lpad((F.col("s_suppkey") * 1299709 + 234100000000).cast("string"), 12, "0")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), checks.verhoeff(x).alias("ok"))


IP_SQL = "concat_ws('.', CAST(event_id % 256 AS VARCHAR), CAST(event_id * 7 % 260 AS VARCHAR), CAST(event_id * 13 % 256 AS VARCHAR), CAST(event_id * 31 % 256 AS VARCHAR))"


@query(f"""WITH v AS (SELECT event_id, {IP_SQL} AS x, list_transform(string_split({IP_SQL}, '.'), lambda c: CAST(c AS INTEGER)) AS p FROM events)
SELECT event_id, CASE WHEN len(list_filter(p, lambda c: c > 255)) > 0 THEN -0.6::DOUBLE WHEN p[1] IN (127, 0) OR p[1] BETWEEN 224 AND 239 THEN -0.3::DOUBLE WHEN length(x) <= 8 THEN -0.15::DOUBLE
 WHEN p[1] = 10 OR (p[1] = 172 AND p[2] BETWEEN 16 AND 31) OR (p[1] = 192 AND p[2] = 168) THEN 0.0::DOUBLE ELSE 0.1::DOUBLE END AS delta FROM v""")
def check_ipv4(spark, sf_dir):
    e = F.col("event_id")
    x = F.concat_ws(".", (e % 256).cast("string"), (e * 7 % 260).cast("string"), (e * 13 % 256).cast("string"), (e * 31 % 256).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", checks.ipv4_delta(x).alias("delta"))


# text functions

@query("""SELECT c_custkey, lower(regexp_replace(trim(c_name), '\\s+', ' ', 'g')) AS norm,
CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE concat(c_name[1], repeat('*', length(c_name) - 2), c_name[-1]) END AS masked FROM customer""")
def mask_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.normalise(F.lit("PERSON"), F.col("c_name")).alias("norm"), text.mask(F.col("c_name")).alias("masked"))


def hmac_sql(key: bytes) -> str:
    pad = lambda x: bytes(b ^ x for b in key.ljust(64, b"\0")).hex()
    return f"SELECT c_custkey, upper(substr(sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode('PERSON|' || lower(c_name))))), 1, 8)) AS token FROM customer"


@query(hmac_sql(b"demo-key"))
def keyed_tokens(spark, sf_dir):
    token = F.upper(F.left(text.hmac_sha256(b"demo-key", F.concat(F.lit("PERSON|"), F.lower("c_name"))), F.lit(8)))
    return table(spark, sf_dir, "customer").select("c_custkey", token.alias("token"))


# rules over document lines; these patterns mean the same to both engines

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CARD = r"\b\d{16}\b"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
SECRET = r"\btoken = \"[0-9a-f]{40}\""


def occurrences_sql(pattern: str) -> str:
    """Start offsets of matches, from the lengths of what lies between them."""
    return f"""WITH {LINES_SQL}, m AS (SELECT doc_id, span_ord, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM spans WHERE regexp_matches(text, '{pattern}')),
e AS (SELECT doc_id, span_ord, m, p, unnest(generate_series(1, len(m))) AS i FROM m)
SELECT doc_id, span_ord, m[i] AS value, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS start FROM e"""


def occurrences(spark, sf_dir, pattern: str) -> DataFrame:
    hit = document_lines(spark, sf_dir).where(F.col("text").rlike(pattern))
    return hit.select("doc_id", "span_ord", F.explode(text.matches(F.col("text"), pattern)).alias("m")).select("doc_id", "span_ord", F.col("m.text").alias("value"), F.col("m.start").alias("start"))


@query(occurrences_sql(EMAIL))
def find_emails(spark, sf_dir):
    return occurrences(spark, sf_dir, EMAIL)


@query(occurrences_sql(CARD))
def find_card_numbers(spark, sf_dir):
    return occurrences(spark, sf_dir, CARD)


@query(occurrences_sql(IPV4))
def find_ipv4(spark, sf_dir):
    return occurrences(spark, sf_dir, IPV4)


@query(occurrences_sql(SECRET))
def find_secrets(spark, sf_dir):
    return occurrences(spark, sf_dir, SECRET)


def simple(name: str, entity: str, pattern: str, score: float, check=None) -> rules.Rule:
    return rules.Rule(name, entity, pattern, score, check, context=tuple(rules.CONTEXT_WORDS.get(entity, ())))


#: Four rules whose patterns SQL engines without look-around have as well. The queries with an SQL twin run on these; each
#: has a sister (its name and _all) that runs on the whole catalogue.
SIMPLE = [simple("email", "EMAIL_ADDRESS", EMAIL, 0.92), simple("card", "CREDIT_CARD", CARD, 0.35, checks.card_delta), simple("ipv4", "IP_ADDRESS", IPV4, 0.55, checks.ipv4_delta), simple("secret", "CREDENTIAL", SECRET, 0.6)]


def simple_findings(spark, sf_dir) -> DataFrame:
    found = rules.scan(document_lines(spark, sf_dir), SIMPLE)
    return found.withColumn("decision", rules.route(F.col("score")))


def near_sql(words: list[str]) -> str:
    forms = "|".join(w.replace(".", "\\.") for w in [*words, *(w.replace(" ", "") for w in words if " " in w)])
    return f"regexp_matches(lower(substr(text, greatest(start - 44, 1), least(45, start)) || ' ' || substr(text, start + length(value) + 1, 20)), '(?:^|[^a-z])(?:{forms})(?:$|[^a-z])')"


def simple_sql() -> str:
    parts = []
    for r in SIMPLE:
        delta = {"card": f"CASE WHEN len(list_distinct(string_split(value, ''))) = 1 THEN -0.5 WHEN {LUHN_SUM.replace('substr(v,', 'substr(value,')} AND regexp_matches(value, '^(?:3[0-9]|4|5|6|2[2-7])') THEN 0.35 WHEN {LUHN_SUM.replace('substr(v,', 'substr(value,')} THEN 0.2 ELSE 0.05 END", "ipv4": "CASE WHEN CAST(string_split(value, '.')[1] AS INTEGER) IN (127, 0) OR CAST(string_split(value, '.')[1] AS INTEGER) BETWEEN 224 AND 239 THEN -0.3 WHEN length(value) <= 8 THEN -0.15 WHEN CAST(string_split(value, '.')[1] AS INTEGER) = 10 OR (CAST(string_split(value, '.')[1] AS INTEGER) = 172 AND CAST(string_split(value, '.')[2] AS INTEGER) BETWEEN 16 AND 31) OR (CAST(string_split(value, '.')[1] AS INTEGER) = 192 AND CAST(string_split(value, '.')[2] AS INTEGER) = 168) THEN 0.0 ELSE 0.1 END"}.get(r.name, "0.0")
        words = rules.CONTEXT_WORDS.get(r.entity, [])
        boost = f"CASE WHEN {near_sql(words)} THEN 0.35 ELSE 0.0 END" if words else "0.0"
        parts.append(f"SELECT doc_id, span_ord, start, CAST(start + length(value) AS INTEGER) AS \"end\", value, '{r.entity}' AS entity_type, '{r.name}' AS recognizer, round(greatest(0.0, least(1.0, CAST({r.score} AS DOUBLE) + CAST({delta} AS DOUBLE) + CAST({boost} AS DOUBLE))), 3) AS score FROM ({occurrences_sql(r.pattern)}) JOIN (WITH {LINES_SQL} SELECT * FROM spans) USING (doc_id, span_ord)")
    return " UNION ALL ".join(parts)


FOUND_SQL = f"found AS ({simple_sql()}), routed AS (SELECT *, CASE WHEN score >= 0.6 THEN 'redact' WHEN score >= 0.35 THEN 'review' ELSE 'drop' END AS decision FROM found)"


@query(f"WITH {FOUND_SQL} SELECT * FROM routed")
def findings(spark, sf_dir):
    return simple_findings(spark, sf_dir)


CLUSTER_SQL = f"""{FOUND_SQL}, o AS (SELECT *, max("end") OVER (PARTITION BY doc_id, span_ord ORDER BY start, "end" DESC, recognizer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, span_ord ORDER BY start, "end" DESC, recognizer ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM o),
ranked AS (SELECT *, CASE entity_type WHEN 'CREDENTIAL' THEN 10 WHEN 'IP_ADDRESS' THEN 8 ELSE 9 END AS priority FROM c),
r AS (SELECT *, row_number() OVER w AS n, first_value({{'s': start, 'e': "end", 't': entity_type, 'p': priority}}) OVER w AS f FROM ranked
 WINDOW w AS (PARTITION BY doc_id, span_ord, cluster ORDER BY CASE WHEN score >= 0.35 THEN priority ELSE 0 END DESC, score DESC, "end" - start DESC, start, recognizer)),
won AS (SELECT doc_id, span_ord, start, "end", value, entity_type, recognizer, score, CASE WHEN score >= 0.6 THEN 'redact' WHEN score >= 0.35 THEN 'review' ELSE 'drop' END AS decision FROM r
 WHERE n = 1 OR (NOT (start >= f.s AND "end" <= f.e) AND (entity_type = f.t OR start >= f.e OR "end" <= f.s OR priority > f.p)))"""


@query(f"WITH {CLUSTER_SQL} SELECT * FROM won")
def resolved(spark, sf_dir):
    return resolve.resolve(simple_findings(spark, sf_dir).drop("decision"), ["doc_id", "span_ord"]).drop("widened")


# tokens and redaction

SHORT_SQL = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' WHEN 'CREDIT_CARD' THEN 'CARD' WHEN 'IP_ADDRESS' THEN 'IP' ELSE 'SECRET' END"
NORM_SQL = "CASE entity_type WHEN 'EMAIL_ADDRESS' THEN lower(value) WHEN 'CREDIT_CARD' THEN value ELSE upper(value) END"
VAULT_SQL = f"""{CLUSTER_SQL}, live AS (SELECT *, {NORM_SQL} AS norm_value FROM won WHERE decision IN ('redact', 'review')),
f AS (SELECT entity_type, norm_value, min({{'d': doc_id, 's': span_ord, 'p': start}}) AS first, count(*) AS occurrences FROM live GROUP BY ALL),
vault AS (SELECT entity_type, norm_value, '[' || {SHORT_SQL} || '_U' || lpad(CAST(row_number() OVER (PARTITION BY entity_type ORDER BY first, norm_value) AS VARCHAR), 3, '0') || ']' AS token, occurrences FROM f)"""


@query(f"WITH {VAULT_SQL} SELECT * FROM vault")
def vault(spark, sf_dir):
    return redact.numbered_vault(resolved(spark, sf_dir), ["doc_id", "span_ord", "start"]).drop("forms")


def redacted_spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    won = resolved(spark, sf_dir)
    tokens = redact.numbered_vault(won, ["doc_id", "span_ord", "start"]).select("entity_type", "norm_value", "token")
    own = won.withColumn("norm_value", text.normalise(F.col("entity_type"), F.col("value"))).join(tokens, ["entity_type", "norm_value"])
    own = own.withColumn("replacement", redact.replacement(F.col("entity_type"), F.col("value"), F.col("token"), "pci"))
    return redact.splice(document_lines(spark, sf_dir), own, ["doc_id", "span_ord"]), own


@query(f"""WITH {VAULT_SQL}, rep AS (SELECT l.*, CASE entity_type WHEN 'CREDENTIAL' THEN '[SECRET]' WHEN 'CREDIT_CARD' THEN '[CARD_****' || right(value, 4) || ']' ELSE token END AS put FROM live l JOIN vault USING (entity_type, norm_value)),
e AS (SELECT doc_id, span_ord, list({{'s': start, 'e': "end", 'b': put}} ORDER BY start) AS e FROM rep GROUP BY ALL),
s AS (WITH {LINES_SQL} SELECT * FROM spans),
t AS (SELECT s.doc_id, s.span_ord, CASE WHEN e IS NULL THEN text ELSE list_aggregate(list_transform(generate_series(1, len(e)), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE e[i-1].e + 1 END, e[i].s - CASE WHEN i = 1 THEN 0 ELSE e[i-1].e END) || e[i].b), 'string_agg', '') || substr(text, e[-1].e + 1) END AS safe FROM s LEFT JOIN e USING (doc_id, span_ord))
SELECT doc_id, span_ord, md5(safe) AS digest, CAST(length(safe) AS INTEGER) AS chars FROM t""")
def redacted(spark, sf_dir):
    safe, _ = redacted_spans(spark, sf_dir)
    return safe.select("doc_id", "span_ord", F.md5("safe_text").alias("digest"), F.char_length("safe_text").alias("chars"))


@query(f"""WITH {VAULT_SQL}, v AS (SELECT DISTINCT entity_type, lower(value) AS form FROM live WHERE entity_type <> 'CREDENTIAL' OR length(value) >= 4), s AS (WITH {LINES_SQL} SELECT * FROM spans),
t AS (SELECT doc_id, span_ord, unnest(regexp_extract_all(lower(text), '[^ \t]+')) AS word FROM s),
n AS (SELECT doc_id, span_ord, entity_type, form FROM (SELECT DISTINCT doc_id, span_ord, word FROM t) JOIN v ON word = form)
SELECT entity_type, count(*) AS places FROM n GROUP BY entity_type""")
def known_values(spark, sf_dir):
    """In how many lines a found value stands as a word of its own, also where no rule found it: before redaction."""
    won = resolved(spark, sf_dir)
    forms = redact.live(won).select("entity_type", F.lower("value").alias("form")).distinct()
    words = document_lines(spark, sf_dir).select("doc_id", "span_ord", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t]+"), F.lit(0)))).alias("form"))
    return words.join(forms, "form").groupBy("entity_type").agg(F.count("*").alias("places"))


# the same on the whole catalogue

KEYS = ["doc_id", "span_ord"]


@query()
def findings_all_rules(spark, sf_dir):
    """Raw findings of all 44 rules, in one pass over the lines."""
    return rules.scan(document_lines(spark, sf_dir))


def resolved_rows(spark, sf_dir) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return resolve.rewritten(resolve.resolve(rules.scan(lines), KEYS), lines, KEYS)


@query()
def resolved_all(spark, sf_dir):
    return resolved_rows(spark, sf_dir)


@query()
def vault_all(spark, sf_dir):
    return redact.numbered_vault(resolved_rows(spark, sf_dir), [*KEYS, "start"]).drop("forms")


def safe_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with safe_text, the findings with their tokens, the needles."""
    lines = document_lines(spark, sf_dir)
    # used several times below: written once, rather than scanned for again
    won = kept(resolved_rows(spark, sf_dir), "resolved")
    tokens = redact.numbered_vault(won, [*KEYS, "start"]).select("entity_type", "norm_value", "token")
    own = kept(redact.live(won).withColumn("norm_value", text.normalise(F.col("entity_type"), F.col("value"))).join(tokens, ["entity_type", "norm_value"]), "own")
    needles = kept(residue.needles(own), "needles")
    missed = residue.locate(lines, needles, KEYS)
    own = own.select(*KEYS, "start", "end", F.col("token").alias("replacement"), "decision")
    more = residue.uncovered(missed, own, KEYS).select(*KEYS, "start", "end", F.col("token").alias("replacement"), F.lit("redact").alias("decision"))
    every = own.unionByName(more)
    return redact.splice(lines, every, KEYS), every, needles


@query()
def redacted_all(spark, sf_dir):
    """Every line with its values and all their other mentions replaced by tokens."""
    safe, _, _ = safe_rows(spark, sf_dir)
    return safe.select(*KEYS, F.md5("safe_text").alias("digest"), F.char_length("safe_text").alias("chars"))


@query()
def gate_residual(spark, sf_dir):
    """Known values that can still be read anywhere in the redacted lines: none, or the output must not be released."""
    safe, _, needles = safe_rows(spark, sf_dir)
    left = residue.locate(safe.select(*KEYS, F.col("safe_text").alias("text")), needles, KEYS)
    return left.agg(F.count("*").alias("leaks"))


@query()
def exposure_all(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("words"))
    return report.exposure(resolved_rows(spark, sf_dir), sizes, "doc_id")




# registered passages

WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
REGISTRY_SQL = f"""WITH b AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark), d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
bs AS (SELECT DISTINCT item_id, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM b WHERE len(ws) >= 10)),
ds AS (SELECT doc_id, i - 1 AS pos, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
c AS (SELECT DISTINCT doc_id, item_id, pos + k AS pos FROM ds JOIN bs USING (s), (SELECT unnest(generate_series(0, 4)) AS k)),
g AS (SELECT doc_id, item_id, pos - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY pos) AS g FROM c),
r AS (SELECT doc_id, item_id, count(*) AS n FROM g GROUP BY doc_id, item_id, g)
SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS words_covered, max(n) AS longest_run FROM r GROUP BY doc_id, item_id HAVING max(n) >= 10 OR sum(n) >= 30"""


@query(REGISTRY_SQL)
def registry_match(spark, sf_dir):
    prints = protected.register(table(spark, sf_dir, "benchmark"), "item_id")
    return protected.match(table(spark, sf_dir, "documents"), "doc_id", prints, "item_id")


@query(f"""WITH b AS (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark WHERE len({WORDS_SQL}) >= 10)
SELECT item_id, count(DISTINCT s) AS prints FROM (SELECT item_id, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS s FROM (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM b)) GROUP BY item_id""")
def registry_prints(spark, sf_dir):
    return protected.register(table(spark, sf_dir, "benchmark"), "item_id").groupBy("item_id").agg(F.count("*").alias("prints"))


# vocabulary

@query(r"""SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}]+')) AS w FROM documents) WHERE w = lower(w) AND length(w) >= 3 GROUP BY w HAVING count(*) >= 2""")
def corpus_vocabulary(spark, sf_dir):
    """Ordinary words of the corpus: three letters or more, in lower case, at least twice."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
    return w.where((F.col("w") == F.lower("w")) & (F.char_length("w") >= 3)).groupBy("w").agg(F.count("*").alias("n")).where("n >= 2")


# reports

@query(f"WITH {CLUSTER_SQL} SELECT entity_type, decision, count(*) AS n, round(max(score), 3) AS max_score FROM won GROUP BY ALL")
def summary(spark, sf_dir):
    return report.summary(resolved(spark, sf_dir))


@query(f"WITH {CLUSTER_SQL} SELECT entity_type, count(*) FILTER (decision = 'redact') AS redact, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'drop') AS \"drop\" FROM won GROUP BY entity_type")
def category_pivot(spark, sf_dir):
    return report.pivot(resolved(spark, sf_dir), "decision", ["redact", "review", "drop"])


WEIGHT_SQL = "CASE entity_type WHEN 'CREDENTIAL' THEN 10 WHEN 'CREDIT_CARD' THEN 9 WHEN 'EMAIL_ADDRESS' THEN 4 ELSE 3 END"
EXPOSURE_SQL = f"""WITH {VAULT_SQL}, v AS (SELECT DISTINCT doc_id, entity_type, norm_value, {WEIGHT_SQL} AS w FROM live),
g AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS score, count(*) AS distinct_values, max(w) AS max_weight FROM v GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS INTEGER) AS words FROM documents),
x AS (SELECT *, round(score * 1000.0::DOUBLE / greatest(words, 1), 3) AS density FROM s JOIN g USING (doc_id))
SELECT *, CASE WHEN max_weight >= 9 THEN 'critical' WHEN density >= 25 THEN 'high' WHEN density >= 5 THEN 'medium' ELSE 'low' END AS rating FROM x"""


@query(EXPOSURE_SQL)
def exposure(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\r\n]+"), F.lit(0))).alias("words"))
    return report.exposure(resolved(spark, sf_dir), sizes, "doc_id")


@query(f"WITH {VAULT_SQL}, v AS (SELECT DISTINCT doc_id, entity_type, norm_value FROM live) SELECT doc_id, round(count(*) * ((3.0::DOUBLE / 104) / (1 - 3.0::DOUBLE / 104)), 6) AS expected_missed, count(*) AS distinct_values FROM v GROUP BY doc_id")
def residual(spark, sf_dir):
    return report.residual(resolved(spark, sf_dir), "doc_id")


@query(f"""WITH {CLUSTER_SQL}, q AS (SELECT *, {NORM_SQL} AS value_key FROM won WHERE decision = 'review')
SELECT entity_type, value_key, count(*) AS occurrences, count(DISTINCT doc_id) AS files, max(score) AS max_score, concat(value_key[1], repeat('*', length(value_key) - 2), value_key[-1]) AS masked FROM q GROUP BY entity_type, value_key""")
def review_queue(spark, sf_dir):
    return report.review_queue(resolved(spark, sf_dir), "doc_id")


@query(f"""WITH {VAULT_SQL}, p AS (SELECT DISTINCT doc_id FROM live), b AS (SELECT l.doc_id, CAST(quality = 0 AS INTEGER) AS label, CASE WHEN p.doc_id IS NULL THEN 0 ELSE 1 END AS guess FROM labels l LEFT JOIN p USING (doc_id)),
counted AS (SELECT count(*) FILTER (label = 1 AND guess = 1) AS tp, count(*) FILTER (label = 0 AND guess = 1) AS fp, count(*) FILTER (label = 1 AND guess = 0) AS fn, count(*) FILTER (label = 0 AND guess = 0) AS tn FROM b)
SELECT *, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM counted""")
def evaluation(spark, sf_dir):
    """How well findings tell documents of low quality: the scorer, on the labels at hand."""
    found = redact.live(resolved(spark, sf_dir)).select("doc_id").distinct().withColumn("hit", F.lit(1))
    gold = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("label"))
    return report.evaluate(gold, gold.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(0)).alias("guess")), "doc_id")


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY GROUPING SETS ((user_id), (CAST(ts AS DATE)), (event_type), (CAST(ts AS DATE), event_type), ())""")
def guard_activity(spark, sf_dir):
    return report.activity(table(spark, sf_dir, "events"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_activity(spark, sf_dir):
    return activity.daily(table(spark, sf_dir, "events"))


# prompts

def code_sql() -> str:
    quoted = lambda rx: rx.replace("'", "''")
    points = " + ".join(f"CASE WHEN regexp_matches(s, '{quoted(rx)}') THEN {p} ELSE 0 END" for p, rx in guard.CODE_SIGNS)
    return f"""WITH l AS (SELECT conv_id, turn, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM conversations WHERE text IS NOT NULL),
t AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s, regexp_matches(text, '^\\s*(?:```|~~~)') AS fence FROM l),
p AS (SELECT *, s = '' AS blank, CASE WHEN s = '' THEN 0 ELSE {points} END AS points, sum(CAST(fence AS INTEGER)) OVER w AS fences FROM t WINDOW w AS (PARTITION BY conv_id, turn ORDER BY line)),
g AS (SELECT *, points >= 2 OR (NOT fence AND NOT blank AND fences % 2 = 1) AS strong, NOT blank AND (points >= 1 OR regexp_matches(text, '^[ \\t]')) AS weak FROM p),
r AS (SELECT *, strong OR weak AS part, line - sum(CAST(strong OR weak AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY line) AS run FROM g),
c AS (SELECT *, part AND bool_or(strong) OVER (PARTITION BY conv_id, turn, run, part) AS code, lag(blank) OVER (PARTITION BY conv_id, turn ORDER BY line) AS blank_before FROM r),
o AS (SELECT *, line - lag(line) OVER (PARTITION BY conv_id, turn ORDER BY line) AS gap FROM c WHERE code),
b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 OR (gap = 2 AND NOT blank_before) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY line) AS block FROM o),
k AS (SELECT conv_id, turn, block, count(*) AS n FROM b GROUP BY ALL), x AS (SELECT conv_id, turn, count(*) AS blocks, max(n) AS longest, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY ALL),
z AS (SELECT conv_id, turn, count(*) FILTER (NOT blank) AS lines, bool_or(fence) AS fenced FROM c GROUP BY ALL),
f AS (SELECT conv_id, turn, lines, coalesce(n, 0) AS n, coalesce(blocks, 0) AS blocks, (fenced AND coalesce(n, 0) > 0) OR coalesce(longest, 0) >= 3 OR (coalesce(n, 0) >= 2 AND n >= 0.6 * lines) AS detected FROM z LEFT JOIN x USING (conv_id, turn))
SELECT conv_id, turn, detected, lines, CASE WHEN detected THEN n ELSE 0 END AS code_lines, CASE WHEN detected THEN round(n / lines, 3) ELSE 0.0 END AS share, CAST(CASE WHEN detected THEN blocks ELSE 0 END AS INTEGER) AS n_blocks FROM f"""


@query(code_sql())
def prompt_code(spark, sf_dir):
    """Code in prompts: lines by their signs, fences, weak lines beside code, blocks."""
    found = guard.code(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return found.select("conv_id", "turn", "detected", "lines", F.col("code_lines").cast("long").alias("code_lines"), "share", F.size("blocks").alias("n_blocks"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents), m AS (SELECT doc_id, regexp_extract(text, '(?i)(?:^|[^\w])(licensed[\s_-]+under|all[\s_-]+rights[\s_-]+reserved|permission[\s_-]+is[\s_-]+hereby)(?:$|[^\w])', 1) AS marking FROM l)
SELECT doc_id, count(*) AS marked_lines FROM m WHERE marking <> '' GROUP BY doc_id""")
def licence_markings(spark, sf_dir):
    lines = guard.markings(document_lines(spark, sf_dir), ["licensed under", "all rights reserved", "permission is hereby"])
    return lines.groupBy("doc_id").agg(F.count("*").alias("marked_lines"))


@query()
def prompt_markings(spark, sf_dir):
    """Lines of prompts with a classification marking, and why it counts."""
    lines = guard.as_lines(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return guard.markings(lines).select("conv_id", "turn", "line", "marking", "why")


@query()
def prompt_verdicts(spark, sf_dir):
    """Every turn under the guard's policy: code, markings, text of the benchmark, values; its safe text by its digest."""
    prints = protected.register(table(spark, sf_dir, "benchmark"), "item_id")
    judged = guard.check(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], guard.Policy(), prints=prints)
    return judged.select("conv_id", "turn", "bytes", "verdict", "blocked_by", "warned", "code_lines", "protected_words", "n_values", "findings", F.md5("safe_text").alias("safe_digest"))


@query()
def guard_by_rule(spark, sf_dir):
    return report.by_rule(prompt_verdicts(spark, sf_dir))


@query()
def registry_overlaps(spark, sf_dir):
    """Documents that hold text of the benchmark: words, longest run, share, ranges of lines."""
    prints = protected.register(table(spark, sf_dir, "benchmark"), "item_id")
    return protected.overlaps(table(spark, sf_dir, "documents"), "doc_id", prints, "item_id")


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS value FROM conversations), f AS (SELECT conv_id, lower(value) AS norm, min(turn) AS first, count(*) AS uses FROM w GROUP BY ALL)
SELECT conv_id, norm, uses, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY first, norm) AS INTEGER) AS number FROM f""")
def conversation_names(spark, sf_dir):
    """Numbers that capitalised words keep through a conversation."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{5,}"), F.lit(0))).alias("value"))
    rows = w.select("conv_id", "turn", F.lit(0).alias("start"), F.lit("PERSON").alias("entity_type"), "value")
    return guard.conversation_tokens(rows, "conv_id", "turn").select("conv_id", "norm", "uses", "number")
