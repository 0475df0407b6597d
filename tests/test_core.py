"""Values with known answers, and every query that has a SQL twin against it on a small scale."""

import hashlib
import hmac
import os

import pytest
from pyspark.sql import functions as F

from veilframe.functions import checks, text
from veilframe.operators import audit, guard, protected, redact, residue, resolve, rules
from veilframe.plans import values  # noqa: F401 (registers its queries)
from veilframe.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("check", "given", "expected"),
    [
        (checks.luhn, "4111 1111 1111 1111", True),
        (checks.luhn, "4111 1111 1111 1112", False),
        (checks.card_delta, "4111 1111 1111 1111", 0.35),
        (checks.card_delta, "1111111111111111", -0.5),
        (checks.ssn_delta, "900-12-3456", -0.1),
        (checks.ssn_delta, "000-12-3456", -0.3),
        (checks.pan_delta, "ABCPM1234F", 0.2),
        (checks.pan_delta, "ABCZM1234F", -0.25),
        (checks.pesel_delta, "44051401359", 0.3),
        (checks.pesel_delta, "890412xxxxx", 0.1),
        (checks.pesel_delta, "891332xxxxx", -0.4),
        (checks.iban_delta, "GB82 WEST 1234 5698 7654 32", 0.35),
        (checks.iban_delta, "GB82 WEST 1234 5698 7654 33", -0.3),
        (checks.aadhaar_delta, "234123412346", 0.3),
        (checks.gstin_delta, "27AAPFU0939F1ZV", 0.3),
        (checks.phone_delta, "12-04-1985", -0.4),
        (checks.phone_delta, "+44 20 7946 0018", 0.25),
        (checks.ipv4_delta, "10.24.8.17", 0.0),
        (checks.ipv4_delta, "203.0.113.42", 0.1),
        (checks.mailbox_delta, "tprm-office@example.org", -0.45),
        (checks.mailbox_delta, "kofi.mensah@example.org", 0.0),
        (text.mask, "Priya", "P***a"),
        (text.mask, "abcd", "****"),
        (text.ocr_denoise, "W1ls0n", "Wllson"),
        (text.token_case, "RAMAN", "upper"),
    ],
)
def test_values(spark, check, given, expected):
    assert value(spark, check(F.lit(given))) == expected


def test_hmac(spark):
    assert value(spark, text.hmac_sha256(b"k1", F.lit("émile"))) == hmac.new(b"k1", "émile".encode(), hashlib.sha256).hexdigest()


def test_offsets_slice_back(spark):
    t = "😀 Łukasz wrote to ana@example.org and bo@example.com"
    for m in value(spark, text.matches(F.lit(t), next(r for r in rules.RULES if r.name == "email").pattern)):
        assert t[m.start : m.end] == m.text


def test_scan_resolve_redact_and_gate(spark):
    rows = [(1, 0, "Passport No: K4829175, card 4111 1111 1111 1111"), (1, 1, "write to kofi.mensah@example.org"), (2, 0, "Ref K4829175 closed"), (3, 0, "nothing here"), (4, 0, "")]
    spans = spark.createDataFrame(rows, "doc_id long, span_ord int, text string")
    won = resolve.resolve(rules.scan(spans), ["doc_id", "span_ord"]).cache()
    by = {(r.doc_id, r.recognizer): r for r in won.collect()}
    assert by[1, "passport"].score >= 0.5 and by[2, "passport"].decision == "drop" and by[1, "credit_card"].decision == "redact"
    vault = redact.numbered_vault(won, ["doc_id", "span_ord", "start"])
    own = won.withColumn("norm_value", text.normalise(F.col("entity_type"), F.col("value"))).join(vault.select("entity_type", "norm_value", "token"), ["entity_type", "norm_value"])
    own = own.withColumn("replacement", redact.replacement(F.col("entity_type"), F.col("value"), F.col("token"), "pci"))
    safe = redact.splice(spans, own, ["doc_id", "span_ord"])
    texts = {(r.doc_id, r.span_ord): r.safe_text for r in safe.collect()}
    assert texts[1, 0].endswith("card [CARD_****1111]") and texts[1, 1] == "write to [EMAIL_U001]" and texts[3, 0] == "nothing here"
    # the number stands in another document as well, where no rule took it: the gate sees it, and it is scrubbed
    assert [r.doc_id for r in residue.gate(safe, own, ["doc_id", "span_ord"]).collect()] == [2]
    clean = residue.scrub(safe.select("doc_id", "span_ord", F.col("safe_text").alias("text")), residue.needles(own), ["doc_id", "span_ord"])
    assert residue.gate(clean, own, ["doc_id", "span_ord"]).count() == 0


def test_registered_text(spark):
    item = " ".join(f"word{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "too short to register")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {' '.join(item.split()[:12])} after"), (2, "word0 word1 word2"), (3, None)], "doc_id long, text string")
    prints = protected.register(items, "item_id")
    assert prints.count() == 16
    assert [tuple(r) for r in protected.match(docs, "doc_id", prints, "item_id").collect()] == [(1, 1, 12, 12)]


def test_audit_chain(spark):
    log = audit.append([{"event": "a"}, {"event": "b"}, {"event": "c"}], "run")
    good = spark.createDataFrame(log)
    assert audit.verify(good).count() == 0
    log[1]["body"] = "{}"
    assert [r.problem for r in audit.verify(spark.createDataFrame(log)).collect()] == ["changed"]
    assert [r.problem for r in audit.verify(good.where("seq <> 2")).collect()] == ["broken link"]


def test_stream_equals_batch(spark, tmp_path):
    from veilframe.streaming import activity

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    q = activity.daily(stream).writeStream.outputMode("complete").format("memory").queryName("daily_out").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily_out").collect())) == sorted(map(tuple, activity.daily(events).collect()))


def rows(frame):
    def plain(v):
        return "null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    names = sorted(frame[0])
    return sorted(tuple(plain(v) for v in (r[frame[0].index(n)] for n in names)) for r in frame[1])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    assert rows((got.columns, [tuple(r) for r in got.collect()])) == rows(([d[0] for d in found.description], found.fetchall()))


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "item_id", "words_covered", "longest_run"]
    assert os.path.exists(SF)
