"""Known values in texts: every form, leftmost and longest, by the automaton and by the join, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import residue

KEYS = ["doc_id"]
FOUND = "entity_type string, value string, token string, decision string"


def plain(text, forms):
    """Every stretch that reads as a form, then the leftmost, longest ones."""
    word = lambda c: bool(re.fullmatch(r"[^\W_]", c))
    hits = []
    for a in range(len(text)):
        for b in range(a + 1, min(len(text), a + 40) + 1):
            piece = text[a:b]
            edge = not (a and word(text[a - 1])) and not (b < len(text) and word(text[b]))
            for form, token, cased, number in forms:
                if number:
                    ok = piece[0].isdigit() and piece[-1].isdigit() and re.sub(r"[\s().+-]", "", piece) == form and not re.search(r"[\s().+-]{3}", piece) and not (a and text[a - 1].isdigit()) and not (b < len(text) and text[b].isdigit())
                else:
                    ok = edge and not piece[0].isspace() and not piece[-1].isspace() and re.sub(r"\s+", " ", piece.lower()) == form and (cased is None or re.sub(r"\s+", " ", piece) in cased)
                if ok:
                    hits.append((a, -b, token))
    out, at = set(), 0
    for a, b, token in sorted(hits):
        if a >= at:
            out.add((a, -b, token))
            at = -b
    return out


def table(spark, rows):
    return residue.needles(spark.createDataFrame(rows, FOUND))


VALUES = [
    ("CREDIT_CARD", "4111 1111 1111 1111", "[CARD_U001]", "redact"), ("PERSON", "Ana Lopez", "[PERSON_001]", "redact"), ("PERSON", "Ana Lopez Diaz", "[PERSON_002]", "redact"), ("PERSON", "Page", "[PERSON_003]", "redact"),
    ("PERSON", "Cloud", "[PERSON_004]", "review"), ("EMAIL_ADDRESS", "a&b@x.org", "[EMAIL_U001]", "review"), ("PHONE_NUMBER", "12345", "[PHONE_U001]", "redact"), ("PHONE_NUMBER", "+48 600 700 800", "[PHONE_U002]", "redact"),
    ("ADDRESS", "O'Neil & Söhne", "[ADDR_U001]", "redact"), ("ID", "ab-12", "[ID_U001]", "redact"), ("ID", "x", "[ID_U002]", "redact"), ("ID", "dropped value", "[ID_U003]", "drop"),
]


@pytest.mark.parametrize("held", [residue.HELD, 0])
def test_places_equal_brute_force(spark, held):
    rng = random.Random(7)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111  1111--1111 1111", "41111111111111112", "ana", "Ana", "lopez", "LOPEZ", "Diaz", "page", "Page", "PAGE", "Cloud", "a&b@x.org", "48600700800", "(48) 600.700-800", "12345", "ab-12", "AB-12x", "O'Neil", "&", "SÖHNE", " ", "  ", " ", "\t", ",", "x", "_", "9"]
    texts = ["".join(rng.choice([*bits, " ", " "]) for _ in range(rng.randint(1, 14))) for _ in range(150)] + ["", "Ana  Lopez", "Ana Lopez Diaz."]
    needles = table(spark, VALUES)
    forms = [(r.form, r.token, r.cased, r.number) for r in needles.collect()]
    spans = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").repartition(4)
    got = {i: set() for i in range(-1, len(texts))}
    for r in residue.locate(spans, needles, KEYS, through=False, held=held).collect():
        got[r.doc_id].add((r.start, r.end, r.token))
    for i, t in enumerate(texts):
        assert got[i] == plain(t, forms), t
    assert not got[-1] and sum(map(len, got.values())) > 100


@pytest.mark.parametrize("held", [residue.HELD, 0])
def test_texts_are_read_as_they_are_seen(spark, held):
    texts = ["<b>Ana</b> Lopez", "Ana Lo<i>pez</i>!", "mail a&amp;b@x.org now", "a%26b%40x.org", "x=O&#x27;Neil%20%26%20S%C3%B6hne&y", "<td>4111</td><td>1111</td> 1111-1111", "O&apos;Neil &amp; S&ouml;hne", "a<b and nothing", "&lt;b&gt;Ana&nbsp;Lopez"]
    spans = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in residue.locate(spans, table(spark, VALUES), KEYS, held=held).collect():
        found.setdefault(r.doc_id, []).append(texts[r.doc_id][r.start : r.end])
    assert found == {0: ["Ana</b> Lopez"], 1: ["Ana Lo<i>pez"], 2: ["a&amp;b@x.org"], 3: ["a%26b%40x.org"], 4: ["O&#x27;Neil%20%26%20S%C3%B6hne"], 5: ["4111</td><td>1111</td> 1111-1111"], 6: ["O&apos;Neil &amp; S&ouml;hne"], 8: ["Ana&nbsp;Lopez"]}


def test_scrubbed_texts_pass_the_gate(spark):
    lines = spark.createDataFrame([(1, "card 4111-1111-1111-1111 of Ana  LOPEZ"), (2, "4111111111111111"), (3, "clean")], "doc_id long, text string")
    own = spark.createDataFrame(VALUES, FOUND)
    assert residue.gate(lines.withColumn("safe_text", F.col("text")), own, KEYS).count() == 3
    safe = residue.scrub(lines, residue.needles(own), KEYS)
    assert [r.safe_text for r in safe.orderBy("doc_id").collect()] == ["card [CARD_U001] of [PERSON_001]", "[CARD_U001]", "clean"]
    assert residue.gate(safe, own, KEYS).count() == 0
    assert residue.locate(lines, residue.needles(own.where("false")), KEYS).count() == 0


def test_reasons_show_no_value(spark):
    reasons = spark.createDataFrame([(1, "matches confirmed person 'Priya Raman'"), (2, "trimmed 'PRIYA raman x' to 'Priya'"), (3, "field label 'Full name:'"), (4, None)], "doc_id long, text string")
    values = spark.createDataFrame([("Priya Raman",), ("ab",), (None,)], "value string")
    got = {r.doc_id: r.safe_text for r in residue.mask_reasons(reasons, values, KEYS).collect()}
    assert got == {1: "matches confirmed person 'P*********n'", 2: "trimmed 'P*********n x' to 'P***a'", 3: "field label 'Full name:'", 4: None}
