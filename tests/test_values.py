"""Review decisions, added terms, rehydration, labels, transcripts and cells on small cases."""

from pyspark.sql import functions as F

from veilframe.operators import rehydrate, review, structure
from veilframe.sources import cues

FINDING = "doc long, start int, value string, entity_type string, decision string"


def test_decisions_hold_for_every_occurrence_of_a_value(spark):
    found = spark.createDataFrame([(1, 0, "A@x.org", "EMAIL_ADDRESS", "review"), (2, 5, "a@x.org", "EMAIL_ADDRESS", "redact"), (3, 0, "b@x.org", "EMAIL_ADDRESS", "drop"), (4, 0, None, "EMAIL_ADDRESS", "review")], FINDING)
    told = spark.createDataFrame([("EMAIL_ADDRESS", "a@x.org", "reject"), ("EMAIL_ADDRESS", "b@x.org", "approve")], "entity_type string, value_key string, verdict string")
    assert {r["doc"]: r["decision"] for r in review.decide(found, told).collect()} == {1: "drop", 2: "drop", 3: "drop", 4: "review"}


def test_terms_longest_first_in_any_case(spark):
    rows = spark.createDataFrame([(1, "see PROJECT  falcon plan, project"), (2, None), (3, "")], "doc long, text string")
    got = review.add(rows, ["project falcon plan", "Project Falcon", "ab"]).collect()
    assert [(r["doc"], r["start"], r["value"]) for r in got] == [(1, 4, "PROJECT  falcon plan")]


def test_damaged_tokens_are_repaired(spark):
    for damaged in ("[person_001]", "(PERSON-001)", "[ Person 001 ]", "{PERSON_001}", "<person 001>"):
        assert spark.createDataFrame([(f"hi {damaged}!",)], "t string").select(rehydrate.repair(F.col("t"))).first()[0] == "hi [PERSON_001]!"


def test_rehydration_leaves_unknown_and_ambiguous_tokens(spark):
    vault = spark.createDataFrame([("PERSON", "[PERSON_001]", ["Ann", "Ann Lee"]), ("CREDIT_CARD", "[CARD_U001]", ["4111 1111", "41111111"]), ("EMAIL_ADDRESS", "[EMAIL_U001]", ["a@x.org"])], "entity_type string, token string, forms array<string>")
    texts = spark.createDataFrame([(1, "é [PERSON_001] [CARD_U001] [EMAIL_U001] [SSN_U009]"), (2, None), (3, "plain")], "id long, safe_text string")
    got = {r["id"]: r for r in rehydrate.rehydrate(texts, ["id"], vault).collect()}
    assert got[1]["restored"] == "é Ann Lee [CARD_U001] a@x.org [SSN_U009]"
    assert (got[1]["n_restored"], got[1]["unknown"], got[1]["ambiguous"]) == (2, ["[SSN_U009]"], ["[CARD_U001]"])
    assert got[2]["restored"] is None and got[3]["restored"] == "plain"


def test_headers_and_labels(spark):
    heads = {"E-mail": "EMAIL_ADDRESS", "Assigned reviewers": "PERSON", "Vendor name": None, "Mobile": "PHONE_NUMBER", "": None, "Blood group": "HEALTH_DATA", "UPI id": "UPI_ID", "Account number": "BANK_ACCOUNT", "tax id": "TAX_ID", "PAN": "IN_PAN", "PAN card": None, "Driver's license": "DRIVING_LICENCE", "NI number": "UK_NINO", "Badge": "EMPLOYEE_ID", "IP": "IP_ADDRESS", "Workflow owner": None, "System owner group": None, "Owner": "PERSON", "Owner " + "x" * 60: None}
    rows = spark.createDataFrame([(h,) for h in heads], "h string").select("h", structure.header_category(F.col("h")).alias("c")).collect()
    assert {r["h"]: r["c"] for r in rows} == heads
    lines = spark.createDataFrame([(1, "  Owner: Ann Lee, CISO"), (2, "Vendor: X"), (3, None), (4, "Passport no:  K4829175 ")], "doc long, text string")
    got = {r["doc"]: (r["start"], r["end"], r["value"], r["entity_type"]) for r in structure.labelled(lines).collect()}
    assert got == {1: (9, 16, "Ann Lee", "PERSON"), 4: (14, 22, "K4829175", "PASSPORT")}


def test_transcript_cues(spark):
    vtt = "WEBVTT\n\nSTYLE\nx\n\n1\n00:00:01.000 --> 00:00:02.500\n<v Ann Lee>Hello there\n\n00:03.000 --> 00:04.000\nBob: fine,\r\nthanks\n\nNOTE x"
    got = cues.transcript(spark.createDataFrame([(1, vtt), (2, None), (3, "")], "id long, text string"), "id").orderBy("span_ord").collect()
    assert [(r["id"], r["begins"], r["speaker"], r["text"]) for r in got] == [(1, "00:00:01.000", "Ann Lee", "Hello there"), (1, "00:03.000", "Bob", "fine,\nthanks")]


def test_cells_under_headers(spark, tmp_path):
    (tmp_path / "people.csv").write_text('Name,E-mail,Notes\nAnn,a@x.org,\n"Lee, B",,"two\nlines"\n')
    got = cues.csv_cells(spark, str(tmp_path / "people.csv")).collect()
    assert sorted((r["header"], r["col"], r["text"]) for r in got) == [("E-mail", 1, "a@x.org"), ("Name", 0, "Ann"), ("Name", 0, "Lee, B"), ("Notes", 2, "two\nlines")]
