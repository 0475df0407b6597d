"""Credentials, overlaps, names, code and markings, the gate, owners, evaluation: small literal tables."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import secrets
from veilframe.operators import evaluate, fuzzy, guard, names, owners, protected, redact, residue, resolve, rules, structure

KEYS = ["doc_id", "span_ord"]


def spans(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, span_ord int, text string")


def found(spark, *texts, which=None):
    return {(r.doc_id, r.recognizer): r for r in rules.scan(spans(spark, *texts), which).collect()}


def test_credentials_and_their_places(spark):
    texts = [
        'password: Hunter2!Hunter2', 'password = "password"', 'db_password = "s3cr3t-Val9"', "max_tokens = 'aaaaaaaaaaaa1'", "password_file = '/etc/my/file9'",
        "postgres://app:pa55w0rd!@db.host/x mail me@site.org", "Authorization: Bearer abcdefGHIJK12345", "key sk-proj-abcdefghijklmnopqrstuv0123", "export API_KEY=abcd1234efgh", "token = 'os.environ[X]'",
        "the password is Tr1ton!Vault#88. Why", "see fe80::1ff:fe23:4567:890a and 1:2", "Dear Ms Varga-Lindt, hello", "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q",
    ]
    got = found(spark, *texts)
    assert got[0, "secret_assigned"].score >= 0.6 and got[0, "secret_assigned"].value == "Hunter2!Hunter2"
    assert (got[1, "secret_in_code"].start, got[1, "secret_in_code"].end) == (12, 20)
    assert got[2, "secret_in_code"].value == "s3cr3t-Val9" and (3, "secret_in_code") not in got and (4, "secret_in_code") not in got
    assert got[5, "secret_url_password"].value == "pa55w0rd!" and got[5, "email"].value == "me@site.org"
    assert got[6, "secret_auth_header"].value == "abcdefGHIJK12345" and got[7, "secret_known"].score == 0.9 and got[8, "secret_env"].value == "abcd1234efgh"
    assert got[9, "secret_in_code"].score < 0.35 and got[10, "secret_assigned"].value == "Tr1ton!Vault#88"
    assert got[11, "ipv6"].score >= 0.55 and got[12, "honorific_name"].value == "Varga-Lindt" and (13, "secret_known") in got
    for (i, _), r in got.items():
        assert texts[i][r.start : r.end] == r.value


def test_a_match_gives_way_to_an_earlier_rule(spark):
    got = found(spark, "ftp://u:abc@mail.org; jo @ acme corp", "a@b.org")
    assert (0, "email") not in got and (0, "email_ocr_damaged") in got and (1, "email") in got and (1, "email_ocr_damaged") not in got


def test_image_rules(spark):
    got = found(spark, "call +1 2l2 555 O147 T.R.Moreau wrote EMP 47216 ana_lopez", which=rules.IMAGE_RULES)
    assert {"initials_surname", "org_person_id_ocr", "name_dot_surname", "phone_ocr_confusable"} <= {k for _, k in got}


def test_named_secret_and_entropy(spark):
    df = spark.createDataFrame([("db_password",), ("API_KEY",), ("clientSecret",), ("password_file",), ("max_tokens",), ("key_id",)], "k string")
    assert [r[0] for r in df.select(secrets.named_secret(F.col("k"))).collect()] == [True, True, True, False, False, False]
    bits = spark.createDataFrame([("aaaa",), ("abab",), ("abcd",)], "v string").select(secrets.entropy(F.col("v"))).collect()
    assert [round(r[0], 6) for r in bits] == [0, 1, 2]


def raw(spark, *rows):
    return spark.createDataFrame([(1, 0, *r) for r in rows], "doc_id long, span_ord int, start int, end int, value string, entity_type string, recognizer string, score double, layer string")


def test_survivors_of_a_chain(spark):
    got = resolve.resolve(raw(spark, (0, 10, "a", "CREDENTIAL", "x", 0.9, "L1"), (8, 20, "b", "PERSON", "y", 0.9, "L1"), (18, 30, "c", "EMAIL_ADDRESS", "z", 0.9, "L1")), KEYS).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 10), (18, 30)]


def test_layers_agree_and_widen(spark):
    one = resolve.resolve(raw(spark, (0, 10, "a", "PERSON", "x", 0.5, "L1"), (0, 10, "a", "PERSON", "y", 0.5, "L1")), KEYS).collect()
    assert [(r.score, r.decision) for r in one] == [(0.5, "review")]
    two = resolve.resolve(raw(spark, (0, 10, "a", "PERSON", "x", 0.5, "L1"), (5, 14, "b", "PERSON", "y", 0.55, "L3")), KEYS).collect()
    assert [(r.start, r.end, r.score, r.decision, r.widened) for r in two] == [(0, 14, 0.65, "redact", True)]
    apart = resolve.resolve(raw(spark, (0, 10, "a", "PERSON", "x", 0.9, "L1"), (5, 40, "b", "PERSON", "y", 0.5, "L1")), KEYS).collect()
    assert sorted((r.start, r.end) for r in apart) == [(0, 10), (5, 40)]


def test_gate_sees_every_span(spark):
    lines = spans(spark, "write to ana@site.org now", "seen: ANA@site.org again", "xana@site.orgy is another")
    won = resolve.rewritten(resolve.resolve(rules.scan(lines, [r for r in rules.RULES if r.name == "email"]), KEYS), lines, KEYS).where("doc_id = 0")
    own = won.withColumn("token", F.lit("[EMAIL_U001]"))
    needles = residue.needles(own)
    assert {(r.doc_id, r.start, r.end) for r in residue.locate(lines, needles, KEYS).collect()} == {(0, 9, 21), (1, 6, 18)}
    safe = residue.scrub(lines, needles, KEYS)
    assert [r.safe_text for r in safe.orderBy("doc_id").collect()][:2] == ["write to [EMAIL_U001] now", "seen: [EMAIL_U001] again"]
    assert residue.gate(safe, own, KEYS).count() == 0
    assert residue.gate(lines.withColumn("safe_text", F.col("text")), own, KEYS).count() == 2


def test_numbers_by_first_appearance(spark):
    rows = [(i, 0, 0, 3, f"v{i % 1100}@x.org", "EMAIL_ADDRESS", "email", 0.9, "redact") for i in range(2200)]
    df = spark.createDataFrame(rows, "doc_id long, span_ord int, start int, end int, value string, entity_type string, recognizer string, score double, decision string")
    got = {r.norm_value: r.token for r in redact.numbered_vault(df, ["doc_id", "span_ord", "start"]).collect()}
    assert got["v0@x.org"] == "[EMAIL_U001]" and got["v1099@x.org"] == "[EMAIL_U1100]" and len(set(got.values())) == 1100


def test_code_by_lines(spark):
    texts = ["def f(x):\n    y = x + 1\n    return y\n", "Hello there\nHow are you", "```\nplain words\n```\nthanks", "import os\nprint(os.name)\nthen some prose follows here\nand more of it\nand more", None]
    got = {r.doc_id: r for r in guard.code(spans(spark, *texts), ["doc_id"]).collect()}
    assert got[0].detected and got[0].blocks == [[1, 3]] and got[0].languages == ["Python"] and not got[1].detected and got[2].detected
    assert got[3].code_lines == 0 and 4 not in got


def test_markings(spark):
    texts = ["STRICTLY CONFIDENTIAL", "Classification: Restricted", "this is restricted to members", "[Confidential]", "we keep it confidential, mostly, in all of our many offices", "Confidential"]
    got = {r.doc_id for r in guard.markings(spans(spark, *texts)).collect()}
    assert got == {0, 1, 3, 5}


def test_guard_policies(spark):
    prompts = spark.createDataFrame([(1, "def f(x):\n    y = x + 1\n    return y"), (2, "mail ana@site.org"), (3, "good morning"), (4, "Internal use only: plan"), (5, None)], "conv_id long, text string")
    by = {r.conv_id: r for r in guard.check(prompts, ["conv_id"]).collect()}
    assert [by[i].verdict for i in range(1, 6)] == ["blocked", "redacted", "clean", "blocked", "clean"]
    assert by[1].safe_text == "" and by[2].safe_text == "mail [EMAIL_U001]" and by[4].blocked_by == ["marking"]
    soft = {r.conv_id: r for r in guard.check(prompts, ["conv_id"], guard.Policy(source_code="warn", markings="allow", block_categories=("EMAIL_ADDRESS",), max_bytes=25)).collect()}
    assert soft[1].blocked_by == ["size"] and soft[2].blocked_by == ["category EMAIL_ADDRESS"] and soft[4].verdict == "clean"
    rows = guard.replayed(prompts.withColumn("sensitive", F.col("conv_id").isin(1, 2, 4)), ["conv_id"], cap=20)
    s = guard.replay_summary(rows).first()
    assert (s.scenarios, s.guard_right, s.guard_leaks, s.guard_refused_harmless, s.cap_leaks) == (5, 5, 0, 0, 1)


def told(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.x for r in rows.select("i", fn(F.col("text")).alias("x")).orderBy("i").collect()]


def test_shapes_of_names(spark):
    s = names.Lists(frozenset({"priya", "rahul", "hans"}), frozenset({"vendor", "risk", "page"}), frozenset({"acme"}))
    looks = lambda t: names.looks(t, s)
    assert told(spark, looks, "Priya Raman", "M. Vossberg", "TK Moreau", "Dr. Ana de la Cruz", "PRIYA RAMAN") == [True] * 5
    assert told(spark, looks, "Vendor Risk", "RAMAN", "Priya RAMANUJAN", "Acme", "Ana Ltd", "Risk Committee", "a b", "Ana 3", None, "", "rahul verma", "A. B.", "One Two Three Four Five Six") == [False] * 13
    assert told(spark, lambda t: names.looks(t, s, cases=("lower",)), "rahul verma", "ment process", "risk verma", "rahul risk") == [True, True, False, True]
    cut = lambda t: names.trimmed(t, s)
    texts = ["M. Vossberg CEO", "Vendor Tier", "Larry Page", "Page 3 Larry", "the Priya Raman's", "", "CEO PRIYA RAMAN"]
    assert [t[r.start : r.end] if r else None for t, r in zip(texts, told(spark, cut, *texts), strict=True)] == ["M. Vossberg", None, "Larry Page", "Larry", "Priya Raman", None, "CEO PRIYA RAMAN"]
    found = told(spark, lambda t: names.listed(t, s), "met rahul verma today, Hans van der Berg too", "PRIYA RAMAN. Priya, Raman", "Rahul Vendor", "")
    assert [[(m.start, m.end, m.score) for m in row] for row in found] == [[(4, 15, 0.5), (23, 40, 0.62)], [(0, 11, 0.62)], [], []]
    v = {x.written: x.score for x in told(spark, names.variants, "Anna Lopez-Ruiz")[0]}
    assert v == {"Anna Lopez-Ruiz": 0.95, "A. Lopez-Ruiz": 0.85, "A Lopez-Ruiz": 0.8, "Anna": 0.72, "Lopez-Ruiz": 0.72, "Lopez": 0.6, "Ruiz": 0.6}
    assert [{x.written for x in row} for row in told(spark, names.variants, "DR PRIYA RAMAN", "May", "", None)][:3] == [{"Priya Raman", "P. Raman", "P Raman", "Priya", "Raman"}, set(), set()]
    assert told(spark, names.denoised, "C1ark", "5teven", "A12", "Cl9rk", "B0b1by5") == ["Clark", "Steven", "A12", "Cl9rk", "B0b1by5"]
    assert told(spark, names.folded, "Łukasz") == ["lukasz"] and told(spark, lambda t: names.surname(t, "title", s), "C1ark,", "Vendor", "Ltd", "CLARK") == [True, False, False, False]


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "abd"), ("kitten", "sitting"), ("jahn davis", "john davis"), ("x", "")])
def test_ratio_by_brute_force(a, b):
    row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
    want = 200 * row[-1][-1] / (len(a) + len(b)) if a or b else 100
    assert abs(fuzzy.ratio(a, b) - want) < 1e-9


def test_people_are_found_again(spark):
    seen = spark.createDataFrame([("Rafael Mendoza", "PERSON", "redact", "honorific_name"), ("Anna Zubiri", "PERSON", "redact", "x"), ("Tomas Zubiri", "PERSON", "redact", "x")], "value string, entity_type string, decision string, recognizer string")
    index = names.people(seen)
    lines = spans(spark, "R. Mendoza and RAFAEL MENDOZA met Zubiri", "the page of rafael", "Mendoza-level work", "Rafael's plan")
    got = {(r.doc_id, r.value): r for r in names.propagate(lines, KEYS, index).collect()}
    assert {(0, "R. Mendoza"), (0, "RAFAEL MENDOZA"), (0, "Zubiri"), (3, "Rafael")} == set(got)
    assert got[0, "Zubiri"].score == 0.62 and got[0, "R. Mendoza"].canonical == "Rafael Mendoza"
    close = names.misread(spark.createDataFrame([("Rafaei Mendoza",), ("Paul Mendoza",)], "name string"), index).collect()
    assert [(r.name, r.canonical) for r in close] == [("Rafaei Mendoza", "Rafael Mendoza")]


def test_ids_in_other_codes(spark):
    lines = spans(spark, "EMP-47216 holds CFG-47216-0091 and 47216")
    own = raw(spark, (0, 9, "EMP-47216", "EMPLOYEE_ID", "org_person_id", 0.9, "L1")).withColumns({"doc_id": F.lit(0).cast("long"), "decision": F.lit("redact")})
    assert [r.value for r in names.propagate_ids(lines, KEYS, own).collect()] == ["CFG-47216-0091"]


def test_owners(spark):
    schema = "doc_id long, start int, end int, value string, entity_type string, decision string, row int"
    rows = [(1, 0, 5, "Ana Lopez", "PERSON", "redact", 1), (1, 6, 9, "555-123-4567", "PHONE_NUMBER", "redact", 1), (2, 0, 4, "alopez@x.org", "EMAIL_ADDRESS", "redact", None), (3, 0, 4, "zz@x.org", "EMAIL_ADDRESS", "redact", None), (4, 0, 4, "ana.lopez@y.org", "EMAIL_ADDRESS", "redact", None)]
    got = {r.norm_value: r.token for r in owners.owned_vault(spark.createDataFrame(rows, schema), ["doc_id", "start"], ["doc_id", "row"]).collect()}
    assert got == {"ana lopez": "[PERSON_001]", "5551234567": "[PHONE_001]", "alopez@x.org": "[EMAIL_001]", "ana.lopez@y.org": "[EMAIL_001_2]", "zz@x.org": "[EMAIL_U001]"}


def test_registry(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "too short"), (3, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    prints = protected.register(items, "item_id", "salt")
    assert {r.item_id for r in prints.collect()} == {3} and protected.removed(prints, "item_id", [3]).count() == 0
    docs = spark.createDataFrame([(7, "intro line\n" + " ".join(f"w{i}" for i in range(12)) + "\nend")], "doc_id long, text string")
    row = protected.overlaps(docs, "doc_id", prints, "item_id", "salt").first()
    assert (row.words_covered, row.longest_run, row.share, row.lines) == (12, 12, 0.8, [[2, 2]])
    assert protected.match(docs, "doc_id", prints, "item_id", "other").count() == 0


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "a", None, "Ana Lopez", "PERSON", "narrative"), (2, "a", None, "555 1234", "PHONE_NUMBER", "table"), (3, "a", None, "gone", "PERSON", "table")], "gold_id long, file string, page int, text string, category string, context_type string")
    f = spark.createDataFrame([(1, "a", None, "Ana Lopes", "PERSON", "redact"), (2, "a", None, "5551234", "PHONE_NUMBER", "review"), (3, "a", None, "noise", "PERSON", "redact")], "finding_id long, file string, page int, value string, entity_type string, decision string")
    hits = evaluate.matched(gold, f)
    assert {(r.gold_id, r.finding_id) for r in hits.collect()} == {(1, 1), (2, 2)}
    row = evaluate.evaluate(gold, f).first()
    assert (row.gold, row.recalled, row.findings, row.true_positives, row.recall, row.precision) == (3, 2, 3, 2, 0.6667, 0.6667)
    assert {r.context_type: r.recall for r in evaluate.by(gold, hits, "context_type").collect()} == {"narrative": 1.0, "table": 0.5}
    left = evaluate.leaks(gold, spark.createDataFrame([("a", "here Ana Lopez stays, xgone goes")], "file string, text string"))
    assert [r.gold_id for r in left.collect()] == [1]


def test_structure_rules(spark):
    cells = spark.createDataFrame([(1, 0, "table_cell", "Reviewer", "Ana Lopez\nn/a"), (1, 1, "table_cell", "Vendor name", "Acme")], "doc_id long, span_ord int, kind string, header string, text string")
    assert [(r.value, r.start) for r in structure.headed(cells).collect()] == [("Ana Lopez", 0)]
    talk = spark.createDataFrame([(1, 0, "paragraph", "Dana: hi\nDana: again\nNext: no"), (1, 1, "speaker", "Tom Reed"), (1, 2, "speaker", "Speaker 1")], "doc_id long, span_ord int, kind string, text string")
    assert sorted((r.value, r.score) for r in structure.speakers(talk, KEYS).collect()) == [("Dana", 0.7), ("Dana", 0.7), ("Tom Reed", 0.8)]
    broken = spark.createDataFrame([(1, 0, "see EMP-"), (1, 1, "other"), (1, 2, "47216 here"), (1, 9, "47217")], "doc_id long, span_ord int, text string")
    assert [(r.value, r.span_ord) for r in structure.broken_ids(broken, "doc_id").collect()] == [("EMP-47216", 2)]
    lists = spans(spark, "Ana Lopez\nTom Reed\nIda Voss\nn/a")
    people = spark.createDataFrame([(0, 0, 0, 9), (0, 0, 10, 18)], "doc_id long, span_ord int, start int, end int")
    assert [r.value for r in structure.name_lists(lists, KEYS, people).collect()] == ["Ida Voss"]
