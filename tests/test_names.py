"""Names that are alike against all pairs; confirmed people named again in many ways."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import evaluate, fuzzy, names, residue

KEYS = ["doc_id"]


def texts(seed, n):
    rng = random.Random(seed)
    firsts, lasts = ["ana", "john", "maria", "li", "christopher", "jo"], ["davis", "featherstone", "wu", "lopez", "kittelsen", "mendoza"]
    out = []
    for _ in range(n):
        t = list(f"{rng.choice(firsts)} {rng.choice(lasts)}")
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "e", "n", "a"])
        out.append("".join(t))
    return [*out, "", None, "a", "b", "ab"]


@pytest.mark.parametrize("least", [60, 78, 85, 100])
def test_similar_pairs_equal_all_pairs(spark, least):
    left, right = texts(1, 60), texts(2, 60)
    frame = lambda rows, c: spark.createDataFrame([(r,) for r in rows + rows[:5]], f"{c} string")
    got = {(r.x, r.y): r.similarity for r in fuzzy.similar(frame(left, "x"), "x", frame(right, "y"), "y", least).collect()}
    want = {(a, b): s for a in left for b in right if a and b and (s := fuzzy.ratio(a, b)) >= least}
    assert got == want and (least < 100 or all(a == b for a, b in got))


def test_misread_words_of_the_vocabulary(spark):
    frame = lambda *rows: spark.createDataFrame([(r,) for r in rows], "w string")
    got = {r.w: r.meant for r in fuzzy.near_vocabulary(frame("Managememt", "Contracti", "management", "short", "unlike words", None), "w", frame("management", "contracting", "shorts"), "w").collect()}
    assert got == {"managememt": "management", "contracti": "contracting"}


def index(spark, *people):
    rows = [(p, "PERSON", "redact", "label") for p in people]
    return names.people(spark.createDataFrame(rows, "value string, entity_type string, decision string, recognizer string"))


@pytest.mark.parametrize("held", [residue.HELD, 0])
def test_people_named_again(spark, held):
    rows = ["ChairYelena and OlsenRob", "tamara.Cadence logged in as tamara", "Varga-Lindt and CTL-Tomas", "Page-level rob-like Olsen-style", "YELENA'S and yelena", "Rob Olsen, R. Olsen", "xrob Robx olsenrob"]
    spans = spark.createDataFrame([(i, t, "ocr" if i == 1 else "native") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    people = index(spark, "Yelena Moss", "Rob Olsen", "Tamara Cadence", "Ida Varga", "Tomas Page")
    got = {}
    for r in names.propagate(spans, KEYS, people, held=held).collect():
        got.setdefault(r.doc_id, set()).add((r.value, r.score))
    assert got == {0: {("Yelena", 0.72), ("Olsen", 0.72), ("Rob", 0.72)}, 1: {("tamara", 0.5), ("Cadence", 0.72)}, 2: {("Varga", 0.72), ("Tomas", 0.72)}, 4: {("YELENA", 0.72)}, 5: {("Rob Olsen", 0.95), ("R. Olsen", 0.85)}}


def test_misread_names_and_initials(spark):
    people = index(spark, "Christopher Featherstone", "Finn Kittelsen", "John Davis", "Jane Davies")
    near = names.misread(spark.createDataFrame([("Christopner Eeatherstonc",), ("Jahn Davis",), ("Paul Kittelsen",), (None,)], "name string"), people)
    assert {r.name: r.canonical for r in near.collect()} == {"Christopner Eeatherstonc": "Christopher Featherstone", "Jahn Davis": "John Davis"}
    spots = [("F.L.Kittelsn", "F", "kittelsn"), ("C.A kittels", "C", "kittels"), ("F. Kitlesen", "F", "kitlesen"), ("G. Kitelen", "G", "kitelen"), ("J. Daviess", "J", "daviess")]
    surnames = {"featherstone": "Christopher Featherstone", "kittelsen": "Finn Kittelsen", "davis": "John Davis", "davies": "Jane Davies"}
    want = {}
    for value, letter, own in spots:
        best = sorted((-r, full) for s, full in surnames.items() if (r := fuzzy.ratio(own, s)) >= 88 or (r >= 78 and full[0] == letter))
        want |= {value: best[0][1]} if best else {}
    spans = spark.createDataFrame([(0, ", ".join(v for v, *_ in spots)), (1, "F. Kittelsen"), (2, None)], "doc_id long, text string")
    found = names.misread_initials(spans, KEYS, people).collect()
    assert {r.value: r.canonical for r in found} == want and len(want) >= 3 and {r.doc_id for r in found} == {0}


def test_pairs_taken_in_rounds_are_those_of_a_walk(spark):
    rng = random.Random(9)
    rows = sorted({(f"f{rng.randrange(3)}", rng.randrange(12), rng.randrange(12)) for _ in range(160)})
    rows = [(*r, rng.choice([0.5, 0.8, 1.0]), rng.random() < 0.5) for r in rows]
    pairs = spark.createDataFrame(rows, "file string, g long, f long, score double, same boolean")
    order = [F.col("score").desc(), F.col("same").desc(), F.col("g"), F.col("f")]
    got = {tuple(r) for r in evaluate.one_to_one(pairs, ["file", "g"], ["file", "f"], order).collect()}
    want, used = set(), set()
    for r in sorted(rows, key=lambda r: (-r[3], not r[4], r[1], r[2])):
        ends = {(r[0], "g", r[1]), (r[0], "f", r[2])}
        if not ends & used:
            used |= ends
            want.add(r)
    assert got == want and evaluate.one_to_one(pairs.where("false"), ["file", "g"], ["file", "f"], order).count() == 0
