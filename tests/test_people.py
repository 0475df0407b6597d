"""Names cut, completed and looked for until no person is new."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import names, people

KEYS = ["doc_id"]
LISTS = names.Lists(given=frozenset({"rob", "yelena"}))
FOUND = "doc_id long, start int, end int, value string, entity_type string, recognizer string, score double"


def frames(spark, texts, hits):
    """hits: (row, value, recognizer, score), found at the first place of the value."""
    spans = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, texts[i].index(v), texts[i].index(v) + len(v), v, "PERSON", r, s) for i, v, r, s in hits]
    return spans, spark.createDataFrame(rows, FOUND)


def test_cleaned(spark):
    texts = ["  Rob Olsen\nSite", "Managing Director", "Olsen", "Ms Varga", "J. Olsen", "J. the", "the Rob Olsen of"]
    hits = [(0, texts[0], "tagger", 0.9), (1, texts[1], "tagger", 0.9), (2, "Olsen", "tagger", 0.9), (3, "Varga", "honorific_name", 0.8), (4, "J. Olsen", "initials_surname", 0.6), (5, "J. the", "initials_surname", 0.6), (6, texts[6], "tagger", 0.9)]
    spans, found = frames(spark, texts, hits)
    lists = names.Lists(ordinary=frozenset({"managing", "director"}))
    got = {r.doc_id: (r.start, r.value, r.score) for r in people.cleaned(found, spans, KEYS, lists).collect()}
    assert got == {0: (2, "Rob Olsen", 0.9), 2: (0, "Olsen", 0.5), 3: (3, "Varga", 0.8), 4: (0, "J. Olsen", 0.6), 6: (4, "Rob Olsen", 0.9)}


@pytest.mark.parametrize(
    "text, value, want",
    [
        ("by Yelena Voronin's desk", "Yelena", "Yelena Voronin"),
        ("by YELENA 0LSEN, then", "YELENA", "YELENA 0LSEN"),  # a digit within capitals becomes a small letter, so another case
        ("by YELENA V0RONIN, then", "YELENA", "YELENA"),
        ("by Yelena VORONIN", "Yelena", "Yelena"),
        ("by Yelena the", "Yelena", "Yelena"),
        ("with Rob Olsen", "Olsen", "Rob Olsen"),
        ("with Ron Olsen", "Olsen", "Olsen"),
        ("Ngozi C. Okpara", "Okpara", "Ngozi C. Okpara"),
        ("ChairYelena A. Voronin", "Voronin", "Yelena A. Voronin"),
        ("see T. K. Olsen", "Olsen", "T. K. Olsen"),
        ("The A. Olsen", "Olsen", "A. Olsen"),
        ("Tamara 5. Olsen", "Olsen", "Tamara 5. Olsen"),
        ("R. Olsen", "R. Olsen", "R. Olsen"),
    ],
)
def test_extended(spark, text, value, want):
    spans, found = frames(spark, [text], [(0, value, "tagger", 0.9)])
    (row,) = people.extended(found, spans, KEYS, LISTS).collect()
    assert (row.value, text[row.start : row.end]) == (want, want)


@pytest.mark.parametrize("texts", [["", None, "x"], []])
def test_nobody(spark, texts):
    spans = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    standing, index = people.everywhere(spans, KEYS, spark.createDataFrame([], FOUND), LISTS)
    assert standing.isEmpty() and index.isEmpty()


def test_everywhere_until_nobody_is_new(spark):
    # Voronin is known; her given name and a colleague of one of her names come up a round later each
    texts = ["Miss Anna Voronin", "Ngozi C. Voronin spoke", "then Ngozi wrote", "Ngozi Mabaso replied", "to Mabaso", "unrelated words", None, "Anna, then Voronin"]
    hits = [(0, "Anna Voronin", "tagger", 0.9)]
    spans, found = frames(spark, texts, hits)
    want = None
    for delta in (False, True):
        standing, index = people.everywhere(spans, KEYS, found, LISTS, delta=delta)
        got = sorted((r.doc_id, r.start, r.end, r.value, r.recognizer, r.score, r.decision, r.canonical or "") for r in standing.collect()), sorted(map(tuple, index.collect()))
        want = want or got
        assert got == want
    values = {(r[0], r[3]) for r in want[0]}
    assert {(1, "Ngozi C. Voronin"), (2, "Ngozi"), (3, "Ngozi Mabaso"), (4, "Mabaso"), (7, "Voronin")} <= values
    once, _ = people.everywhere(spans, KEYS, found, LISTS, rounds=1)
    assert not once.where(F.col("doc_id").isin(2, 4)).count()
