"""The vault reads its findings once."""

from veilframe.operators import redact


def test_findings_are_found_once_for_the_vault(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i % 7, 0, i, "EMAIL_ADDRESS", f"a{i % 9}@b.co", "redact") for i in range(40)]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kind = "doc_id long, span_ord int, start int, entity_type string, value string, decision string"
    found = spark.createDataFrame(rows, kind).mapInArrow(counted, kind)
    got = redact.numbered_vault(found, ["doc_id", "span_ord", "start"]).collect()
    assert sum(r.occurrences for r in got) == 40 and len({r.token for r in got}) == 9
    assert seen.value == 40
