"""Documents at a Jaccard similarity of 0.8 or more are one group, also in crowds; others stay apart."""

from pathlib import Path

import numpy as np

from veilframe.llm import simhash
from veilframe.llm.common import shared_dir
from veilframe.llm.components import components

WORDS = [f"w{i}" for i in range(5000)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, words, places):
    out = list(words)
    for p in places:
        out[p] = f"edit{rng.integers(1 << 40)}"
    return out


def brute(rows):
    """The smallest id of each row's component over all pairs."""
    sets, names = [(i, shingles(t)) for i, t in rows], {i: i for i, _ in rows}
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if names[a] != names[b] and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((names[a], names[b]))
                names = {i: low if n == high else n for i, n in names.items()}
    return names


def test_pairs_down_to_the_similarity_are_linked(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        words = [str(x) for x in rng.choice(WORDS, 100)]
        rows.append((10 * i, " ".join(words)))
        rows.append((10 * i + 1, " ".join(edited(rng, words, [50]))))  # 5 of 96 shingles: 0.90
        rows.append((10 * i + 2, " ".join(edited(rng, words, [30, 70])) if i % 2 else " ".join(words[:82])))  # 0.81
        rows.append((10 * i + 3, " ".join(edited(rng, words, [20, 40, 60, 80]))))  # 0.66 or less to the first
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999).collect()}
    assert got == brute(rows)
    assert all(got[10 * i + 1] == got[10 * i + 2] == 10 * i and got[10 * i + 3] == 10 * i + 3 for i in range(40))


def test_crowds_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 4)
    rng = np.random.default_rng(9)
    rows, base = [], [str(x) for x in rng.choice(WORDS, 120)]
    # a crowd round one text: some near it, some only near one another by pairs or chains
    for i in range(60):
        far = edited(rng, base, rng.choice(20, 4, replace=False) * 6)
        rows.append((3 * i, " ".join(far)))
        rows.append((3 * i + 1, " ".join(edited(rng, far, [119 - i % 3]))))
        rows.append((3 * i + 2, " ".join(edited(rng, base, [int(rng.integers(120))]))))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999).collect()}
    assert got == brute(rows)


def test_null_ids_and_texts(spark):
    rows = [(3, None, 1), (2, " \t", 1), (None, "", 1), (5, "One two", 1), (5, "one two", 1), (None, "lost words here", 1), (None, "lost words here", 1)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted((r.doc_id or 0, (r.text or "").lower().strip()) for r in got) == [(0, "lost words here"), (2, ""), (5, "one two")]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_stage_drops_a_copy_with_one_changed_word(spark):
    import corpus_pipeline

    rng = np.random.default_rng(10)
    rows = []
    for i in range(20):
        words = [str(x) for x in rng.choice(WORDS, 100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, [50])))]
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in left.collect()) == list(range(0, 40, 2))


def test_tables_between_steps_go_once_used(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(str(x) for x in rng.choice(WORDS, 100))) for i in range(40)]
    rows += [(40 + i, " ".join(edited(rng, rows[i][1].split(), [50]))) for i in range(20)]
    there = lambda: {x.name for x in Path(shared_dir(spark)).iterdir()}
    before = there()
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 40 for i in range(60)}
    left = {x.rsplit("-", 1)[0] for x in there() - before}
    assert not {"sketches", "sets", "placed", "block-slices", "slices", "nearest", "other-pairs", "best-pairs"} & left


def test_a_pair_is_told_in_the_first_block_it_shares(spark):
    """Three fingerprints of two blocks of 4 bits: nodes 1 and 2 share both blocks, 3 shares the second alone."""
    wide = lambda first, second: bytes(8) + np.packbits([*first, *second, *[0] * 56]).tobytes()
    a, b, z = [1, 0, 0, 1], [0, 1, 1, 0], [0, 0, 0, 0]
    blocks = {0: [(1, wide(a, b)), (2, wide(a, b))], 1: [(1, wide(a, b)), (2, wide(a, b)), (3, wide(z, b))]}
    met = spark.createDataFrame([(t << 4, [(i, 9, i, w) for i, w in rows]) for t, rows in blocks.items()], "key long, left array<struct<node long, n int, root long, wide binary>>")
    got = simhash.facing(met, 0.8, 4, 2, nearest=False).collect()
    assert sorted((r.key, r.a, r.b, r.d) for r in got) == [(0, 1, 2, 0), (16, 1, 3, 2), (16, 2, 3, 2)]


def test_whole_fingerprints_come_to_blocks_once(spark, monkeypatch):
    """Later turns take along what the first has put together, and a crowd is linked as all pairs are."""
    monkeypatch.setattr(simhash, "SLICE", 4)
    turns, blocks = [], simhash.facing_blocks
    monkeypatch.setattr(simhash, "facing_blocks", lambda *a: turns.append("blocks") or blocks(*a))
    met = simhash.meeting
    monkeypatch.setattr(simhash, "meeting", lambda rows: turns.append("meeting") or met(rows))
    rng = np.random.default_rng(12)
    base = [str(x) for x in rng.choice(WORDS, 120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice(20, int(rng.integers(1, 5)), replace=False) * 6))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999).collect()}
    assert got == brute(rows)
    assert turns.count("meeting") > 1 and turns.count("blocks") == 1


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 2)
    rows = [(1, 2, 1, 9, 7, b""), (1, 2, 2, 9, 7, b""), (2, 2, 1, 9, 7, b""), (2, 2, 3, 9, 8, b""), *((3, 6, i, 9, 7, b"") for i in range(6))]
    alone, crossed, _ = simhash.meeting(spark.createDataFrame(rows, "key long, many long, node long, n int, root long, wide binary"))
    assert [r.key for r in alone.collect()] == [2] and crossed.collect() == []


def test_small_graphs_take_few_tasks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chain = spark.createDataFrame([(10 * c + i, 10 * c + i + 1) for c in range(50) for i in range(9)], "a long, b long")
        found = components(chain)
        assert {(r.node, r.root) for r in found.collect()} == {(10 * c + i, 10 * c) for c in range(50) for i in range(10)}
        assert len(found.inputFiles()) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
