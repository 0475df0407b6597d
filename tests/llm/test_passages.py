"""Passages are found whatever other documents hold, exact ones always and near ones mostly; odd rows do not crash."""

import numpy as np

from veilframe.llm import passages

SCHEMA = "doc_id long, text string"


def words(rng, n):
    return [f"x{int(v)}" for v in rng.integers(0, 1 << 40, n)]


def covered(found, doc):
    return {w for r in found if r.id == doc for w in range(r.start_word, r.end_word)}


def test_unrelated_holders_of_phrases_hide_nothing(spark):
    rng = np.random.default_rng(12)
    passage = words(rng, 60)
    rows = [(i, " ".join([*words(rng, 80), *passage[5 * i : 5 * i + 5], *words(rng, 80)])) for i in range(11)]
    rows += [(20, " ".join([*words(rng, 40), *passage, *words(rng, 40)])), (30, " ".join([*words(rng, 70), *passage, *words(rng, 30)]))]
    # a part of it, and the same runs in another order, in earlier documents
    rows += [(12, " ".join([*words(rng, 90), *passage[:40], *words(rng, 40)])), (13, " ".join([*words(rng, 90), *passage[30:], *passage[:30], *words(rng, 40)]))]
    found = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert set(range(70, 130)) <= covered(found, 30)


def test_a_passage_of_many_documents(spark):
    rng = np.random.default_rng(13)
    passage = words(rng, 80)
    rows = [(i, " ".join([*words(rng, 50), *passage, *words(rng, 50)])) for i in range(700)]
    found = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, set()).update(range(r.start_word, r.end_word))
    assert all(set(range(50, 130)) <= by.get(i, set()) for i in range(1, 700))
    assert len(found) < 5 * 700


def test_near_passages_mostly(spark):
    rng = np.random.default_rng(14)
    rows, told = [], 0
    for i in range(60):
        passage = words(rng, 100)
        other = list(passage)
        for p in ([50], [30, 70])[i % 2]:  # Jaccard 0.90 and 0.81 on five words
            other[p] = "changed"
        rows += [(2 * i, " ".join([*words(rng, 60), *passage])), (2 * i + 1, " ".join([*other, *words(rng, 60)]))]
    found = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    told = sum(len(covered(found, 2 * i + 1) & set(range(100))) >= 50 for i in range(60))
    assert told >= 0.9 * 60
    assert all(r.of_id == r.id - 1 for r in found)


def test_rows_of_one_id_and_no_rows(spark):
    rng = np.random.default_rng(15)
    a = words(rng, 120)
    rows = [(1, " ".join(a)), (2, " ".join([*words(rng, 30), *a])), (2, "short one"), (2, None), (None, " ".join(a)), (3, "")]
    left = sorted((r.doc_id or 0, r.text or "") for r in passages.drop_repeated(spark.createDataFrame(rows, SCHEMA)).collect())
    assert (0, " ".join(a)) in left and (1, " ".join(a)) in left and (2, "short one") in left
    assert passages.drop_repeated(spark.createDataFrame([], SCHEMA)).collect() == []


def test_places_of_very_long_texts():
    rng = np.random.default_rng(16)
    place = np.array([(1 << 31) - 1, 1 << 24, 9_000_000], np.int64) << 2 * passages.ARM
    left, right = np.array([0, 1]), np.array([2, 2])
    link = passages.laid(np.zeros(3, np.int64), np.array([5, 6, 1]), place, left, right)
    assert link[1].tolist() == [(1 << 31) - 1, 1 << 24] and link[3].tolist() == [9_000_000] * 2
    h = rng.integers(0, 1 << 63, (1 << 24) + 500).astype(np.uint64)
    spans = [(a, b) for a, c, b in passages.compact_windows(h, 46) if b >= (1 << 24) - 200]
    assert any(a <= (1 << 24) - 20 and b >= (1 << 24) + 26 for a, b in spans)


def test_passages_round_a_line_of_many_documents(spark):
    rng = np.random.default_rng(17)
    line = words(rng, 40)
    rows = []
    for i in range(150):
        rest = words(rng, 10)
        rows += [(2 * i + k, " ".join([*words(rng, 60), *rest[:5], *line, *rest[5:], *words(rng, 60)])) for k in (0, 1)]
    found = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert all(set(range(60, 110)) <= covered(found, 2 * i + 1) for i in range(150))
    assert {r.id % 2 for r in found} == {1} and all(r.of_id == r.id - 1 for r in found)


def test_partners_tell_what_all_pairs_would():
    rng = np.random.default_rng(18)
    least, enough = 46, 41
    rows, base = [], rng.integers(1, 1 << 16, 91)
    for value in range(3):
        for i in range(60):
            # some near one of several texts, all with a line in common, at the ends of a text now and then
            own = rng.integers(1, 1 << 16, 91) if i % 3 else np.roll(base, 7 * (i % 4) + value)
            own[40:52] = base[40:52]
            if rng.random() < 0.7 and rows and i:
                own = rows[-int(rng.integers(1, i + 1))][2].copy()
                at = int(rng.integers(86))
                own[at : at + int(rng.integers(1, 9))] = rng.integers(1, 1 << 16)
                own[45] = base[45]
            if i % 10 == 0:
                own[: int(rng.integers(40))] = 0
            rows.append((value, i // 2, own.astype(np.uint16)))
    value, ids, around = (np.array(x) for x in zip(*rows, strict=True))
    has = np.zeros((len(rows), len(rows), least), bool)
    for x in range(len(rows)):
        for y in range(x):
            if value[x] == value[y] and ids[x] != ids[y]:
                b = np.concatenate([[0], around[y], [0]])
                hit = ((around[x] == b[1:-1]) | (around[x] == b[:-2]) | (around[x] == b[2:])) & (around[x] > 0)
                has[x, y] = [hit[o : o + least].sum() >= enough for o in range(least)]
    left, right = passages.partners(value, ids, around, least, enough)
    told = np.zeros_like(has)
    told[left, right] = has[left, right]
    # each stretch that an earlier window has is told with one that has it
    assert (told.any(axis=1) == has.any(axis=1)).all() and has.any(axis=1).sum() > 1000
    assert told.any(axis=2).sum() == len(left) < has.any(axis=2).sum()


def test_windows_of_all_texts_at_once_are_those_of_each():
    rng = np.random.default_rng(19)
    texts = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (46, 47, 300, 91, 2000)]
    # equal tokens, and tokens whose order is that of their places
    texts += [np.zeros(120, np.uint64), np.sort(texts[4]), np.sort(texts[4])[::-1].copy(), np.repeat(texts[2], 3)]
    flat, marks = passages.side_by_side(texts)
    got = list(zip(*(x.tolist() for x in passages.windows_of_all(flat, marks, 46)), strict=True))
    assert got == [(at + 1 + a, at + 1 + c, at + 1 + b) for at, h in zip(marks.tolist(), texts, strict=False) for a, c, b in passages.compact_windows(h, 46)]
