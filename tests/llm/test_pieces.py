"""Ids by merges against the sentencepiece library, and against merging by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilframe.llm import pieces
from veilframe.llm.queries import op13_sentencepiece, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b", "▁", "a▁ b", "\n\t x", "\x00", "<s> </s> <unk> <0x0A>", "日本 ｆｕｌｌ ﬁ 🙂", "é é ​﻿", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 30_000, "word " * 40_000]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(PATH)


def test_odd_and_random_texts(vocabulary):
    rng = random.Random(3)
    letters = "ab e▁ \n\tthéß日<>0x\x00s.Ω🙂"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(3000)]
    for t in texts:
        assert vocabulary.encode(t) == vocabulary.library.encode(t), t[:80]


def test_the_agenda_equals_scanning_for_the_best_pair(vocabulary):
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("thersandio▁") for _ in range(rng.randint(1, 40)))
        symbols = list(text)
        while True:
            best = min(((vocabulary.cost[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in vocabulary.cost), default=None)
            if best is None:
                break
            i = best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert vocabulary.merged(text) == symbols
        assert vocabulary.part(text) == b"".join(vocabulary.together([text])) if 1 < len(text) <= pieces.SHORT else True


def test_memory_that_overflows_changes_nothing(vocabulary):
    small = pieces.Pieces(PATH)
    small.memory.most = small.bits.most = 3
    assert [small.encode(t) for t in ODD] == [vocabulary.encode(t) for t in ODD]


def test_tables(spark, vocabulary):
    rows = [(i, t, "ids", 1.5) for i, t in enumerate(ODD)] + [(None, None, None, None), (1, ODD[2], "x", 0.0), (1, ODD[2], "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, score double")
    got = pieces.encode(docs, PATH, decoded="back", every=1)
    assert got.columns == ["doc_id", "score", "ids", "agreed", "back"]
    want = sorted((repr(i), ",".join(map(str, vocabulary.library.encode(t or ""))), vocabulary.library.decode(vocabulary.library.encode(t or ""))) for i, t, *_ in rows)
    found = got.collect()
    assert all(r.agreed for r in found) and sorted((repr(r.doc_id), ",".join(map(str, r.ids)), r.back) for r in found) == want
    again = pieces.decode(got.drop("back"), PATH).select("ids", "text").collect()
    assert sorted((",".join(map(str, r.ids)), r.text) for r in again) == sorted(w[1:] for w in want)
    digest = got.where("doc_id = 2").select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("d")).first().d
    assert digest == hashlib.sha256(",".join(map(str, vocabulary.library.encode(ODD[2]))).encode()).hexdigest()
    assert pieces.encode(docs.where("false"), PATH).collect() == []
    assert {r.agreed for r in pieces.encode(docs, PATH).collect()} == {True, None}
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().text == ""


def test_the_query_has_every_text_compared(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_sentencepiece(spark, str(tmp_path)).collect()
    assert len(got) == len(ODD) + 1 and all(r.agreed is True for r in got)
