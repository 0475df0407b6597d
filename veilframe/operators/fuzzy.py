"""Words and names that are alike: pairs above a similarity, without comparing all with all.

Similarity is 100 times the share of the letters of both texts that a longest common subsequence pairs off. To be that alike, at
most D letters of both may be left over, and each of them touches one place; so if one text is cut into D + 1 pieces, one of
them at least stands unchanged in the other, moved by D letters at most. Pieces are the keys of a join, and what meets is
compared. No pair is lost, at any similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(a: str, b: str) -> float:
    """100 times the share of the letters of both that a longest common subsequence pairs off."""
    if not a and not b:
        return 100.0
    # bits of `row` are the places of b that end a longer subsequence
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for c in a:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


def left_over(a: int, b: int, least: float) -> int:
    """Letters that two texts of a and b letters may have left over together."""
    return math.floor((a + b) * (100 - least) / 100 + 1e-9)


def lengths(n: int, least: float) -> range:
    """How long a text can be that is alike to one of n letters."""
    share = least / 100
    return range(max(1, math.ceil(n * share / (2 - share) - 1e-9)), math.floor(n * (2 - share) / share + 1e-9) + 1)


def pieces(n: int, count: int) -> list[tuple[int, int]]:
    """A text of n letters cut into so many stretches, none longer than another by more than a letter."""
    cuts = [n * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def cut_keys(text: str, least: float) -> Iterator[str]:
    """Keys of the side that is cut: for each length of the other side, its own length, the piece's number, the piece."""
    n = len(text)
    for m in lengths(n, least):
        d = left_over(n, m, least)
        # more pieces than letters: some are empty, and these stand anywhere
        for k, (a, b) in enumerate(pieces(n, d + 1)):
            if d + 1 <= n or a == b:
                yield f"{n}:{m}:{k}:{text[a:b]}"
                if a == b:
                    break


def met_keys(text: str, least: float) -> Iterator[str]:
    """Keys of the other side: the stretches of text where a piece may stand."""
    m = len(text)
    for n in lengths(m, least):
        d = left_over(n, m, least)
        for k, (a, b) in enumerate(pieces(n, d + 1)):
            if a == b:
                yield f"{n}:{m}:{k}:"
                break
            if d + 1 <= n:
                for at in range(max(0, a - d), min(m - (b - a), a + d) + 1):
                    yield f"{n}:{m}:{k}:{text[at : at + b - a]}"


def similar(left: DataFrame, l: str, right: DataFrame, r: str, least: float) -> DataFrame:  # noqa: E741
    """l, r, similarity of all pairs of distinct texts of both sides that are at least that alike (0 < least <= 100).

    Cases: nulls and empty texts are alike to none; equal texts are 100 alike; repeated rows count once; letters count as they
    are, case and accents too.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be above 0 and at most 100")

    def keyed(column: str, keys) -> callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for low in range(0, b.num_rows, 512):
                    text, key = [], []
                    for t in b.column(0).slice(low, 512).to_pylist():
                        own = set(keys(t, least))
                        key += own
                        text += [t] * len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(key, pa.string())], [column, "piece"])

        return run

    def sides(df: DataFrame, c: str, name: str, keys) -> DataFrame:
        return df.where(F.coalesce(F.col(c), F.lit("")) != "").select(F.col(c).alias(name)).distinct().mapInArrow(keyed(name, keys), f"{name} string, piece string")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, y, s) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (s := ratio(x, y)) >= least]
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["a_text", "b_text", "similarity"])

    met = sides(left, l, "a_text", met_keys).join(sides(right, r, "b_text", cut_keys), "piece").select("a_text", "b_text").distinct()
    return met.mapInArrow(compared, "a_text string, b_text string, similarity double").withColumnsRenamed({"a_text": l, "b_text": r})


#: A misread word has so many letters at least, is so alike to the ordinary one, at most so many letters longer or
#: shorter; or it is its beginning, but for so many letters.
MISREAD_LETTERS, MISREAD_LEAST, MISREAD_LONGER, CUT_OFF = 6, 86, 2, 4


def near_vocabulary(words: DataFrame, word: str, vocabulary: DataFrame, known: str) -> DataFrame:
    """word, meant: the ordinary word that a misread one stands for: one that begins with it, the shortest, else the most similar;
    ties to the first. Words are compared in lower case; words of the vocabulary stand for none."""
    w = words.select(F.lower(F.col(word)).alias("w")).where(F.char_length("w") >= MISREAD_LETTERS).distinct()
    v = vocabulary.select(F.lower(F.col(known)).alias("v")).where(F.coalesce("v", F.lit("")) != "").distinct()
    w = w.join(v, F.col("w") == F.col("v"), "left_anti")
    begun = v.select("v", F.explode(F.sequence(F.lit(1), F.lit(CUT_OFF))).alias("k")).where(F.char_length("v") - F.col("k") >= MISREAD_LETTERS).withColumn("w", F.left("v", F.char_length("v") - F.col("k")))
    first = w.join(begun, "w").groupBy("w").agg(F.min(F.struct("k", "v")).alias("x")).select("w", F.col("x.v").alias("cut_off"))
    close = similar(w, "w", v, "v", MISREAD_LEAST).where(F.abs(F.char_length("w") - F.char_length("v")) <= MISREAD_LONGER)
    best = close.groupBy("w").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "v")).alias("x")).select("w", F.col("x.v").alias("alike"))
    return first.join(best, "w", "full").select(F.col("w").alias(word), F.coalesce("cut_off", "alike").alias("meant"))
