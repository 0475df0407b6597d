"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, as rows of documents; the result is
written and read back before the next one starts, so no stage recomputes another.

Cases, in every stage: null texts are empty ones; rows with a null id are kept unless toxic, copies of one another or
empty after cuts; repeated rows are near copies, so one of them stays; columns beyond those of documents go along; an
empty table gives no rows. What each stage does with ties and very long texts is told by its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import mixing, packing, passages, simhash, toxicity
from veilframe.llm.common import save, table
from veilframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled ones among docs."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of 50 words or more stays in the first document that has it."""
    return passages.drop_repeated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to 5:2:1; a document taken several times is that many rows."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(save(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")), "pieces"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("passages", drop_repeated_passages), ("mixing", mix_sources), ("packing", pack)]

#: Tokens, trained weights and fingerprints are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
