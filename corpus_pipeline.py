"""Training corpus pipeline: quality, near and passage duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, mixing, packing, prob_minhash, quality, suffix_dedup
from quarry.llm.tokens import tokenizer_path

#: No source is repeated more often than this, and none loses a document.
MAX_REPEAT = 1.25
SEQUENCE_TOKENS = 1024


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (null ids and empty texts are scored like others)."""
    return quality.keep_quality(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of least id."""
    return prob_minhash.drop_near_duplicates(docs)


def repeated_passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes and more that occur earlier are cut out; every document stays."""
    return suffix_dedup.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, rarer sources up to ``MAX_REPEAT`` times as often."""
    block, at = common.fresh(docs.columns, "_block", "_place")
    return mixing.mix(docs, block=block, at=at, max_repeat=MAX_REPEAT, cover=True).select(*[f"`{c}`" for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), SEQUENCE_TOKENS).drop("n_pieces")


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicates_stage),
    ("suffix_array_dedup", repeated_passages_stage),
    ("temperature_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained network, hashed signatures and a public tokenizer are beyond SQL: tests/llm/test_pipeline.py
#: holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
