"""Stages from raw documents to packed training sequences, each applied to what the last kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penmark.llm.hdlang import keep_identified
from penmark.llm.mixing import mixed_documents
from penmark.llm.nearcopies import keep_one
from penmark.llm.packing import best_fit_pack
from penmark.llm.surrogates import without_private_data
from penmark.llm.workers import make_importable
from penmark.session import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no language learned from the labelled ones, go."""
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words and a likeness of 0.8, the document
    with the least id stays."""
    return keep_one(docs)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and credentials become surrogates; n_chars follows the text."""
    return without_private_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the number of passes that the mix of sources takes; the one at which the budget
    ends stays whole."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their places in sequences of 1024."""
    import public_tokenizers

    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii_surrogates", replace_private_data),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Tokenisers, fingerprints and keyed surrogates are beyond SQL; each stage is tested against a
# brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    make_importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
