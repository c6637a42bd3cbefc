"""Registered queries of the pipeline operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.llm import egojoin, filteraudit, licenses, maxscore, mixing
from penmark.llm.workers import make_importable
from penmark.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_rans_token_file")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from penmark.llm.tokenfile import read_token_file, write_token_file

    path = new_path(spark, "token-file")
    write_token_file(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json")
    )
    return read_token_file(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from penmark.llm.packing import best_fit_pack

    return best_fit_pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query("op6_bitsliced_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penmark.llm.bitsliced import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_ego_join", egojoin.SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_hyperdimensional_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penmark.llm.hdlang import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


@query("op4_weighted_fair_mix", mixing.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


@query("op5_simhash_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penmark.llm.simhash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op1_surrogates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penmark.llm.surrogates import replace_entities

    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op8_license_rules", licenses.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_hashed_maxent")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penmark.llm.maxent import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", filteraudit.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op12_maxscore_top_k", maxscore.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search_embeddings(table(spark, sf_dir, "embeddings"))


@query("op13_spelling_variants")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from penmark.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))
