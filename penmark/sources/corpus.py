"""Parquet corpora: one folder or file per split, or one table partitioned by split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The split names and the two published column layouts.
SPLITS = ("train", "val", "test")
CANONICAL = {"generation": "text", "model": "generated_by"}


def load_splits(
    spark: SparkSession,
    root: str,
    splits: Sequence[str] = SPLITS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Stack ``root/<split>/`` Parquet folders, each row tagged with its split."""
    parts = [
        spark.read.parquet(f"{root}/{split}").withColumn("split", F.lit(split))
        for split in splits
    ]
    stacked = union_splits(parts)
    return select_columns(stacked, [*columns, "split"]) if columns else stacked


def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_corpus``; a filter on ``split`` prunes whole folders."""
    return spark.read.parquet(path)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to keep; the Parquet scan reads no others."""
    return df.select(*columns)


def harmonise_schema(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Bring either published layout to (text, generated_by), plus ``keep``."""
    return df.withColumnsRenamed(CANONICAL).select(*keep, "text", "generated_by")


def write_corpus(
    df: DataFrame, path: str, split_col: str = "split", mode: str = "errorifexists"
) -> None:
    """Save as Parquet with one folder per split. ``path`` must not be the input of ``df``."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)
