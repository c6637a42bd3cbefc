"""Embeddings kept as a Parquet table by encoder and split."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.operators.cleaning import text_key
from penmark.session import materialise, path_exists, remove_path

# Folders that the vectors of an encoder and split are dealt into; an update rewrites only those
# that it touches.
SHARDS = 64


def write_embeddings(
    df: DataFrame, path: str, encoder: str, mode: str = "append", split_col: str = "split"
) -> None:
    """Add the vectors of one encoder; encoder and split become folders."""
    df.withColumn("encoder", F.lit(encoder)).write.mode(mode).partitionBy(
        "encoder", split_col
    ).parquet(path)


def read_embeddings(
    spark: SparkSession, path: str, encoder: str | None = None, split: str | None = None
) -> DataFrame:
    """Stored vectors; encoder and split select folders before anything is read."""
    df = spark.read.parquet(path)
    if encoder is not None:
        df = df.filter(F.col("encoder") == encoder)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


def update_embeddings(
    df: DataFrame,
    path: str,
    encoder: str,
    encode: Callable[[DataFrame], DataFrame],
    ids: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    split_col: str = "split",
) -> int:
    """Bring the store up to date with ``df`` and return how many rows had to be encoded.

    Rows whose identity, split and text are in the store already are skipped; ``encode`` gets the
    others and adds the column ``embedding``. A row whose text or split changed replaces its old
    vector. Rows that ``df`` lacks stay. A text is known by its hash; null texts equal each other.
    New vectors are written to the scratch folder first, then the folders that they or their old
    vectors lie in are overwritten, each at once; readers of other folders notice nothing.
    """
    spark, ids = df.sparkSession, list(ids)
    layout = ["encoder", split_col, "shard"]
    asked = df.withColumns(
        {
            "text_hash": F.coalesce(text_key(text_col), F.unhex(F.lit(""))),
            "shard": F.pmod(F.xxhash64(*ids), F.lit(SHARDS)).cast("int"),
        }
    )
    known = path_exists(spark, path)
    if known:
        stored = spark.read.parquet(path).filter(F.col("encoder") == encoder)
        same = stored.select(*ids, split_col, "text_hash")
        asked = asked.join(same, [*ids, split_col, "text_hash"], "left_anti")
    columns = [*ids, "text_hash", "embedding", "encoder", split_col, "shard"]
    new = materialise(encode(asked).withColumn("encoder", F.lit(encoder)).select(*columns), "vectors")
    encoded = new.count()
    if not encoded:
        return 0
    kept = new.limit(0)
    replaced = set()
    if known:
        old = stored.join(new.select(*ids), ids, "left_semi")
        # At most SHARDS folders for each split.
        touched = old.select(*layout).union(new.select(*layout)).distinct()
        replaced = {tuple(r) for r in old.select(split_col, "shard").distinct().collect()}
        kept = materialise(
            stored.join(F.broadcast(touched), layout, "left_semi").join(new.select(*ids), ids, "left_anti").select(*columns),
            "kept-vectors",
        )
    rows = kept.unionByName(new)
    written = {tuple(r) for r in rows.select(split_col, "shard").distinct().collect()}
    # Folders that nothing is left in go first: a row lost with them would be encoded again.
    for split, shard in replaced - written:
        remove_path(spark, f"{path}/encoder={encoder}/{split_col}={split}/shard={shard}")
    (
        rows.repartition(*layout)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*layout)
        .parquet(path)
    )
    return encoded
