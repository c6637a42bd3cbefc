"""Row filters, exact deduplication, outlier removal and chunking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from penmark.bounded import attach
from penmark.constants import MAX_WORDS
from penmark.functions import words as w


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep ``columns`` and the rows where none of them is null."""
    return df.select(*columns).na.drop()


def filter_split(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    return df.filter(F.col(split_col) == split).drop(split_col)


def filter_finite_positive(df: DataFrame, column: str) -> DataFrame:
    """Rows with 0 < x < infinity; NaN sorts above infinity and is dropped with it."""
    return df.filter((F.col(column) > 0) & (F.col(column) < float("inf")))


def text_key(text_col: str) -> Column:
    """A 32-byte key that stands for a whole text in shuffles."""
    return F.unhex(F.sha2(F.col(text_col), 256))


def first_copies(
    df: DataFrame,
    ids: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    within: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Keys of the first row of every distinct text: ``within``, ``ids`` and ``keep`` columns.

    The smallest identity is found by a partial and a final aggregate over narrow rows, so a
    text that makes up a third of the corpus is reduced to one row per task before the shuffle.
    A numeric identity of one column takes a hash aggregate without sorting; the ``keep`` columns
    of the rows that it names follow by a join on the identity.
    """
    if len(ids) == 1 and isinstance(df.schema[ids[0]].dataType, NumericType):
        key = df.select(*within, text_key(text_col).alias("_key"), *ids)
        first = key.groupBy(*within, "_key").agg(F.min(ids[0]).alias(ids[0]))
        first = first.select(*within, *ids)
        rest = [c for c in keep if c not in within]
        return first.join(df.select(*ids, *rest), list(ids)) if rest else first
    key = df.select(*within, text_key(text_col).alias("_key"), F.struct(*ids, *keep).alias("_row"))
    first = key.groupBy(*within, "_key").agg(F.min("_row").alias("_row"))
    return first.select(*within, "_row.*")


def remove_duplicates(
    df: DataFrame,
    ids: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    within: Sequence[str] = (),
) -> DataFrame:
    """Keep the first row, by identity, of every distinct text; null texts equal each other.

    Rows return through a semi join on the identity, whose keys are unique and never skewed.
    ``within`` restricts the comparison to rows that agree on those columns.
    """
    kept = first_copies(df, ids, text_col, within).select(*ids)
    return df.join(kept, list(ids), "left_semi")


def value_counts(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """Collapse rows to (by, value, weight); integers collapse to very few rows.

    Null values keep a row of weight 0 instead of being filtered out: the optimiser would push
    the filter down to the rows and compute the value there a second time.
    """
    return (
        df.select(*by, value.alias("value"))
        .groupBy(*by, "value")
        .agg(F.count("value").alias("weight"))
    )


def remove_outliers_iqr(
    df: DataFrame,
    text_col: str = "text",
    within: Sequence[str] = (),
    factor: float = 1.5,
    approx: bool = False,
) -> DataFrame:
    """Keep texts whose word count lies within ``factor`` IQRs of the quartiles, inclusive."""
    count = w.word_count(F.col(text_col))
    quartile = F.percentile_approx if approx else F.percentile
    shares = F.array(F.lit(0.25), F.lit(0.75))
    if approx:
        bounds = (
            df.select(*within, count.alias("value")).groupBy(*within).agg(
                quartile("value", shares).cast("array<double>").alias("q")
            )
        )
    else:
        bounds = (
            value_counts(df, within, count)
            .groupBy(*within)
            .agg(quartile("value", shares, F.col("weight")).alias("q"))
        )
    spread = factor * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
    bounds = bounds.select(
        *within,
        (F.get("q", F.lit(0)) - spread).alias("_low"),
        (F.get("q", F.lit(1)) + spread).alias("_high"),
    )
    if within:
        bounded = attach(df, bounds, within)
        low, high = F.col("_low"), F.col("_high")
    else:
        row = bounds.first()
        bounded, low, high = df, F.lit(row["_low"]), F.lit(row["_high"])
    # The one-element array makes the words of a text be counted once for both comparisons.
    inside = F.exists(F.array(count), lambda n: n.between(low, high))
    return bounded.filter(inside).select(*df.columns)


def split_words(
    df: DataFrame, n: int = MAX_WORDS, text_col: str = "text", chunk_col: str = "chunk_no"
) -> DataFrame:
    """One row per ``n``-word chunk, numbered from 0; a blank text gives one null chunk."""
    others = [c for c in df.columns if c != text_col]
    return (
        df.withColumn("_words", w.words(F.col(text_col)))
        .select(*others, F.posexplode_outer(w.word_chunks(F.col("_words"), n)))
        .select(
            *others,
            F.coalesce("pos", F.lit(0)).alias(chunk_col),
            F.col("col").alias(text_col),
        )
    )
