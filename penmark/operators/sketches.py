"""Mergeable sketches: quantiles and distinct words that are stored once and united for any grouping.

A sketch per finest group (split and class, say) is a small binary column. Coarser levels unite
sketches instead of reading texts again. Exact results remain the default; for quantiles, sketches
only narrow the interval that is then searched exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.bounded import attach
from penmark.functions.tokens import alpha_tokens
from penmark.session import materialise

# Size of a quantile sketch, and the rank error that it keeps with 99 % confidence.
QUANTILE_K = 4096
RANK_ERROR = 2.296 / QUANTILE_K**0.9021
# Ranks read off a sketch at a time, and how far around a wanted rank the search begins.
GRID = 1000
MARGIN = 3 * RANK_ERROR
# Values of a group that one task may rank at the end.
RANKED = 200_000

# Base-2 logarithm of the buckets of a distinct count, and its relative standard error.
DISTINCT_LG_K = 14
DISTINCT_ERROR = 1.04 / 2 ** (DISTINCT_LG_K / 2)


def finite(value: Column) -> Column:
    """The value as a double, null if it is not finite."""
    x = value.cast("double")
    return F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x)


def quantile_sketches(df: DataFrame, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by, sketch): quantile sketches of the finite values of each group, built where rows are."""
    return (
        df.select(*by, finite(value).alias("_x"))
        .groupBy(*by)
        .agg(F.kll_sketch_agg_double("_x", F.lit(QUANTILE_K)).alias("sketch"))
    )


def merged_quantiles(sketches: DataFrame, by: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(by, n, quantiles) of united sketches; each is a value whose rank is within ``RANK_ERROR``."""
    united = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("_s"))
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    some = F.col("n") > 0
    return united.withColumn("n", F.kll_sketch_get_n_double("_s")).select(
        *by, "n", F.when(some, F.kll_sketch_get_quantile_double("_s", wanted)).alias("quantiles")
    )


def _grid(sketch: str) -> Column:
    """Values at GRID + 1 evenly spaced ranks of a sketch that is not empty."""
    ranks = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, ranks))


def _narrowed(ranks: DataFrame, share_of: Column, share_to: Column) -> DataFrame:
    """Interval ends from the sketch ``_s`` for ranks between two shares of its rows."""
    low = F.floor((share_of - MARGIN) * GRID).cast("int")
    high = F.ceil((share_to + MARGIN) * GRID).cast("int")
    at = lambda i: F.get("_grid", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)))
    return (
        ranks.withColumn("_grid", _grid("_s"))
        .withColumn("_low", F.when(low > 0, at(low)).otherwise(F.col("_low")))
        .withColumn("_high", F.when(high < GRID, at(high)).otherwise(F.col("_high")))
        .drop("_grid", "_s")
    )


def exact_quantiles(
    df: DataFrame, value: Column, shares: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """(by, share, n, quantile): exact quantiles, linearly interpolated, of finite values.

    Sketches give an interval around each wanted rank. One pass counts the values below and inside;
    while more than ``RANKED`` are inside, values in the interval are sketched again, which narrows
    it about a hundredfold. Then the distinct values inside are ranked, so no task sorts a group. An
    interval that misses its rank, which the counts show, is widened to all values: the result does
    not depend on the sketch. The values alone are written once and read two or three times. Groups
    without a finite value are left out. Runs its jobs at once.
    """
    by = list(by)
    rows = materialise(
        df.select(*by, finite(value).alias("_x")).filter(F.col("_x").isNotNull()), "values"
    )
    groups = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("_x").alias("_least"),
        F.max("_x").alias("_most"),
        F.kll_sketch_agg_double("_x", F.lit(QUANTILE_K)).alias("_s"),
    )
    place = F.col("share") * (F.col("n") - 1)
    ranks = (
        groups.filter("n > 0")
        .withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("_r0", F.floor(place))
        .withColumn("_r1", F.least(F.col("_r0") + 1, F.col("n") - 1))
        .withColumn("_low", F.col("_least"))
        .withColumn("_high", F.col("_most"))
    )
    of_all = lambda rank: F.col(rank) / F.col("n")
    ranks = _narrowed(ranks, of_all("_r0"), (F.col("_r1") + 1) / F.col("n"))
    keys = [*by, "share"]
    ranks = materialise(ranks, "intervals")
    if ranks.isEmpty():
        return ranks.select(*keys, "n", F.lit(0.0).alias("quantile"))
    x, inside = F.col("_x"), F.col("_x").between(F.col("_low"), F.col("_high"))
    last = None
    while True:
        ranks = materialise(ranks, "intervals")
        counts = (
            _with_intervals(rows, ranks, by)
            .groupBy(*keys)
            .agg(F.count_if(x < F.col("_low")).alias("_below"), F.count_if(inside).alias("_inside"))
        )
        ranks = ranks.drop("_below", "_inside").join(counts, keys)
        hit = (F.col("_below") <= F.col("_r0")) & (F.col("_r1") < F.col("_below") + F.col("_inside"))
        whole = (F.col("_low") == F.col("_least")) & (F.col("_high") == F.col("_most"))
        ranks = materialise(ranks.withColumn("_hit", hit | whole), "intervals")
        large = F.col("_hit") & (F.col("_inside") > RANKED) & (F.col("_low") < F.col("_high"))
        open_now = ranks.agg(
            F.count_if(~F.col("_hit")).alias("missed"), F.sum(F.when(large, F.col("_inside"))).alias("large")
        ).first()
        if open_now["missed"]:
            for end, bound in (("_low", "_least"), ("_high", "_most")):
                ranks = ranks.withColumn(end, F.when(F.col("_hit"), F.col(end)).otherwise(F.col(bound)))
            continue
        # Equal values do not shrink any further; they are one row once collapsed.
        if not open_now["large"] or open_now["large"] == last:
            break
        last = open_now["large"]
        sketched = (
            _with_intervals(rows, ranks.filter(large), by)
            .filter(inside)
            .groupBy(*keys)
            .agg(F.kll_sketch_agg_double("_x", F.lit(QUANTILE_K)).alias("_s"))
        )
        within = lambda rank, extra: (F.col(rank) - F.col("_below") + extra) / F.col("_inside")
        narrower = _narrowed(ranks.filter(large).join(sketched, keys), within("_r0", 0), within("_r1", 1))
        ranks = ranks.filter(~large).unionByName(narrower)
    values = (
        _with_intervals(rows, ranks, by)
        .filter(inside)
        .groupBy(*keys, "n", "_r0", "_r1", "_below", "_x")
        .agg(F.count("*").alias("_weight"))
    )
    upto = F.sum("_weight").over(Window.partitionBy(*keys).orderBy("_x")) + F.col("_below")
    found = (
        values.withColumn("_seen", upto)
        .groupBy(*keys, "n", "_r0")
        .agg(
            F.min(F.when(F.col("_seen") > F.col("_r0"), x)).alias("_v0"),
            F.min(F.when(F.col("_seen") > F.col("_r1"), x)).alias("_v1"),
        )
    )
    part = place - F.col("_r0")
    return found.select(*keys, "n", (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * part).alias("quantile"))


def _with_intervals(rows: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each value once for every interval of its group."""
    if by:
        return attach(rows, ranks, by)
    # Without groups there is one interval a share.
    intervals = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.asDict().items()]) for r in ranks.collect()])
    return rows.select("_x", F.inline(intervals))


def vocabulary_sketches(
    df: DataFrame, by: Sequence[str], text_col: str = "text"
) -> DataFrame:
    """(by, sketch): distinct-count sketches of the letter-only words of each group."""
    words = F.explode_outer(F.array_distinct(alpha_tokens(F.col(text_col)))).alias("_word")
    return (
        df.select(*by, words).groupBy(*by).agg(F.hll_sketch_agg("_word", F.lit(DISTINCT_LG_K)).alias("sketch"))
    )


def merged_vocabulary(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, vocab): estimated distinct words of united sketches, whose relative standard error is
    ``DISTINCT_ERROR``. Words that groups share count once."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("vocab"))
