"""Gaussian kernel density per class, evaluated on a grid.

Values are collapsed to (class, value, weight) first. Integer measures then have few rows, so
the number of kernel evaluations does not depend on the number of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.bounded import attach
from penmark.constants import (
    DENSITY_CLIP,
    DENSITY_FACTOR,
    DENSITY_POINTS,
    DENSITY_SAMPLE,
    LENGTH_DENSITY_POINTS,
    SEED,
)
from penmark.operators.cleaning import filter_finite_positive, value_counts
from penmark.operators.sampling import sample_per_class
from penmark.operators.sketches import exact_quantiles
from penmark.session import materialise


def _moments(counts: DataFrame, class_col: str, top: Column) -> DataFrame:
    """Size, range and sample deviation of every class, from the collapsed values."""
    x, weight = F.col("value").cast("double"), F.col("weight")
    n = F.sum("weight")
    spread = F.sum(x * x * weight) - F.pow(F.sum(x * weight), F.lit(2)) / n
    return counts.groupBy(class_col).agg(
        n.alias("_n"),
        F.min(x).alias("_min"),
        F.max(x).alias("_max"),
        top.alias("_top"),
        F.sqrt(F.greatest(F.try_divide(spread, n - 1), F.lit(0.0))).alias("_std"),
    )


def _evaluate(
    counts: DataFrame,
    moments: DataFrame,
    class_col: str,
    low: Column,
    high: Column,
    bandwidth: Column,
    points: int,
) -> DataFrame:
    grid = moments.select(
        class_col, "_n", low.alias("_low"), high.alias("_high"), bandwidth.alias("_bw")
    ).filter((F.col("_n") > 1) & (F.col("_bw") > 0))
    step = (F.col("_high") - F.col("_low")) / (points - 1)
    at = F.col("_low") + F.col("point") * step
    z = (F.col("x") - F.col("value")) / F.col("_bw")
    return (
        counts.join(grid, class_col)
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", at)
        .groupBy(class_col, "point", "x", "_n", "_bw")
        .agg(F.sum(F.col("weight") * F.exp(-0.5 * z * z)).alias("_sum"))
        .select(
            class_col,
            "point",
            "x",
            (F.col("_sum") / (F.col("_n") * F.col("_bw") * F.sqrt(2 * F.pi()))).alias("density"),
        )
    )


def class_density(
    df: DataFrame,
    value_col: str,
    class_col: str = "generated_by",
    ids: tuple[str, ...] = ("doc_id",),
    sample: int | None = DENSITY_SAMPLE,
    factor: float = DENSITY_FACTOR,
    points: int = DENSITY_POINTS,
    clip: float = DENSITY_CLIP,
    seed: int = SEED,
) -> DataFrame:
    """Density of a positive measure from the minimum to a high percentile of each class.

    The bandwidth is ``factor`` sample deviations. ``sample`` rows per class are used, as in the
    published plots; None takes all.
    """
    rows = df.filter(F.col(class_col).isNotNull()).select(class_col, *ids, value_col)
    # Values are computed from the texts once, before any filter on them; the rest rereads them.
    data = filter_finite_positive(materialise(rows, "density"), value_col)
    if sample is not None:
        data = sample_per_class(data, sample, class_col, ids, seed=seed)
    counts = value_counts(data, [class_col], F.col(value_col))
    moments = _moments(counts, class_col, F.percentile("value", F.lit(clip), F.col("weight")))
    return _evaluate(
        counts,
        moments,
        class_col,
        F.col("_min"),
        F.col("_top"),
        factor * F.col("_std"),
        points,
    )


def length_density(
    df: DataFrame, value_col: str, class_col: str = "generated_by", points: int = LENGTH_DENSITY_POINTS
) -> DataFrame:
    """Density over all rows: Scott bandwidth, grid half a range beyond both ends."""
    counts = value_counts(df.filter(F.col(class_col).isNotNull()), [class_col], F.col(value_col))
    moments = _moments(counts, class_col, F.lit(None).cast("double"))
    half = 0.5 * (F.col("_max") - F.col("_min"))
    return _evaluate(
        counts,
        moments,
        class_col,
        F.col("_min") - half,
        F.col("_max") + half,
        F.pow(F.col("_n").cast("double"), F.lit(-0.2)) * F.col("_std"),
        points,
    )


# Bins in a bandwidth, and bandwidths beyond which a kernel counts as nothing (exp(-32)).
BINS_PER_BANDWIDTH = 64
REACH = 8
# A binned density differs from the exact one by at most this share of the peak of one kernel: the
# kernel is interpolated linearly between bins, whose error is its largest second derivative times
# the squared bin width over eight.
BINNING_ERROR = 1.0 / (8 * BINS_PER_BANDWIDTH**2)


def binned_density(
    df: DataFrame,
    value_col: str,
    class_col: str = "generated_by",
    factor: float = DENSITY_FACTOR,
    points: int = DENSITY_POINTS,
    clip: float = DENSITY_CLIP,
) -> DataFrame:
    """``class_density`` over all rows of a continuous measure, with ``error``, a bound on how far the
    density is from the exact one.

    Every value is dealt to the two bins around it, in proportion, where rows are; so at most some
    ten thousand sums a class are shuffled, as the percentile is at most ten deviations from the mean.
    No class is sorted or held in a buffer: the percentile is exact and comes from sketches. Values
    are written once. Rows without a class and values that are not positive and finite are left out.
    """
    rows = df.filter(F.col(class_col).isNotNull()).select(class_col, F.col(value_col).cast("double").alias("value"))
    data = filter_finite_positive(materialise(rows, "density"), "value")
    top = exact_quantiles(data, F.col("value"), [clip], [class_col]).select(class_col, F.col("quantile").alias("_top"))
    x = F.col("value")
    # Sums of squares around a value of the class, so that no digits are lost.
    centre = data.groupBy(class_col).agg(F.avg("value").alias("_mean"), F.min("value").alias("_min"))
    around = attach(data, centre, [class_col]).groupBy(class_col, "_min").agg(
        F.count("*").alias("_n"),
        F.sum((x - F.col("_mean")) * (x - F.col("_mean"))).alias("_squares"),
    )
    grid = materialise(
        around.join(top, class_col)
        .withColumn("_bw", factor * F.sqrt(F.try_divide(F.col("_squares"), F.col("_n") - 1)))
        .filter((F.col("_n") > 1) & (F.col("_bw") > 0)),
        "density-grid",
    )
    width = F.col("_bw") / BINS_PER_BANDWIDTH
    place = (x - F.col("_min")) / width
    inside = x <= F.col("_top") + REACH * F.col("_bw")
    bins = (
        attach(data, grid, [class_col])
        .filter(inside)
        .select(class_col, "_min", "_bw", F.floor(place).alias("_bin"), (place - F.floor(place)).alias("_part"))
        .groupBy(class_col, "_min", "_bw", "_bin")
        .agg(F.count("*").alias("_rows"), F.sum("_part").alias("_next"))
    )
    shares = F.array(
        F.struct(F.col("_bin").alias("bin"), (F.col("_rows") - F.col("_next")).alias("mass")),
        F.struct((F.col("_bin") + 1).alias("bin"), F.col("_next").alias("mass")),
    )
    counts = (
        bins.select(class_col, "_min", "_bw", F.inline(shares))
        .groupBy(class_col, "_min", "_bw", "bin")
        .agg(F.sum("mass").alias("weight"))
        .select(class_col, (F.col("_min") + F.col("bin") * width).alias("value"), "weight")
    )
    curves = _evaluate(counts, grid, class_col, F.col("_min"), F.col("_top"), F.col("_bw"), points)
    peaks = grid.select(class_col, (BINNING_ERROR / (F.col("_bw") * F.sqrt(2 * F.pi()))).alias("error"))
    return curves.join(peaks, class_col)
