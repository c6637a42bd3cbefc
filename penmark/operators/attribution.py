"""Contributions of features to the class scores of a linear model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.bounded import attach


def long_features(
    df: DataFrame, ids: Sequence[str], feature_col: str = "features"
) -> DataFrame:
    """(ids, feature, x) from an array of features."""
    return df.select(
        *ids, F.posexplode_outer(feature_col).alias("feature", "x")
    ).filter(F.col("feature").isNotNull())


def background_means(features: DataFrame) -> DataFrame:
    return features.groupBy("feature").agg(F.avg("x").alias("mean"))


def linear_attribution(
    features: DataFrame, coefficients: DataFrame, background: DataFrame
) -> DataFrame:
    """Every row's contribution per class and feature: coefficient times (x - background mean).

    ``coefficients`` is (class, feature, coef), ``background`` is (feature, mean).
    """
    side = coefficients.join(background, "feature")
    return attach(features, side, ["feature"]).select(
        *[c for c in features.columns if c not in ("feature", "x")],
        "class",
        "feature",
        (F.col("coef") * (F.col("x") - F.col("mean"))).alias("contribution"),
    )


def attribution_arrays(
    df: DataFrame,
    coefficients: DataFrame,
    background: DataFrame,
    ids: Sequence[str],
    feature_col: str = "features",
) -> DataFrame:
    """(ids, class, contributions): one array per row and class, made inside the row.

    ``coefficients`` is (class, feature, coef) and ``background`` is (feature, mean), with features
    numbered from 0 without gaps. Only the model travels, one array per class; rows are neither
    exploded nor shuffled. A null array of features gives null, missing features too.
    """
    entry = F.struct("feature", "coef", "mean")
    model = (
        coefficients.join(background, "feature")
        .groupBy("class")
        .agg(F.sort_array(F.collect_list(entry)).alias("_model"))
    )
    classes = [r["class"] for r in model.select("class").collect()]
    wanted = coefficients.schema["class"].dataType
    named = df.select(
        *ids, F.col(feature_col).alias("_x"), F.explode(F.array(*[F.lit(c).cast(wanted) for c in classes])).alias("class")
    )
    return named.join(F.broadcast(model), "class").select(
        *ids,
        "class",
        F.when(
            F.col("_x").isNotNull(),
            F.zip_with("_model", "_x", lambda m, x: m["coef"] * (x - m["mean"])),
        ).alias("contributions"),
    )


def attribution_ranking(
    features: DataFrame, coefficients: DataFrame, background: DataFrame
) -> DataFrame:
    """Mean absolute contribution per class and feature.

    The coefficient is the same for all rows, so it leaves the mean: the rows are reduced to one
    mean absolute deviation per feature and never multiplied by the classes.
    """
    deviation = (
        attach(features, background, ["feature"])
        .groupBy("feature")
        .agg(F.avg(F.abs(F.col("x") - F.col("mean"))).alias("deviation"))
    )
    return coefficients.join(deviation, "feature").select(
        "class", "feature", (F.abs("coef") * F.col("deviation")).alias("importance")
    )
