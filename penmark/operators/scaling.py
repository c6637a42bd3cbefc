"""Standardising feature columns with statistics of the training rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Standardiser:
    """Mean and population deviation per column; a constant column is only centred."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c) - F.lit(mean)) / F.lit(deviation)
                for c, mean, deviation in zip(self.columns, self.means, self.deviations)
            }
        )


def fit_standardiser(train: DataFrame, columns: Sequence[str]) -> Standardiser:
    """One aggregate over all columns; a single row of statistics comes back."""
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    deviations = [row[f"s{i}"] for i in range(len(columns))]
    # Rounding can leave a constant column with a tiny deviation instead of zero.
    safe = [
        d if d and d > 1e-12 * max(1.0, abs(m)) else 1.0 for d, m in zip(deviations, means)
    ]
    return Standardiser(tuple(columns), tuple(means), tuple(safe))


def standardise(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fit_standardiser(train, columns).transform(df)
