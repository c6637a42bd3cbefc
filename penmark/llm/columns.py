"""Keeping the columns of a caller apart from those that an operator makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def apart(df: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with every column but ``keep`` renamed, and a function that undoes it.

    The function takes a table that has all these columns and returns them alone, as they were.
    """
    names = df.columns
    inner = [n if n in keep else f"caller_column_{i}" for i, n in enumerate(names)]
    return df.toDF(*inner), lambda out: out.select(*inner).toDF(*names)
