"""Side tables of checked size.

Class statistics, thresholds and vocabularies are small by nature, but nothing guarantees it
for a given input. ``fetch_small`` reads at most ``limit`` rows; only a table that fits is
broadcast, a larger one takes an ordinary shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_TABLE_ROWS = 100_000


def fetch_table(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> pa.Table | None:
    """The rows of ``df`` as an Arrow table if there are at most ``limit``, else None."""
    table = df.limit(limit + 1).toArrow()
    return table if table.num_rows <= limit else None


def fetch_small(df: DataFrame, limit: int = SMALL_TABLE_ROWS) -> DataFrame | None:
    """``df`` as a local table if it has at most ``limit`` rows, else None."""
    table = fetch_table(df, limit)
    return None if table is None else df.sparkSession.createDataFrame(table, schema=df.schema)


def attach(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    limit: int = SMALL_TABLE_ROWS,
) -> DataFrame:
    """Join ``small`` to ``big``: broadcast when its size is proven, shuffle join otherwise."""
    local = fetch_small(small, limit)
    if local is None:
        return big.join(small, list(on), how)
    return big.join(F.broadcast(local), list(on), how)
