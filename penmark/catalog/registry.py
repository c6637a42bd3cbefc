"""Registration of (query, reference SQL) pairs under one name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Sums of doubles depend on the order of addition in their last bits; computed doubles are
# compared to this many decimals.
DIGITS = 9


def register(name: str, query: Query, sql: str | None = None, doubles: Sequence[str] = ()):
    """Add a query; ``doubles`` names the columns to round on both sides."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = query(spark, sf_dir)
        return result.withColumns({c: F.round(c, DIGITS) for c in doubles}) if doubles else result

    QUERIES[name] = run
    if sql is not None:
        if doubles:
            rounded = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in doubles)
            sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
        ORACLES[name] = sql


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    def add(function: Query) -> Query:
        register(name, function, sql, doubles)
        return function

    return add
