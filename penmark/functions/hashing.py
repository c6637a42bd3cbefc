"""Seeded hashes that give every row a reproducible place in a random order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(seed: int, columns: Sequence[str | Column]) -> Column:
    """60 bits of the MD5 of seed and columns, as a non-negative long."""
    parts = [F.lit(str(seed))] + [
        (F.col(c) if isinstance(c, str) else c).cast("string") for c in columns
    ]
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HASH_BITS // 4)
    # Never null, which also keeps joins from adding a null check that hashes again.
    return F.coalesce(F.conv(digits, 16, 10).cast("bigint"), F.lit(0))


def hash_split(id_column: str | Column, seed: int = 42) -> Column:
    """train / val / test by an 80 / 10 / 10 hash of the identity."""
    key = F.col(id_column) if isinstance(id_column, str) else id_column
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10
    names = ["train"] * 8 + ["val", "test"]
    return F.get(F.array(*[F.lit(name) for name in names]), bucket.cast("int"))
