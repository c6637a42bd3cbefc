"""Arithmetic on embeddings held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    squares = F.aggregate(
        a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null when either has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pad_embedding(embedding: Column, multiple: int = 8) -> Column:
    """Zeros appended until the width is a multiple of ``multiple``."""
    missing = F.pmod(-F.size(embedding), F.lit(multiple)).cast("int")
    return F.concat(embedding, F.array_repeat(F.lit(0.0).cast("float"), missing))
