"""Connected components of a graph given by its edges, by alternating star contractions.

Each round links the larger neighbours of a node to its smallest neighbour, then does the same
with the smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
longest path. Only edges move, minima are aggregated before the shuffle, and each round is a table
of the shared folder, so a lost executor costs its own tasks. Nothing is collected but two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.session import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        both.filter("b > a")
        .join(smallest, "a")
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(smallest, "a")
    rest = linked.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(smallest.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b) of longs; component is its least node.

    Loops, nulls and repeated edges are ignored; a node without other neighbours has no row.
    """
    edges = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges, before = materialise(edges.distinct(), "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        edges = materialise(_small_star(_large_star(edges)), "edges")
