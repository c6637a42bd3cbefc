"""Exact nearest vectors by cosine without comparing all pairs.

Vectors are dealt into cells around k-means centroids. By the triangle inequality of angles, a
vector of a cell is at least as far from a query as the distance of the query to the centroid
differs from its own; the least and the largest own distance of a cell bound all its vectors. A
query first meets its nearest cells, as many as hold ``top_k`` vectors, which gives it a limit; then
every other cell whose bound is within the limit. So no neighbour is lost however the centroids lie:
they only decide how many cells are skipped.

Queries and vectors meet by cell inside executors. Large cells are split into shards, queries go to
all of them; a task holds one shard and streams its queries. Centroids and bounds of cells are the
only tables that all tasks get, at most ``MOST_CELLS`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.session import materialise

MOST_CELLS = 4096
# Vectors that the centroids are fitted on, about; all vectors are indexed.
FIT_VECTORS = 200_000
SHARD = 16_384
BATCH_CELLS = 1 << 21
# Cosines count as equal if they agree to this many decimals; angles, which near 0 lose half of the
# digits, get some slack.
DIGITS = 12
SLACK = 1e-5


@dataclass
class VectorIndex:
    """``vectors`` are a written table (cell, shard, id, unit); the rest has one entry a cell."""

    vectors: DataFrame
    centroids: np.ndarray
    rows: np.ndarray
    shards: np.ndarray
    nearest: np.ndarray  # least and largest angle to the centroid
    farthest: np.ndarray


def _unit_vectors(df: DataFrame, id_col: str, embedding_col: str) -> DataFrame:
    """(id, unit) of vectors that have a direction: not null, finite, and not of length zero."""
    x = F.transform(embedding_col, lambda v: v.cast("double"))
    # Divided by the largest component first, so that squares neither overflow nor vanish.
    top = F.aggregate(x, F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))
    scaled = F.transform(x, lambda v: v / F.col("_top"))
    length = F.sqrt(F.aggregate("_scaled", F.lit(0.0), lambda s, v: s + v * v))
    return (
        df.select(F.col(id_col).alias("id"), embedding_col)
        .filter(F.col("id").isNotNull() & F.coalesce(F.forall(x, lambda v: v.isNotNull()), F.lit(False)))
        .withColumn("_top", top)
        .filter((F.col("_top") > 0) & (F.col("_top") < float("inf")))
        .withColumn("_scaled", scaled)
        .withColumn("_length", length)
        .select("id", F.transform("_scaled", lambda v: v / F.col("_length")).alias("unit"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _angles(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centroids.T, -1.0, 1.0))


def _fit_centroids(units: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    share = min(1.0, FIT_VECTORS / n)
    chosen = units.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    model = KMeans(k=max(2, cells), maxIter=10, seed=seed, initMode="random", distanceMeasure="cosine").fit(
        chosen.select(array_to_vector("unit").alias("features"))
    )
    centers = np.array([c / (np.linalg.norm(c) or 1.0) for c in model.clusterCenters()])
    return centers[np.linalg.norm(centers, axis=1) > 0]


def build_index(
    docs: DataFrame,
    doc_id: str = "vec_id",
    embedding_col: str = "embedding",
    cells: int | None = None,
    seed: int = 42,
) -> VectorIndex | None:
    """Cells of all vectors that have a direction, None if there is no such vector.

    All vectors have the same number of components. Runs its jobs at once and writes the unit
    vectors twice.
    """
    units = materialise(_unit_vectors(docs, doc_id, embedding_col), "units")
    n = units.count()
    if n == 0:
        return None
    cells = min(MOST_CELLS, n, cells or math.ceil(math.sqrt(n)))
    centroids = _fit_centroids(units, n, cells, seed)
    schema = T.StructType([*units.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            angles = _angles(_matrix(batch.column(1)), centroids)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell, pa.int32()), pa.array(angles[np.arange(len(cell)), cell])],
                names=schema.names,
            )

    placed = materialise(units.mapInArrow(assign, schema), "cells")
    bounds = (
        placed.groupBy("cell")
        .agg(F.count("*").alias("n"), F.min("angle").alias("nearest"), F.max("angle").alias("farthest"))
        .toArrow()
    )
    at = bounds.column("cell").to_numpy()
    rows = np.zeros(len(centroids), np.int64)
    nearest, farthest = np.full(len(centroids), np.inf), np.full(len(centroids), -np.inf)
    rows[at] = bounds.column("n").to_numpy()
    nearest[at], farthest[at] = bounds.column("nearest").to_numpy(), bounds.column("farthest").to_numpy()
    shards = -(-rows // SHARD)
    # Large cells are split by a hash of the id, which copies of one vector do not share.
    in_cell = F.element_at(F.lit(shards.tolist()), F.col("cell") + 1)
    vectors = placed.select(
        "cell", F.pmod(F.xxhash64("id"), in_cell).cast("int").alias("shard"), "id", "unit"
    )
    return VectorIndex(vectors, centroids, rows, shards, nearest, farthest)


def _visits(index: VectorIndex, queries: DataFrame, top_k: int, limited: bool) -> DataFrame:
    """(cell, shard, id, unit, limit): the shards that a query meets.

    First its nearest cells, as many as hold top_k vectors; with ``limited``, given the angle of its
    k-th neighbour among those, all others that may hold a nearer vector.
    """
    id_type = queries.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("cell", T.IntegerType()),
            T.StructField("shard", T.IntegerType()),
            T.StructField("id", id_type),
            T.StructField("unit", T.ArrayType(T.DoubleType())),
            T.StructField("limit", T.DoubleType()),
        ]
    )
    centroids, rows, shards = index.centroids, index.rows, index.shards
    nearest, farthest = index.nearest, index.farthest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                angles = _angles(_matrix(part.column(1)), centroids)
                limits = part.column(2).to_numpy(zero_copy_only=False)
                order = np.argsort(np.where(rows > 0, angles, np.inf), axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                home = np.zeros(angles.shape, bool)
                np.put_along_axis(home, order, before < top_k, axis=1)
                home &= rows > 0
                if limited:
                    bound = np.maximum(np.maximum(angles - farthest, nearest - angles), 0.0)
                    chosen = ~home & (bound <= limits[:, None] + SLACK) & (rows > 0)
                else:
                    chosen = home
                query, cell = np.nonzero(chosen)
                query, cell = np.repeat(query, shards[cell]), np.repeat(cell, shards[cell])
                first = np.ones(len(cell), bool)
                first[1:] = (query[1:] != query[:-1]) | (cell[1:] != cell[:-1])
                starts = np.flatnonzero(first)
                shard = np.arange(len(cell)) - np.repeat(starts, np.diff(np.append(starts, len(cell))))
                take = pa.array(query)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell, pa.int32()),
                        pa.array(shard, pa.int32()),
                        part.column(0).take(take),
                        part.column(1).take(take),
                        part.column(2).take(take),
                    ],
                    names=schema.names,
                )

    return queries.select("id", "unit", "limit").mapInArrow(run, schema)


def _compare(index: VectorIndex, visits: DataFrame, query_type, top_k: int) -> DataFrame:
    """(query, id, cosine): of each visited shard the top_k and their ties, within the limit."""
    id_type = index.vectors.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("query", query_type), T.StructField("id", id_type), T.StructField("cosine", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ids, matrix = None, [], None, None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if tuple(place[start, :2]) != at:
                    at, held, ids, matrix = tuple(place[start, :2]), [], None, None
                if place[start, 2] == 0:
                    held.append((part.column(3), _matrix(part.column(5))))
                    continue
                if matrix is None:
                    if not held:
                        continue
                    ids = pa.concat_arrays([x for x, _ in held])
                    matrix, held = np.concatenate([x for _, x in held]), []
                step = max(1, BATCH_CELLS // len(matrix))
                for low in range(0, len(part), step):
                    yield scored(part.slice(low, step), ids, matrix)

    def scored(part: pa.RecordBatch, ids: pa.Array, matrix: np.ndarray) -> pa.RecordBatch:
        cosines = np.round(np.clip(_matrix(part.column(5)) @ matrix.T, -1.0, 1.0), DIGITS)
        least = np.cos(np.minimum(part.column(6).to_numpy(zero_copy_only=False) + SLACK, math.pi)) - SLACK
        if top_k < len(matrix):
            kth = np.partition(cosines, len(matrix) - top_k, axis=1)[:, len(matrix) - top_k]
            least = np.maximum(least, kth)
        query, doc = np.nonzero(cosines >= least[:, None])
        return pa.RecordBatch.from_arrays(
            [part.column(4).take(pa.array(query)), ids.take(pa.array(doc)), pa.array(cosines[query, doc])],
            names=schema.names,
        )

    nothing = F.lit(None)
    vectors = index.vectors.select(
        "cell", "shard", F.lit(0).alias("kind"), "id", nothing.cast(query_type).alias("query"), "unit",
        nothing.cast("double").alias("limit"),
    )
    asked = visits.select(
        "cell", "shard", F.lit(1).alias("kind"), nothing.cast(id_type).alias("id"), F.col("id").alias("query"),
        "unit", "limit",
    )
    return (
        vectors.union(asked)
        .repartition("cell", "shard")
        .sortWithinPartitions("cell", "shard", "kind")
        .mapInArrow(run, schema)
    )


def _ranked(found: DataFrame, top_k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


@dataclass
class Neighbours:
    """``rows`` are the result; ``visits`` a written table of all (cell, shard, id) that were met."""

    rows: DataFrame
    visits: DataFrame | None

    def compared_pairs(self, index: VectorIndex) -> int:
        """Pairs of a query and a vector whose cosine was taken."""
        if self.visits is None:
            return 0
        sizes = F.element_at(F.lit(index.rows.tolist()), F.col("cell") + 1)
        return self.visits.filter("shard = 0").agg(F.sum(sizes)).first()[0] or 0


def search_index(
    index: VectorIndex | None,
    queries: DataFrame,
    top_k: int,
    query_id: str = "query_id",
    embedding_col: str = "embedding",
    doc_id: str = "vec_id",
) -> Neighbours:
    """The ``top_k`` vectors of each query with the largest cosine: query_id, doc_id, cosine, rank.

    Ties, cosines that agree to twelve decimals, go to the smaller id. Queries and vectors without a
    direction take no part. A query with fewer vectors than ``top_k`` gets all of them. Ids of
    queries tell them apart.
    """
    asked = _unit_vectors(queries, query_id, embedding_col)
    names = [F.col("query").alias(query_id), F.col("id").alias(doc_id), "cosine", "rank"]
    if index is None:
        empty = queries.limit(0).select(
            F.col(query_id).alias("query"), F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")
        )
        return Neighbours(empty.select(*names), None)
    asked = materialise(asked.withColumn("limit", F.lit(math.pi)), "queries")
    query_type = asked.schema["id"].dataType
    home = materialise(_visits(index, asked, top_k, limited=False), "home-visits")
    near = materialise(_ranked(_compare(index, home, query_type, top_k), top_k), "near")
    # The k-th cosine among the nearest cells; fewer vectors than top_k set no limit.
    kth = F.when(F.count("*") >= top_k, F.acos(F.min("cosine"))).otherwise(math.pi)
    limits = near.groupBy(F.col("query").alias("id")).agg(kth.alias("limit"))
    limited = asked.drop("limit").join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(math.pi)))
    others = materialise(_visits(index, limited, top_k, limited=True), "other-visits")
    found = near.select("query", "id", "cosine").union(_compare(index, others, query_type, top_k))
    visits = home.select("cell", "shard", "id").union(others.select("cell", "shard", "id"))
    return Neighbours(_ranked(found, top_k).select(*names), visits)


def nearest_vectors(
    docs: DataFrame,
    queries: DataFrame,
    top_k: int,
    doc_id: str = "vec_id",
    query_id: str = "query_id",
    embedding_col: str = "embedding",
    cells: int | None = None,
) -> DataFrame:
    """Build the index and search it; see ``build_index`` and ``search_index``."""
    index = build_index(docs, doc_id, embedding_col, cells)
    return search_index(index, queries, top_k, query_id, embedding_col, doc_id).rows
