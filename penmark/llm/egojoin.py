"""Epsilon grid order join of embedding vectors by cosine, per label.

Cosine at least t is a distance of at most eps = sqrt(2 - 2t) between unit vectors, and projecting
on orthonormal directions never lengthens a distance. Vectors are sorted by the cells, eps wide, of
their leading principal coordinates, and the order is cut into blocks. Pairs of blocks whose boxes
of coordinates are at most eps apart are joined: halves of both intervals recursively, skipping
those that are provably distant, down to a product of small matrices. Equal vectors collapse first
and count with their number. A pair of blocks returns sums and links that span its groups, never
the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.components import connected_components
from penmark.session import materialise

THRESHOLD = 0.98
GRID_DIMENSIONS = 6
BLOCK = 1024
LEAF = 128
# Added to eps, so that rounding never skips a pair that the exact test would accept.
SLACK = 1e-9


def _moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """Second moments of the unit vectors; dim x dim sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            unit = _unit(batch.column(0), dim)
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["place", "value"]
        )

    sums = (
        vectors.select("vector")
        .mapInArrow(run, "place long, value double")
        .groupBy("place")
        .agg(F.sum("value").alias("value"))
        .toArrow()
    )
    out = np.zeros(dim * dim)
    out[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(dim, dim)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # squares neither over- nor underflow
    return values / np.sqrt((values * values).sum(axis=1))[:, None]


def _blocks(vectors: DataFrame, dim: int, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Rows of at most ``block`` vectors that follow each other in epsilon grid order."""
    count = axes.shape[1]
    cells = [f"c{k}" for k in range(count)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.floor(_unit(batch.column(3), dim) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(spots[:, k]) for k in range(count))],
                names=["label", "node", "n", "vector", *cells],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        rest = None
        batches = iter(batches)
        while True:
            batch = next(batches, None)
            if batch is not None:
                rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if rest is None or not len(rest):
                return
            labels = rest.column("label").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)]])
            cuts = sorted({c for a, b in zip(edges, edges[1:]) for c in range(a, b, block)} | {len(labels)})
            spare = cuts.pop(-2) if batch is not None else None  # the last block may still grow
            if spare is not None:
                cuts[-1] = spare
            for a, b in zip(cuts, cuts[1:]):
                part = rest.slice(a, b - a)
                unit = _unit(part.column("vector").combine_chunks(), dim)
                spots = unit @ axes
                yield pa.RecordBatch.from_pydict(
                    {
                        "label": part.column("label").slice(0, 1).to_pylist(),
                        "block": [name],
                        "low": [spots.min(axis=0).tolist()],
                        "high": [spots.max(axis=0).tolist()],
                        "nodes": [part.column("node").to_numpy().astype("<i8").tobytes()],
                        "weights": [part.column("n").to_numpy().astype("<i8").tobytes()],
                        "units": [unit.astype("<f8").tobytes()],
                    },
                    schema=pa.schema(
                        [
                            ("label", pa.int64()),
                            ("block", pa.int64()),
                            ("low", pa.list_(pa.float64())),
                            ("high", pa.list_(pa.float64())),
                            ("nodes", pa.binary()),
                            ("weights", pa.binary()),
                            ("units", pa.binary()),
                        ]
                    ),
                )
                name += 1
            rest = rest.slice(cuts[-1])
            if batch is None:
                return

    typed = ", ".join(f"{c} int" for c in cells)
    placed = vectors.select("label", "node", "n", "vector").mapInArrow(
        place, f"label long, node long, n long, vector array<double>, {typed}"
    )
    order = ["label", *cells, "node"]
    return (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            gather,
            "label long, block long, low array<double>, high array<double>, "
            "nodes binary, weights binary, units binary",
        )
    )


def _block_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a <= b) of blocks of a label whose boxes are at most eps apart.

    Blocks meet under the cells of the first coordinate that they reach, so those far apart in it
    are never compared.
    """
    boxes = blocks.select("label", "block", "low", "high")
    cell = lambda c: F.floor(F.element_at(c, 1) / eps)
    own = boxes.select("*", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    reach = boxes.select(
        "label",
        *(F.col(c).alias(f"{c}_b") for c in ("block", "low", "high")),
        F.explode(F.sequence(cell("low") - 1, cell("high") + 1)).alias("cell"),
    )
    gap = F.transform(
        F.arrays_zip("low", "high", "low_b", "high_b"),
        lambda x: F.greatest(x["low"] - x["high_b"], x["low_b"] - x["high"], F.lit(0.0)),
    )
    square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return (
        own.join(reach, ["label", "cell"])
        .filter("block <= block_b")
        .filter(square <= eps * eps)
        .select(F.col("block").alias("a"), F.col("block_b").alias("b"))
        .distinct()
    )


def ego_matches(
    left: np.ndarray, right: np.ndarray, axes_left: np.ndarray, axes_right: np.ndarray,
    eps: float, threshold: float, leaf: int = LEAF,
) -> np.ndarray:
    """Matrix of the pairs with a cosine of at least ``threshold``, by recursive intervals."""
    found = np.zeros((len(left), len(right)), bool)
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        p, q = axes_left[a:b], axes_right[c:d]
        gap = np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)).clip(min=0)
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a <= leaf and d - c <= leaf:
            found[a:b, c:d] = left[a:b] @ right[c:d].T >= threshold
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]
    return found


def _span(found: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray) -> list[np.ndarray]:
    """Links that join each connected group of rows and columns of a matrix of matches."""
    out = []
    left = found.any(axis=1)
    seen_columns = np.zeros(found.shape[1], bool)
    while left.any():
        start = int(np.argmax(left))
        rows = np.array([start])
        left[start] = False
        while len(rows):
            columns = found[rows].any(axis=0) & ~seen_columns
            seen_columns |= columns
            out.append(np.stack([np.full(int(columns.sum()), nodes_a[start]), nodes_b[columns]]))
            rows = np.flatnonzero(found[:, columns].any(axis=1) & left)
            left[rows] = False
            out.append(np.stack([np.full(len(rows), nodes_a[start]), nodes_a[rows]]))
    return out


def _join(pairs: DataFrame, dim: int, axes: np.ndarray, eps: float, threshold: float) -> DataFrame:
    """Of each pair of blocks: (node, weight of its partners) and spanning links (node, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["a"] == row["b"]
                nodes = [np.frombuffer(row[f"nodes_{s}"], "<i8") for s in "ab"]
                weights = [np.frombuffer(row[f"weights_{s}"], "<i8") for s in "ab"]
                units = [np.frombuffer(row[f"units_{s}"], "<f8").reshape(-1, dim) for s in "ab"]
                found = ego_matches(*units, *(u @ axes for u in units), eps, threshold)
                if same:
                    np.fill_diagonal(found, False)
                sums = [(nodes[0], found @ weights[1])]
                if not same:
                    sums.append((nodes[1], weights[0] @ found))
                links = _span(found, *nodes)
                node = np.concatenate([s[0] for s in sums] + [x[0] for x in links])
                size = sum(len(s[0]) for s in sums)
                other = np.concatenate([x[1] for x in links]) if links else np.zeros(0, np.int64)
                weight = np.concatenate([s[1] for s in sums])
                kept = np.concatenate([weight > 0, node[size:] != other])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[kept]),
                        pa.array(
                            np.concatenate([np.zeros(size, np.int64), other])[kept],
                            mask=(np.arange(len(node)) < size)[kept],
                        ),
                        pa.array(np.concatenate([weight, np.zeros(len(other), np.int64)])[kept]),
                    ],
                    names=["node", "other", "weight"],
                )

    return pairs.mapInArrow(run, "node long, other long, weight long")


def near_vectors(
    embeddings: DataFrame,
    threshold: float = THRESHOLD,
    grid_dimensions: int = GRID_DIMENSIONS,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine in double precision is at
    least ``threshold``. Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing, nor do vectors of different lengths. Repeated rows are vectors of their own.
    A null vec_id is never the name of a component with other ids. An empty table gives no rows.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").cast("long").alias("label"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    linkable = F.coalesce(
        F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    good = rows.filter(linkable)
    distinct = materialise(
        good.groupBy("label", "vector")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    # One row for each length of vector that occurs; each is a join of its own.
    dims = [r[0] for r in distinct.select(F.size("vector")).distinct().collect()]
    found = None
    for dim in dims:
        of_dim = distinct.filter(F.size("vector") == dim)
        values, directions = np.linalg.eigh(_moments(of_dim, dim))
        axes = np.ascontiguousarray(directions[:, ::-1][:, : min(grid_dimensions, dim)])
        blocks = materialise(_blocks(of_dim, dim, axes, eps, block), "blocks")
        side = lambda s: blocks.select(
            F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "units"))
        )
        pairs = _block_pairs(blocks, eps).join(side("a"), "a").join(side("b"), "b")
        part = _join(pairs, dim, axes, eps, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        links = distinct.selectExpr("node", "0L n_links", "node component")
    else:
        found = materialise(found, "matches")
        linked = connected_components(found.filter("other is not null").selectExpr("node a", "other b"))
        sums = found.filter("other is null").groupBy("node").agg(F.sum("weight").alias("weight"))
        links = (
            distinct.select("node", "n")
            .join(sums, "node", "left")
            .join(linked, "node", "left")
            .select(
                "node",
                (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("component"),
            )
        )
    members = distinct.join(links, "node")
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    members = members.join(least, "component").select("label", "vector", "n_links", "component_id")
    linked_rows = good.join(members, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~linkable).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked_rows.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e)
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS root, vec_id AS node FROM v
  UNION SELECT root, b FROM reach JOIN pairs ON node = a
), named AS (
  SELECT root AS vec_id, min(node) AS component_id FROM reach GROUP BY root
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a) USING (vec_id)
"""
