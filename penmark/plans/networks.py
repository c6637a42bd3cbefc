"""Fitting of feed-forward networks over blocks of rows.

Vectors and labels are written once as matrices of some ``BLOCK_ROWS`` rows, dealt evenly over the
tasks. Each evaluation of loss and gradient is one pass over them: every task takes matrix products
of its blocks, and the sums of the tasks are added up in parts of the weights. The driver holds the
weights and the last few changes of them, from which a limited-memory quasi-Newton step is taken.
Networks are those of ``MultilayerPerceptronClassifier``, whose model the weights are given to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.session import materialise

BLOCK_ROWS = 1024
PART_WEIGHTS = 1 << 15  # weights that are summed together
MEMORY = 10  # changes that a step is made of
TOLERANCE = 1e-6  # relative gain of the loss at which training ends
SEARCHES = 20  # lengths of a step that are tried


def network_model(
    spark: SparkSession, layers: Sequence[int], seed: int, weights: np.ndarray | None = None
) -> MultilayerPerceptronClassificationModel:
    """The model with the given weights, or with the first ones that ``seed`` draws."""
    network = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label_id", layers=list(layers), maxIter=0, seed=seed
    )
    if weights is not None:
        network = network.setInitialWeights(Vectors.dense(weights))
    row = [(0.0, Vectors.dense(np.zeros(layers[0])))]  # no iteration is made, so it teaches nothing
    return network.fit(spark.createDataFrame(row, ["label_id", "features"]).coalesce(1))


def row_blocks(rows: DataFrame) -> DataFrame:
    """(part, labels, values) in blocks from ``part``, ``label_id`` and ``features``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                parts = batch.column(0).dictionary_encode()
                labels = batch.column(1).to_numpy(zero_copy_only=False).astype("<f8")
                matrix = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(batch), -1)
                codes = parts.indices.to_numpy()
                for code, part in enumerate(parts.dictionary.to_pylist()):
                    chosen = codes == code
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([part]),
                            pa.array([labels[chosen].tobytes()], pa.binary()),
                            pa.array([matrix[chosen].tobytes()], pa.binary()),
                        ],
                        names=["part", "labels", "values"],
                    )

    dealt = rows.select("part", F.col("label_id").cast("double"), vector_to_array("features")).repartition(
        rows.sparkSession.sparkContext.defaultParallelism
    )
    return materialise(dealt.mapInArrow(run, "part string, labels binary, values binary"), "row-blocks")


def _layers_of(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of every layer, as views, in the order that Spark keeps them."""
    out, at = [], 0
    for size, to in zip(layers, layers[1:]):
        out.append((weights[at : at + size * to].reshape(size, to), weights[at + size * to : at + (size + 1) * to]))
        at += (size + 1) * to
    return out


def _block(batch: pa.RecordBatch, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    labels, values = (np.frombuffer(batch.column(c)[row].as_buffer(), "<f8") for c in ("labels", "values"))
    return labels.astype(np.int64), values.reshape(-1, width)


def _forward(values: np.ndarray, model: list) -> list[np.ndarray]:
    """Inputs of every layer, and the logarithms of the probabilities."""
    states = [values]
    for matrix, offsets in model[:-1]:
        with np.errstate(over="ignore"):
            states.append(1.0 / (1.0 + np.exp(-(states[-1] @ matrix + offsets))))
    out = states[-1] @ model[-1][0] + model[-1][1]
    out -= out.max(axis=1, keepdims=True)
    out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
    return [*states, out]


def _evaluated(blocks: DataFrame, layers: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss over all rows and its gradient."""
    layers = list(layers)
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _layers_of(shared.value, layers)
        sums = np.zeros(len(shared.value) + 2)  # gradient, loss, rows
        slopes = _layers_of(sums, layers)
        for batch in batches:
            for row in range(len(batch)):
                labels, values = _block(batch, row, layers[0])
                *states, logs = _forward(values, model)
                each = np.arange(len(labels))
                sums[-2:] += (-logs[each, labels].sum(), len(labels))
                slope = np.exp(logs)
                slope[each, labels] -= 1
                for k in range(len(model) - 1, -1, -1):
                    slopes[k][0][...] += states[k].T @ slope
                    slopes[k][1][...] += slope.sum(axis=0)
                    if k:
                        slope = (slope @ model[k][0].T) * states[k] * (1 - states[k])
        task = TaskContext.get().partitionId()
        for at in range(0, len(sums), PART_WEIGHTS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at]), pa.array([task]), pa.array([sums[at : at + PART_WEIGHTS].tobytes()], pa.binary())],
                names=["at", "task", "sums"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = None, None
        named = lambda: pa.RecordBatch.from_arrays(
            [pa.array([place]), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"]
        )
        for batch in batches:  # in the order of places, then of tasks
            for at, part in zip(batch.column("at").to_pylist(), batch.column("sums")):
                part = np.frombuffer(part.as_buffer(), "<f8")
                if at == place:
                    total += part
                    continue
                if place is not None:
                    yield named()
                place, total = at, part.copy()
        if place is not None:
            yield named()

    summed = (
        blocks.select("labels", "values")
        .mapInArrow(run, "at long, task long, sums binary")
        .repartition("at")
        .sortWithinPartitions("at", "task")
        .select("at", "sums")
        .mapInArrow(add, "at long, sums binary")
        .toArrow()
        .sort_by("at")
    )
    shared.destroy()
    total = np.concatenate([np.frombuffer(x.as_buffer(), "<f8") for x in summed.column("sums")])
    return total[-2] / total[-1], total[:-2] / total[-1]


def fit_weights(blocks: DataFrame, layers: Sequence[int], weights: np.ndarray, max_iter: int) -> np.ndarray:
    """Weights after at most ``max_iter`` quasi-Newton steps that each lower the mean loss."""
    value, slope = _evaluated(blocks, layers, weights)
    first, changes = value, []
    for _ in range(max_iter):
        if np.linalg.norm(slope) <= max(TOLERANCE * abs(value), 1e-8):
            break
        way = _direction(slope, changes)
        down = float(way @ slope)
        if down >= 0:
            changes, way = [], -slope
            down = float(way @ slope)
        low, high = 0.0, np.inf
        length = 1.0 if changes else 1.0 / np.linalg.norm(way)
        best = None
        for _ in range(SEARCHES):
            tried = weights + length * way
            found, found_slope = _evaluated(blocks, layers, tried)
            if found <= value + 1e-4 * length * down:
                best = (tried, found, found_slope)
                if found_slope @ way >= 0.9 * down:
                    break
                low = length
            else:
                high = length
            length = 2 * length if high == np.inf else (low + high) / 2
        if best is None:
            break
        changes = [*changes, (best[0] - weights, best[2] - slope)][-MEMORY:]
        changes = [(s, y) for s, y in changes if s @ y > 0]
        gain = value - best[1]
        weights, value, slope = best
        if gain <= TOLERANCE * abs(first):
            break
    return weights


def _direction(slope: np.ndarray, changes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the slope times the inverse curvature that the last changes show."""
    way, parts = -slope, []
    for s, y in reversed(changes):
        share = (s @ way) / (s @ y)
        way = way - share * y
        parts.append(share)
    if changes:
        s, y = changes[-1]
        way = way * ((s @ y) / (y @ y))
    for (s, y), share in zip(changes, reversed(parts)):
        way = way + (share - (y @ way) / (s @ y)) * s
    return way


def scores_by_part(blocks: DataFrame, layers: Sequence[int], weights: np.ndarray) -> dict[str, tuple[float, float]]:
    """part -> (mean cross-entropy, accuracy), from one pass over all parts."""
    layers = list(layers)
    shared = blocks.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _layers_of(shared.value, layers)
        for batch in batches:
            for row in range(len(batch)):
                labels, values = _block(batch, row, layers[0])
                logs = _forward(values, model)[-1]
                loss = np.minimum(-logs[np.arange(len(labels)), labels], -np.log(1e-15)).sum()
                right = int((logs.argmax(axis=1) == labels).sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part").slice(row, 1), *(pa.array([x]) for x in (float(loss), right, len(labels)))],
                    names=["part", "loss", "right", "n"],
                )

    scored = (
        blocks.mapInArrow(run, "part string, loss double, right long, n long")
        .groupBy("part")
        .agg((F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("right") / F.sum("n")).alias("accuracy"))
    )
    found = {r["part"]: (r["loss"], r["accuracy"]) for r in scored.collect()}
    shared.destroy()
    return found
