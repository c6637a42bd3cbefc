"""Networks fitted over blocks of rows."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from penmark.catalog.fixtures import vectors_learnable
from penmark.plans import networks, training

SMALL = "/root/testdata/sf0.001"


def test_network_weights_are_those_of_spark(spark):
    rows = training.with_vectors(vectors_learnable(spark, SMALL)).select(
        F.when(F.col("vec_id") % 3 == 0, "val").otherwise("train").alias("part"),
        F.col("label").cast("double").alias("label_id"),
        "features",
    )
    layers, train = [64, 16, 8, 4], rows.filter("part = 'train'")
    own = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="label_id", layers=layers, maxIter=60, seed=42, blockSize=4096
    )
    blocks = networks.row_blocks(rows)
    first = networks.network_model(spark, layers, 42).weights.toArray()
    # The gradient is that of the loss.
    fit_rows = blocks.filter("part = 'train'")
    value, slope = networks._evaluated(fit_rows, layers, first)
    way = np.random.default_rng(1).normal(size=len(first)) * 1e-5
    up, down = (networks._evaluated(fit_rows, layers, first + s * way)[0] for s in (1, -1))
    assert np.isclose(up - down, 2 * slope @ way, rtol=1e-4)
    found = networks.network_model(spark, layers, 42, networks.fit_weights(fit_rows, layers, first, 60))
    loss = lambda w: networks._evaluated(fit_rows, layers, w)[0]
    assert loss(found.weights.toArray()) < min(value, 1.2 * loss(own.fit(train.coalesce(1)).weights.toArray()) + 0.02)
    # The model in Spark scores like the blocks.
    scores = networks.scores_by_part(blocks, layers, found.weights.toArray())
    for part in ("train", "val"):
        scored = found.transform(rows.filter(F.col("part") == part))
        right = scored.agg(F.avg((F.col("prediction") == F.col("label_id")).cast("double"))).first()[0]
        assert np.isclose(scores[part][1], right, atol=1e-12)
