"""Training and scoring source classifiers with Spark ML."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    ElementwiseProduct,
    IndexToString,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.functions.tokens import WORD
from penmark.operators.evaluation import accuracy, class_scores, cross_entropy
from penmark.operators.ngramcounts import NgramCounter
from penmark.operators.profile import class_weights
from penmark.operators.tfidf import TfidfConfig, tfidf_fit
from penmark.plans.networks import fit_weights, network_model, row_blocks, scores_by_part
from penmark.session import materialise


def tfidf_stages(
    train: DataFrame, config: TfidfConfig, text_col: str = "text"
) -> list:
    """Fitted stages from text to a sparse TF-IDF vector, all inside the row."""
    if config.sublinear_tf or config.stop_words:
        raise ValueError("the vector form covers the training configurations only")
    terms = tfidf_fit(train, config, text_col).terms
    stages = [
        SQLTransformer(statement=f"SELECT *, coalesce({text_col}, '') AS _text FROM __THIS__"),
        RegexTokenizer(
            inputCol="_text",
            outputCol="_tokens",
            pattern=rf"[{WORD}]{{2,}}",
            gaps=False,
            toLowercase=True,
        ),
    ]
    counts = NgramCounter(
        inputCol="_tokens", outputCol="_counts", vocabulary=terms.column("term").to_pylist()
    )
    weights = Vectors.dense(terms.column("idf").to_pylist())
    stages += [
        counts,
        ElementwiseProduct(scalingVec=weights, inputCol="_counts", outputCol="_weighted"),
        Normalizer(p=2.0, inputCol="_weighted", outputCol="features"),
    ]
    return stages


def _label_indexer(train: DataFrame, class_col: str):
    return StringIndexer(
        inputCol=class_col,
        outputCol="label_id",
        stringOrderType="alphabetAsc",
        handleInvalid="error",
    ).fit(train.filter(F.col(class_col).isNotNull()))


def _logistic(**params) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", labelCol="label_id", family="multinomial", **params
    )


@dataclass
class TrainedClassifier:
    """Label indexer (training only) and the pipeline that scores texts or feature rows."""

    labels: list[str]
    pipeline: PipelineModel


def _finish(train: DataFrame, indexer, feature_stages: list, estimator) -> TrainedClassifier:
    """Fit the estimator on indexed, featurised training rows and name its predictions."""
    features = PipelineModel(feature_stages)
    rows = features.transform(indexer.transform(train))
    wanted = ["label_id", "features"]
    if estimator.hasParam("weightCol") and estimator.isSet("weightCol"):
        wanted.append(estimator.getWeightCol())
    rows = rows.select(*wanted)
    if feature_stages:
        rows = materialise(rows, "features")  # a fit reads its rows several times
    fitted = estimator.fit(rows)
    names = IndexToString(
        inputCol="prediction", outputCol="predicted_label", labels=indexer.labels
    )
    return TrainedClassifier(
        list(indexer.labels), PipelineModel([*feature_stages, fitted, names])
    )


def train_tfidf_classifier(
    train: DataFrame,
    config: TfidfConfig,
    class_col: str = "generated_by",
    max_iter: int = 20,
    reg: float = 1e-4,
) -> TrainedClassifier:
    """TF-IDF n-grams into a multinomial classifier."""
    train = train.filter(F.col(class_col).isNotNull())
    return _finish(
        train,
        _label_indexer(train, class_col),
        tfidf_stages(train, config),
        _logistic(maxIter=max_iter, regParam=reg),
    )


def train_embedding_classifier(
    train: DataFrame,
    class_col: str = "label",
    embedding_col: str = "embedding",
    hidden: Sequence[int] = (512, 256, 128),
    max_iter: int = 50,
    seed: int = 42,
) -> TrainedClassifier:
    """A feed-forward network on embeddings; the pipeline reads ``features`` of ``with_vectors``."""
    train = train.filter(F.col(class_col).isNotNull())
    indexer = _label_indexer(train, class_col)
    rows = with_vectors(train, embedding_col)
    width = rows.select(F.size(vector_to_array("features")).alias("d")).first()["d"]
    layers = [width, *hidden, len(indexer.labels)]
    blocks = row_blocks(indexer.transform(rows).select(F.lit("train").alias("part"), "label_id", "features"))
    first = network_model(train.sparkSession, layers, seed)
    weights = fit_weights(blocks, layers, first.weights.toArray(), max_iter)
    fitted = network_model(train.sparkSession, layers, seed, weights)
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return TrainedClassifier(list(indexer.labels), PipelineModel([fitted, names]))


@dataclass
class ValidatedTraining:
    """The best classifier of a training and what every block of iterations scored.

    ``history`` has one row per block, in the columns that ``best_epoch``, ``early_stop_epoch``,
    ``leaderboard`` and ``learning_curves`` read.
    """

    best: TrainedClassifier
    best_epoch: int
    stopped_early: bool
    history: list[dict] = field(default_factory=list)

    def table(self, spark: SparkSession, run: str) -> DataFrame:
        columns = "run string, epoch int, loss double, train_acc double, val_loss double, val_acc double"
        names = [c.split()[0] for c in columns.split(", ")[1:]]
        return spark.createDataFrame([(run, *(h[c] for c in names)) for h in self.history], columns)


def train_with_validation(
    train: DataFrame,
    val: DataFrame,
    class_col: str = "label",
    embedding_col: str = "embedding",
    hidden: Sequence[int] = (512, 256, 128),
    block_iter: int = 10,
    max_blocks: int = 20,
    patience: int = 3,
    monitor: str = "val_acc",
    seed: int = 42,
) -> ValidatedTraining:
    """A network on embeddings, trained in blocks of iterations and validated after each.

    Every block starts from the weights of the block before. After it, loss and accuracy on the
    training and the validation rows are taken in one pass. The weights of the first block with the
    best ``monitor`` (val_acc: highest, val_loss: lowest) are kept; training stops after
    ``patience`` blocks without a gain. Rows without a class are left out, a class that the training
    rows lack raises an error. Vectors and labels are written once for all blocks; the driver holds
    the weights of two networks.
    """
    if monitor not in ("val_acc", "val_loss"):
        raise ValueError(f"monitor must be val_acc or val_loss, not {monitor}")
    train = train.filter(F.col(class_col).isNotNull())
    indexer = _label_indexer(train, class_col)
    parts = [
        indexer.transform(with_vectors(df.filter(F.col(class_col).isNotNull()), embedding_col)).select(
            F.lit(part).alias("part"), "label_id", "features"
        )
        for part, df in (("train", train), ("val", val))
    ]
    width = parts[0].select(F.size(vector_to_array("features")).alias("d")).first()["d"]
    rows = row_blocks(parts[0].union(parts[1]))
    fit_rows = rows.filter(F.col("part") == "train")
    layers = [width, *hidden, len(indexer.labels)]
    weights = network_model(train.sparkSession, layers, seed).weights.toArray()
    best, best_score, best_at, history = None, None, 0, []
    for epoch in range(1, max_blocks + 1):
        weights = fit_weights(fit_rows, layers, weights, block_iter)
        scores = scores_by_part(rows, layers, weights)
        val_loss, val_acc = scores.get("val", (None, None))
        loss, train_acc = scores["train"]
        history.append(
            {"epoch": epoch, "loss": loss, "train_acc": train_acc, "val_loss": val_loss, "val_acc": val_acc}
        )
        score = val_acc if monitor == "val_acc" or val_loss is None else -val_loss
        if best is None or (score is not None and (best_score is None or score > best_score)):
            best, best_score, best_at = weights, score, epoch
        elif epoch - best_at >= patience:
            break
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return ValidatedTraining(
        TrainedClassifier(
            list(indexer.labels), PipelineModel([network_model(train.sparkSession, layers, seed, best), names])
        ),
        best_at,
        len(history) - best_at >= patience,
        history,
    )


def train_vector_classifier(
    train: DataFrame, class_col: str, max_iter: int = 30, reg: float = 1e-4
) -> TrainedClassifier:
    """A multinomial classifier on the column ``features``."""
    train = train.filter(F.col(class_col).isNotNull())
    return _finish(
        train, _label_indexer(train, class_col), [], _logistic(maxIter=max_iter, regParam=reg)
    )


def index_labels(train: DataFrame, df: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """``df`` with ``label_id`` by the labels of ``train``; an unseen label raises an error."""
    return _label_indexer(train, class_col).transform(df.filter(F.col(class_col).isNotNull()))


def with_vectors(df: DataFrame, embedding_col: str = "embedding") -> DataFrame:
    return df.withColumn(
        "features", array_to_vector(F.col(embedding_col).cast("array<double>"))
    )


def train_weighted_classifier(
    train: DataFrame,
    columns: Sequence[str],
    class_col: str = "generated_by",
    embedding_col: str | None = None,
    max_iter: int = 30,
) -> TrainedClassifier:
    """Standardised features, with or without an embedding, and balanced class weights.

    The scaler is a stage of the pipeline, so a saved model scales the rows that it scores.
    """
    train = train.filter(F.col(class_col).isNotNull())
    weights = class_weights(train, class_col).select(class_col, "weight")
    indexer = _label_indexer(train, class_col)
    # One weight per label; the indexer has already brought the labels to the driver.
    by_label = {r[class_col]: r["weight"] for r in weights.collect()}
    choices = F.create_map(
        *[F.lit(v) for label in indexer.labels for v in (label, by_label[label])]
    )
    weighted = train.withColumn("_weight", choices[F.col(class_col)])
    inputs = list(columns)
    if embedding_col:
        inputs.append("_embedding")
        weighted = weighted.withColumn(
            "_embedding", array_to_vector(F.col(embedding_col).cast("array<double>"))
        )
    assemble = VectorAssembler(inputCols=inputs, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
    fitted = scaler.fit(assemble.transform(weighted).select("_raw"))
    # The scaler divides by the sample deviation; the root turns it into that of the population.
    n = weighted.count()
    root = Vectors.dense([math.sqrt(n / max(n - 1, 1))] * len(fitted.mean))
    stages = [
        assemble,
        fitted,
        ElementwiseProduct(scalingVec=root, inputCol="_scaled", outputCol="features"),
    ]
    estimator = _logistic(maxIter=max_iter, weightCol="_weight")
    return _finish(weighted, indexer, stages, estimator)


def combined_features(df: DataFrame, embedding_col: str = "embedding") -> DataFrame:
    """Adds the vector column that a pipeline trained with an embedding reads."""
    return df.withColumn(
        "_embedding", array_to_vector(F.col(embedding_col).cast("array<double>"))
    )


def predict_batch(trained: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep``, predicted id and label, and class probabilities as an array."""
    return trained.transform(df).select(
        *keep,
        F.col("prediction").cast("int").alias("pred"),
        "predicted_label",
        vector_to_array("probability").alias("probability"),
    )


@dataclass
class Selection:
    """The fitted winner, its number, the losses of all configurations, and its test rows."""

    model: object
    chosen: int
    tried: list[dict]
    test: DataFrame


def grid_search(
    estimator,
    grid: Sequence[dict[Param, object]],
    train: DataFrame,
    val: DataFrame,
    test: DataFrame,
    label_col: str = "label_id",
) -> Selection:
    """Fit every configuration, keep the one with the lowest validation loss, and test it.

    The splits are fixed. Each fit is a Spark job; losses come back as one row each. Only the
    winner sees the test rows, which are returned with its predictions.
    """
    best, best_loss, chosen, tried = None, float("inf"), -1, []
    for number, params in enumerate(grid):
        model = estimator.fit(train, params)
        scored = model.transform(val).select(
            F.col(label_col).cast("int").alias("label"),
            vector_to_array("probability").alias("probability"),
        )
        loss = cross_entropy(scored).first()["loss"]
        tried.append(
            {
                "config": number,
                "params": ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name)),
                "val_loss": loss,
            }
        )
        if loss < best_loss:
            best, best_loss, chosen = model, loss, number
    return Selection(best, chosen, tried, best.transform(test))


def run_result(
    run: str, trained: TrainedClassifier, test: DataFrame, best_val_acc: float, history: list[dict],
    class_col: str = "generated_by",
) -> DataFrame:
    """One run result, in the schema of ``read_run_results``, from a fitted classifier.

    ``test`` is the table that ``predict_batch`` returns, with the true class. The per-class map has
    as many entries as the model has labels.
    """
    scores = class_scores(test, class_col, "predicted_label")
    entry = F.struct(
        F.col("class"),
        F.struct(
            F.col("precision"),
            F.col("recall"),
            F.col("f1").alias("f1-score"),
            F.col("support").cast("double").alias("support"),
        ),
    )
    per_class = scores.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    overall = accuracy(test, class_col, "predicted_label").select("accuracy").scalar()
    epochs = F.array(
        *[
            F.struct(
                F.lit(h["epoch"]).cast("int").alias("epoch"),
                *[F.lit(h.get(k)).cast("double").alias(k) for k in ("loss", "train_acc", "val_acc")],
            )
            for h in history
        ]
    )
    ids = F.create_map(*[F.lit(v) for i, label in enumerate(trained.labels) for v in (label, i)])
    return test.sparkSession.range(1).select(
        F.lit(run).alias("run"),
        F.lit(best_val_acc).cast("double").alias("best_val_acc"),
        F.struct(
            overall.alias("test_accuracy"), per_class.alias("per_class"), F.lit("").alias("report_text")
        ).alias("test_stats"),
        epochs.alias("training_history"),
        ids.alias("label2id"),
    )


def objective_history(trained: TrainedClassifier) -> list[dict]:
    """Loss of each iteration of the fitted classifier, as rows of a history."""
    fitted = next(s for s in reversed(trained.pipeline.stages) if hasattr(s, "hasSummary"))
    losses = fitted.summary.objectiveHistory if fitted.hasSummary else []
    return [{"epoch": i, "loss": float(x)} for i, x in enumerate(losses)]
