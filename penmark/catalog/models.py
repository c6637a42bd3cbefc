"""Training, selection and scoring of classifiers on the given tables.

A model cannot be written in SQL, but what must hold of it can: how many rows it scores, that
it beats the share of the largest class, that saving or streaming changes no prediction.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.catalog.fixtures import CORPUS, corpus, sql_hash8, vectors_learnable
from penmark.catalog.registry import query
from penmark.constants import STYLE_FEATURES
from penmark.functions.style import stylometric_features
from penmark.operators import evaluation
from penmark.operators.cleaning import remove_duplicates
from penmark.operators.tfidf import TRAIN_CONFIG
from penmark.operators.vectors import embed_texts
from penmark.plans import training
from penmark.session import TEXT_ROWS, materialise, new_path
from penmark.sources.models import load_pipeline, save_pipeline
from penmark.sources.runs import read_run_results, run_leaderboard

DISTINCT = f"{CORPUS}, texts AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"
BEATS = f"""WITH {DISTINCT} SELECT count(*) AS n, true AS beats_majority FROM texts WHERE split = 'test'"""


def distinct_texts(spark, sf):
    """The corpus without copies, so that no text is in two splits; written once."""
    return materialise(remove_duplicates(corpus(spark, sf)), "distinct-texts", TEXT_ROWS)


def classifier_on_texts(spark, sf):
    docs = distinct_texts(spark, sf)
    train = docs.filter(F.col("split") == "train")
    return training.train_tfidf_classifier(train, TRAIN_CONFIG), docs


def beats_majority(scored: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """(n, beats_majority): whether more rows are right than the largest class has."""
    right = F.count_if(F.col(label_col).eqNullSafe(F.col(pred_col)))
    largest = scored.groupBy(label_col).count().agg(F.max("count")).scalar()
    return scored.agg(F.count("*").alias("n"), right.alias("right")).select(
        "n", (F.col("right") > largest).alias("beats_majority")
    )


@query("train_tfidf_classifier", BEATS)
def train_tfidf_classifier(spark, sf):
    trained, docs = classifier_on_texts(spark, sf)
    test = docs.filter(F.col("split") == "test")
    scored = training.predict_batch(trained.pipeline, test, ["generated_by"])
    return beats_majority(scored, "generated_by", "predicted_label")


@query("predict_batch", f"WITH {DISTINCT} SELECT doc_id, true AS consistent FROM texts")
def predict_batch(spark, sf):
    """Of every text: its label is that of the largest probability, and probabilities sum to 1."""
    trained, docs = classifier_on_texts(spark, sf)
    scored = training.predict_batch(trained.pipeline, docs, ["doc_id"])
    p, labels = F.col("probability"), F.array(*[F.lit(x) for x in trained.labels])
    best = F.array_position(p, F.array_max(p)) - 1
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return scored.select(
        "doc_id",
        (
            (F.col("pred") == best)
            & (F.col("predicted_label") == F.get(labels, F.col("pred")))
            & (F.abs(total - 1) < 1e-9)
        ).alias("consistent"),
    )


@query("saved_model_predictions", f"WITH {DISTINCT} SELECT doc_id, true AS same FROM texts")
def saved_model_predictions(spark, sf):
    """Of every text: the model read back from disk scores it like the one in memory."""
    trained, docs = classifier_on_texts(spark, sf)
    path = new_path(spark, "model")
    save_pipeline(trained.pipeline, path)
    return same_scores(
        training.predict_batch(trained.pipeline, docs, ["doc_id"]),
        training.predict_batch(load_pipeline(path), docs, ["doc_id"]),
    )


def same_scores(one: DataFrame, other: DataFrame) -> DataFrame:
    renamed = other.select("doc_id", F.col("pred").alias("_pred"), F.col("probability").alias("_p"))
    gap = F.array_max(F.zip_with("probability", "_p", lambda a, b: F.abs(a - b)))
    return one.join(renamed, "doc_id", "full").select(
        "doc_id", F.coalesce((F.col("pred") == F.col("_pred")) & (gap < 1e-12), F.lit(False)).alias("same")
    )


@query(
    "train_embedding_classifier",
    f"""SELECT count(*) AS n, true AS beats_majority FROM embeddings WHERE {sql_hash8("vec_id")} % 10 = 9""",
)
def train_embedding_classifier(spark, sf):
    rows = vectors_learnable(spark, sf)
    trained = training.train_embedding_classifier(rows.filter(F.col("split") == "train"), max_iter=60)
    test = training.with_vectors(rows.filter(F.col("split") == "test"))
    scored = trained.pipeline.transform(test)
    return beats_majority(
        scored.withColumn("label", F.col("label").cast("string")), "label", "predicted_label"
    )


PATIENCE = 2


@query(
    "train_with_validation",
    f"""SELECT 'embedding' AS run, 1 AS rank, true AS has_history, true AS best_is_highest,
        true AS restored_scores_best, true AS stops_by_patience, true AS beats_majority, count(*) AS n
        FROM embeddings WHERE {sql_hash8("vec_id")} % 10 = 9""",
)
def train_with_validation(spark, sf):
    """The history of a training, read by the operators on histories, names the model that is kept."""
    rows = vectors_learnable(spark, sf)
    part = lambda split: rows.filter(F.col("split") == split)
    trained = training.train_with_validation(
        part("train"), part("val"), block_iter=10, max_blocks=8, patience=PATIENCE
    )
    history = trained.table(spark, "embedding")
    # Tables of one row each; the run is one.
    best = evaluation.best_epoch(history).first()
    stop = evaluation.early_stop_epoch(history, PATIENCE, "val_acc", "max").first()
    points = evaluation.learning_curves(history).count()
    score = lambda split: trained.best.pipeline.transform(
        training.with_vectors(part(split))
    ).withColumn("label", F.col("label").cast("string"))
    restored = evaluation.accuracy(score("val"), "label", "predicted_label").first()["accuracy"]
    last = len(trained.history)
    facts = {
        "has_history": points == 4 * last,
        "best_is_highest": best["best_epoch"] == trained.best_epoch,
        "restored_scores_best": abs(restored - best["best_val_acc"]) < 1e-12,
        "stops_by_patience": (stop["stop_epoch"], stop["restore_epoch"], stop["stopped_early"])
        == (last, trained.best_epoch, trained.stopped_early),
    }
    beats = beats_majority(score("test"), "label", "predicted_label")
    board = evaluation.rank_runs(evaluation.leaderboard(history)).select("run", "rank")
    return beats.select(
        F.lit("embedding").alias("run"),
        board.select(F.col("rank").cast("int")).scalar().alias("rank"),
        *[F.lit(value).alias(name) for name, value in facts.items()],
        "beats_majority",
        "n",
    )


@query("train_weighted_classifier", BEATS)
def train_weighted_classifier(spark, sf):
    style = stylometric_features(embed_texts(distinct_texts(spark, sf))).drop("text")
    features = materialise(style, "style")
    trained = training.train_weighted_classifier(
        features.filter(F.col("split") == "train"), STYLE_FEATURES, embedding_col="embedding"
    )
    path = new_path(spark, "weighted-model")
    save_pipeline(trained.pipeline, path)
    test = training.combined_features(features.filter(F.col("split") == "test"))
    scored = training.predict_batch(load_pipeline(path), test, ["generated_by"])
    return beats_majority(scored, "generated_by", "predicted_label")


@query(
    "grid_search",
    f"""WITH {DISTINCT} SELECT 4 AS configurations, true AS chosen_is_lowest, true AS beats_majority,
        count(*) AS n FROM texts WHERE split = 'test'""",
)
def grid_search(spark, sf):
    docs = distinct_texts(spark, sf)
    train = docs.filter(F.col("split") == "train")
    stages = PipelineModel(training.tfidf_stages(train, TRAIN_CONFIG))
    indexed = training.index_labels(train, docs)
    rows = materialise(stages.transform(indexed).select("label_id", "features", "split"), "features")
    part = lambda split: rows.filter(F.col("split") == split)
    estimator = LogisticRegression(labelCol="label_id", family="multinomial", maxIter=20)
    grid = [{estimator.regParam: reg} for reg in (0.0001, 0.001, 0.01, 0.1)]
    found = training.grid_search(estimator, grid, part("train"), part("val"), part("test"))
    losses = [t["val_loss"] for t in found.tried]
    return beats_majority(found.test, "label_id", "prediction").select(
        F.lit(len(losses)).alias("configurations"),
        F.lit(losses[found.chosen] == min(losses)).alias("chosen_is_lowest"),
        "beats_majority",
        "n",
    )


@query(
    "trained_run_leaderboard",
    """SELECT * FROM (VALUES ('embedding', 1, true, true)) t(run, rank, has_history, has_accuracy)""",
)
def trained_run_leaderboard(spark, sf):
    """A classifier is trained, its result written, read back and ranked."""
    rows = training.combined_features(
        vectors_learnable(spark, sf).withColumn("label", F.col("label").cast("string"))
    ).withColumnRenamed("_embedding", "features")
    train = rows.filter(F.col("split") == "train")
    trained = training.train_vector_classifier(train, "label")
    score = lambda split: training.predict_batch(
        trained.pipeline, rows.filter(F.col("split") == split), ["label"]
    )
    val = training.accuracy(score("val"), "label", "predicted_label").first()["accuracy"]
    history = training.objective_history(trained)
    result = training.run_result("embedding", trained, score("test"), val, history, "label")
    path = new_path(spark, "run-result")
    result.write.json(path)
    results = read_run_results(spark, path, multi_line=False)
    long_enough = results.select("run", (F.size("training_history") > 1).alias("has_history"))
    return run_leaderboard(results).join(long_enough, "run").select(
        "run", F.col("rank").cast("int").alias("rank"), "has_history",
        F.col("test_accuracy").isNotNull().alias("has_accuracy"),
    )
