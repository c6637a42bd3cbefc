"""Scores of predictions and training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.catalog.fixtures import (
    HISTORY,
    PREDICTIONS,
    PROBABILITIES,
    history,
    predictions,
    probabilities,
)
from penmark.catalog.registry import query
from penmark.operators import evaluation

SCORES = f"""{PREDICTIONS},
 classes AS (SELECT label AS class FROM predictions UNION SELECT pred FROM predictions),
 scores AS (
  SELECT class, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp / nullif(support, 0), 0.0) AS recall,
         coalesce(2.0 * tp / nullif(support + predicted, 0), 0.0) AS f1, support
  FROM (SELECT class, count(*) FILTER (label = class AND pred = class) AS tp,
               count(*) FILTER (label = class) AS support, count(*) FILTER (pred = class) AS predicted
        FROM classes JOIN predictions ON label = class OR pred = class GROUP BY class))"""


@query(
    "accuracy",
    f"WITH {PREDICTIONS} SELECT avg(CAST(label = pred AS integer)) AS accuracy, count(*) AS n FROM predictions",
    doubles=["accuracy"],
)
def accuracy(spark, sf):
    return evaluation.accuracy(predictions(spark, sf))


@query(
    "classification_report",
    f"""WITH {SCORES}
        SELECT CAST(class AS varchar) AS class, precision, recall, f1, support FROM scores
        UNION ALL SELECT 'accuracy', a, a, a, n FROM
          (SELECT count(*) FILTER (label = pred) / count(*) AS a, count(*) AS n FROM predictions)
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS bigint) FROM scores
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
          CAST(sum(support) AS bigint) FROM scores""",
    doubles=["precision", "recall", "f1"],
)
def classification_report(spark, sf):
    return evaluation.classification_report(predictions(spark, sf))


@query(
    "confusion_matrix",
    f"""WITH {PREDICTIONS}, classes AS (SELECT label AS class FROM predictions UNION SELECT pred FROM predictions)
        SELECT a.class AS label, b.class AS pred, count(p.id) AS n
        FROM classes a CROSS JOIN classes b LEFT JOIN predictions p ON p.label = a.class AND p.pred = b.class
        GROUP BY 1, 2""",
)
def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(predictions(spark, sf))


@query("macro_f1", f"WITH {SCORES} SELECT avg(f1) AS macro_f1 FROM scores", doubles=["macro_f1"])
def macro_f1(spark, sf):
    return evaluation.macro_f1(predictions(spark, sf))


@query(
    "cross_entropy",
    f"""WITH {PROBABILITIES} SELECT avg(-ln(greatest(p, 1e-15))) AS loss, count(*) AS n
        FROM probabilities WHERE class = label""",
    doubles=["loss"],
)
def cross_entropy(spark, sf):
    return evaluation.cross_entropy(probabilities(spark, sf))


@query(
    "weighted_cross_entropy",
    f"""WITH {PROBABILITIES}, w AS (
          SELECT label, (SELECT count(*) FROM embeddings)
                 / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)) AS weight
          FROM embeddings GROUP BY label)
        SELECT sum(-ln(greatest(p, 1e-15)) * weight) / sum(weight) AS loss, count(*) AS n
        FROM probabilities JOIN w USING (label) WHERE class = label""",
    doubles=["loss"],
)
def weighted_cross_entropy(spark, sf):
    from penmark.bounded import attach
    from penmark.operators.profile import class_weights

    rows = probabilities(spark, sf)
    weights = class_weights(rows, "label").select("label", "weight")
    return evaluation.cross_entropy(attach(rows, weights, ["label"]), weight_col="weight")


@query(
    "rank_class_probabilities",
    f"""WITH {PROBABILITIES}
        SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class) AS integer) AS rank,
               'class_' || class AS label, p AS probability FROM probabilities""",
    doubles=["probability"],
)
def rank_class_probabilities(spark, sf):
    names = [f"class_{i}" for i in range(10)]
    return evaluation.rank_class_probabilities(probabilities(spark, sf), names, ids=["vec_id"])


@query(
    "best_epoch",
    f"""WITH {HISTORY} SELECT run, max(val_acc) AS best_val_acc, first(epoch ORDER BY val_acc DESC, epoch) AS best_epoch,
          first(train_acc ORDER BY val_acc DESC, epoch) AS train_acc_at_best, max(epoch) AS epochs,
          last(val_acc ORDER BY epoch) AS last_val_acc FROM history GROUP BY run""",
    doubles=["best_val_acc", "train_acc_at_best", "last_val_acc"],
)
def best_epoch(spark, sf):
    return evaluation.best_epoch(history(spark, sf))


@query(
    "running_best",
    f"""WITH {HISTORY} SELECT run, epoch, val_acc, max(val_acc) OVER w AS best_so_far,
          coalesce(val_acc > max(val_acc) OVER (PARTITION BY run ORDER BY epoch
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
        FROM history WINDOW w AS (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING)""",
    doubles=["val_acc", "best_so_far"],
)
def running_best(spark, sf):
    return evaluation.running_best(history(spark, sf)).select(
        "run", "epoch", "val_acc", "best_so_far", "improved"
    )


def sql_early_stop(score: str, patience: int) -> str:
    return f"""WITH {HISTORY},
      a AS (SELECT run, epoch, row_number() OVER w AS no,
                   coalesce({score} < min({score}) OVER (PARTITION BY run ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain
            FROM history WINDOW w AS (PARTITION BY run ORDER BY epoch)),
      b AS (SELECT *, no - max(CASE WHEN gain THEN no END) OVER (PARTITION BY run ORDER BY epoch) AS wait FROM a),
      c AS (SELECT *, min(CASE WHEN wait >= {patience} THEN epoch END) OVER (PARTITION BY run) AS stop FROM b)
      SELECT run, max(epoch) AS stop_epoch, max(CASE WHEN gain THEN epoch END) AS restore_epoch,
             bool_or(stop IS NOT NULL) AS stopped_early
      FROM c WHERE stop IS NULL OR epoch <= stop GROUP BY run"""


@query("early_stop_epoch", sql_early_stop("val_loss", 2))
def early_stop_epoch(spark, sf):
    return evaluation.early_stop_epoch(history(spark, sf))


@query("early_stop_epoch_by_accuracy", sql_early_stop("(-val_acc)", 6))
def early_stop_by_accuracy(spark, sf):
    return evaluation.early_stop_epoch(
        history(spark, sf), patience=6, metric="val_acc", mode="max"
    )


@query(
    "leaderboard",
    f"""WITH {HISTORY}, b AS (
          SELECT run, max(val_acc) AS best_val_acc, last(val_acc ORDER BY epoch) AS last_val_acc,
                 last(train_acc ORDER BY epoch) - last(val_acc ORDER BY epoch) AS gap, count(*) AS epochs
          FROM history GROUP BY run)
        SELECT *, rank() OVER (ORDER BY best_val_acc DESC) AS rank FROM b""",
    doubles=["best_val_acc", "last_val_acc", "gap"],
)
def leaderboard(spark, sf):
    return evaluation.rank_runs(evaluation.leaderboard(history(spark, sf)))


@query(
    "learning_curves",
    f"""WITH {HISTORY} SELECT run, epoch, metric, value FROM history
        UNPIVOT (value FOR metric IN (loss, train_acc, val_loss, val_acc))""",
    doubles=["value"],
)
def learning_curves(spark, sf):
    return evaluation.learning_curves(history(spark, sf))


@query(
    "class_scores_of_turns",
    """WITH p AS (SELECT role AS label, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS pred
                  FROM conversations),
       classes AS (SELECT label AS class FROM p UNION SELECT pred FROM p)
       SELECT class, coalesce(count(*) FILTER (label = class AND pred = class)
                              / nullif(count(*) FILTER (pred = class), 0), 0.0) AS precision,
              coalesce(count(*) FILTER (label = class AND pred = class)
                       / nullif(count(*) FILTER (label = class), 0), 0.0) AS recall,
              coalesce(2.0 * count(*) FILTER (label = class AND pred = class)
                       / (count(*) FILTER (label = class) + count(*) FILTER (pred = class)), 0.0) AS f1,
              count(*) FILTER (label = class) AS support
       FROM classes JOIN p ON label = class OR pred = class GROUP BY class""",
    doubles=["precision", "recall", "f1"],
)
def class_scores_of_turns(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.col("role").alias("label"),
        F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant").alias("pred"),
    )
    return evaluation.class_scores(turns)


GAPS = f"""{HISTORY}, gaps AS (
  SELECT run, epoch, CASE WHEN epoch % 5 = 1 OR run % 7 = 0 THEN NULL ELSE val_acc END AS val_acc FROM history)"""


def _gaps(spark, sf):
    """The run table with epochs, and whole runs, that have no score."""
    missing = (F.col("epoch") % 5 == 1) | (F.col("run") % 7 == 0)
    return history(spark, sf).withColumn("val_acc", F.when(~missing, F.col("val_acc")))


@query(
    "running_best_with_gaps",
    f"""WITH {GAPS} SELECT run, epoch, max(val_acc) OVER w AS best_so_far,
          coalesce(val_acc > coalesce(max(val_acc) OVER (PARTITION BY run ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), false) AS improved
        FROM gaps WINDOW w AS (PARTITION BY run ORDER BY epoch)""",
    doubles=["best_so_far"],
)
def running_best_with_gaps(spark, sf):
    return evaluation.running_best(_gaps(spark, sf)).select("run", "epoch", "best_so_far", "improved")


@query(
    "rank_runs_with_gaps",
    f"""WITH {GAPS}, b AS (SELECT run, max(val_acc) AS best_val_acc FROM gaps GROUP BY run)
        SELECT *, rank() OVER (ORDER BY best_val_acc DESC NULLS LAST) AS rank FROM b""",
    doubles=["best_val_acc"],
)
def rank_runs_with_gaps(spark, sf):
    board = evaluation.leaderboard(_gaps(spark, sf)).select("run", "best_val_acc")
    return evaluation.rank_runs(board)


UNJUDGED = f"""{PREDICTIONS}, unjudged AS (
  SELECT CASE WHEN id % 11 = 0 THEN NULL ELSE label END AS label,
         CASE WHEN id % 13 = 0 THEN NULL ELSE pred END AS pred FROM predictions)"""


@query(
    "confusion_matrix_with_gaps",
    f"""WITH {UNJUDGED}, c AS (SELECT DISTINCT label AS k FROM unjudged WHERE label IS NOT NULL
          UNION SELECT DISTINCT pred FROM unjudged WHERE label IS NOT NULL AND pred IS NOT NULL),
        n AS (SELECT label, pred, count(*) AS n FROM unjudged WHERE label IS NOT NULL GROUP BY 1, 2)
        SELECT a.k AS label, b.k AS pred, CAST(coalesce(n, 0) AS bigint) AS n
        FROM c a CROSS JOIN c b LEFT JOIN n ON n.label = a.k AND n.pred = b.k
        UNION ALL SELECT label, pred, n FROM n WHERE pred IS NULL""",
)
def confusion_matrix_with_gaps(spark, sf):
    rows = predictions(spark, sf).select(
        F.when(F.col("id") % 11 != 0, F.col("label")).alias("label"),
        F.when(F.col("id") % 13 != 0, F.col("pred")).alias("pred"),
    )
    return evaluation.confusion_matrix(rows)
