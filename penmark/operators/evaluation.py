"""Scores of predictions and of training runs.

Everything about predictions comes from one (label, prediction) count table, which holds at
most classes squared rows however many predictions there are. Rows without a label cannot be
judged and are left out everywhere. A missing prediction is a miss: it counts as a row of its
class and as no prediction of any class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.ranges import with_positions


def outcome_counts(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """(label, pred, n) of the labelled rows; ``pred`` is null where no prediction was made."""
    return (
        df.filter(F.col(label_col).isNotNull())
        .groupBy(F.col(label_col).alias("label"), F.col(pred_col).alias("pred"))
        .agg(F.count("*").alias("n"))
    )


def accuracy(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    hit = F.col(label_col).eqNullSafe(F.col(pred_col)).cast("int")
    return df.filter(F.col(label_col).isNotNull()).agg(
        F.try_divide(F.sum(hit).cast("double"), F.count(hit)).alias("accuracy"),
        F.count(hit).alias("n"),
    )


def class_scores(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where a score is undefined."""
    n = F.col("n")
    hit = F.when(F.col("label") == F.col("pred"), n).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.inline(
        F.array(
            F.struct(F.col("label").alias("class"), hit.alias("tp"), n.alias("sup"), zero.alias("pre")),
            F.struct(F.col("pred").alias("class"), zero.alias("tp"), zero.alias("sup"), n.alias("pre")),
        )
    )
    sums = (
        outcome_counts(df, label_col, pred_col)
        .select(sides)
        .filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.sum("tp").cast("double").alias("tp"),
            F.sum("sup").alias("support"),
            F.sum("pre").alias("predicted"),
        )
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        F.col("class"),
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        # Equal to the harmonic mean of precision and recall.
        ratio(2.0 * tp, support + predicted).alias("f1"),
        "support",
    )


def classification_report(
    df: DataFrame, label_col: str = "label", pred_col: str = "pred"
) -> DataFrame:
    """Per-class scores and the rows ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = class_scores(df, label_col, pred_col)
    support = F.col("support")
    total = F.sum("support")
    names = ["precision", "recall", "f1"]
    weighted = lambda c: F.coalesce(
        F.try_divide(F.sum(F.col(c) * support), total), F.lit(0.0)
    )
    summary = scores.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[weighted(c).alias(f"w_{c}") for c in names],
        total.alias("support"),
    )
    row = lambda name, cols: F.struct(
        F.lit(name).alias("class"),
        *[F.col(c).alias(out) for c, out in zip(cols, names)],
        F.col("support").alias("support"),
    )
    averages = summary.select(
        F.inline(
            F.array(
                # Weighted recall is the share of correct predictions.
                row("accuracy", ["w_recall"] * 3),
                row("macro avg", [f"m_{c}" for c in names]),
                row("weighted avg", [f"w_{c}" for c in names]),
            )
        )
    )
    return scores.withColumn("class", F.col("class").cast("string")).unionByName(averages)


def confusion_matrix(
    df: DataFrame, label_col: str = "label", pred_col: str = "pred"
) -> DataFrame:
    """Counts for every pair of known classes, zeros included.

    Rows of a class without a prediction follow as pairs with a null ``pred``. The table has a row
    for every pair of classes by definition; pairs are made per class, in as many tasks as there
    are classes.
    """
    counts = outcome_counts(df, label_col, pred_col)
    classes = (
        counts.select(F.explode(F.array("label", "pred")).alias("class"))
        .filter(F.col("class").isNotNull())
        .distinct()
    )
    all_classes = classes.agg(F.sort_array(F.collect_list("class"))).scalar()
    grid = classes.select(F.col("class").alias("label"), F.explode(all_classes).alias("pred"))
    full = grid.join(counts, ["label", "pred"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
    return full.unionByName(counts.filter(F.col("pred").isNull()))


def macro_f1(df: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    return class_scores(df, label_col, pred_col).agg(F.avg("f1").alias("macro_f1"))


def softmax(scores: Column) -> Column:
    """Probabilities from an array of scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(raised, F.lit(0.0), lambda t, e: t + e)
    return F.transform(raised, lambda e: e / total)


def cross_entropy(
    df: DataFrame,
    label_col: str = "label",
    prob_col: str = "probability",
    weight_col: str | None = None,
) -> DataFrame:
    """Mean negative log probability of the true class, optionally weighted.

    Rows without a label or without a probability for it are not scored and count nowhere; a label
    for which the probabilities have no place raises an error.
    """
    label, known = F.col(label_col), F.col(prob_col)
    outside = (label < 0) | (label >= F.size(known))
    p = F.when(
        label.isNotNull() & known.isNotNull() & outside,
        F.raise_error(F.concat(F.lit("no probability for label "), label.cast("string"))).cast("double"),
    ).otherwise(F.get(known, label))
    weight = F.col(weight_col) if weight_col else F.lit(1.0)
    scored = df.select(p.alias("_p"), weight.cast("double").alias("_weight")).filter(
        F.col("_p").isNotNull() & F.col("_weight").isNotNull()
    )
    loss = -F.log(F.greatest("_p", F.lit(1e-15)))
    return scored.agg(
        F.try_divide(F.sum(loss * F.col("_weight")), F.sum("_weight")).alias("loss"),
        F.count("*").alias("n"),
    )


def best_epoch(history: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """First epoch of every run with the highest validation accuracy, and the last one."""
    by_score = F.struct("val_acc", -F.col("epoch"))
    return history.groupBy(*run).agg(
        F.max("val_acc").alias("best_val_acc"),
        F.max_by("epoch", by_score).alias("best_epoch"),
        F.max_by("train_acc", by_score).alias("train_acc_at_best"),
        F.max("epoch").alias("epochs"),
        F.max_by("val_acc", "epoch").alias("last_val_acc"),
    )


EPOCH_BLOCK = 4096


def _with_best(history: DataFrame, score: Column, run: Sequence[str]) -> DataFrame:
    """Append ``_no``, the number of the epoch within its run, and ``_best``, the lowest score
    so far as (score, epoch, no), which names the first epoch that reached it. An epoch without a
    score is never the best one; ``_best`` is null until an epoch has one.

    Epochs are scanned in blocks that then carry the result of earlier blocks, so a very long
    run spreads over many tasks.
    """
    block = Window.partitionBy(*run, "_block").orderBy("epoch")
    rows = (
        # Not nullable, so that both uses of this table keep the same plan and share a shuffle.
        history.withColumn("_block", F.coalesce(F.floor(F.col("epoch") / EPOCH_BLOCK), F.lit(0)))
        .withColumn("_score", score)
        .withColumn("_in", F.row_number().over(block).cast("bigint"))
    )
    earlier = (
        Window.partitionBy(*run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    lowest, scored = F.col("_lowest"), F.col("_score").isNotNull()
    carried = (
        rows.groupBy(*run, "_block")
        .agg(F.count("*").alias("_n"), F.min(F.when(scored, F.struct("_score", "epoch", "_in"))).alias("_lowest"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn(
            "_lowest",
            F.when(
                lowest.isNotNull(),
                F.struct(
                    lowest["_score"].alias("_score"),
                    lowest["epoch"].alias("epoch"),
                    (lowest["_in"] + F.col("_offset")).alias("_no"),
                ),
            ),
        )
        .select(*run, "_block", "_offset", F.min("_lowest").over(earlier).alias("_carried"))
    )
    so_far = block.rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(carried, [*run, "_block"])
        .withColumn("_no", F.col("_in") + F.col("_offset"))
        .withColumn(
            "_best",
            F.least("_carried", F.min(F.when(scored, F.struct("_score", "epoch", "_no"))).over(so_far)),
        )
    )


def running_best(history: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """Append the best validation accuracy so far and whether the epoch improved on it."""
    best = F.col("_best")
    return _with_best(history, -F.col("val_acc"), run).select(
        *history.columns,
        (-best["_score"]).alias("best_so_far"),
        F.coalesce(best["epoch"] == F.col("epoch"), F.lit(False)).alias("improved"),
    )


def early_stop_epoch(
    history: DataFrame,
    patience: int = 2,
    metric: str = "val_loss",
    mode: str = "min",
    run: Sequence[str] = ("run",),
) -> DataFrame:
    """Where each run would stop after ``patience`` epochs without a gain, and what to restore.

    A run that never waits that long ends at its last epoch. An epoch without a score gains nothing;
    a run without any score never stops and restores nothing.
    """
    score = F.col(metric) if mode == "min" else -F.col(metric)
    best, epoch = F.col("_best"), F.col("epoch")
    waited = F.col("_no") - best["_no"] >= patience
    return (
        _with_best(history, score, run)
        .groupBy(*run)
        .agg(
            F.min(F.when(waited, F.struct(epoch, best["epoch"].alias("best")))).alias("_stop"),
            F.max(F.struct(epoch, best["epoch"].alias("best"))).alias("_last"),
        )
        .select(
            *run,
            F.coalesce("_stop", "_last")["epoch"].alias("stop_epoch"),
            F.coalesce("_stop", "_last")["best"].alias("restore_epoch"),
            F.col("_stop").isNotNull().alias("stopped_early"),
        )
    )


def leaderboard(history: DataFrame, run: Sequence[str] = ("run",)) -> DataFrame:
    """One row per run: best and last scores and the train-validation gap at the end."""
    return history.groupBy(*run).agg(
        F.max("val_acc").alias("best_val_acc"),
        F.max_by("val_acc", "epoch").alias("last_val_acc"),
        (F.max_by("train_acc", "epoch") - F.max_by("val_acc", "epoch")).alias("gap"),
        F.count("*").alias("epochs"),
    )


def rank_runs(board: DataFrame, score: str = "best_val_acc") -> DataFrame:
    """Append the competition rank: one more than the number of better runs.

    Runs without a score come last and share a rank.
    """
    ranked = with_positions(board, [F.col(score).desc_nulls_last()], "rank", ties=True)
    return ranked.withColumn("rank", F.col("rank") + 1)


def learning_curves(
    history: DataFrame,
    run: Sequence[str] = ("run",),
    metrics: Sequence[str] = ("loss", "train_acc", "val_loss", "val_acc"),
) -> DataFrame:
    """Long form (run, epoch, metric, value)."""
    return history.unpivot([*run, "epoch"], list(metrics), "metric", "value").filter(
        F.col("value").isNotNull()
    )


def rank_class_probabilities(
    df: DataFrame,
    labels: Sequence[str],
    ids: Sequence[str] = ("doc_id",),
    prob_col: str = "probability",
) -> DataFrame:
    """Classes of every text from most to least probable: (ids, rank, label, probability).

    ``labels`` holds the class names by id. The ranking sorts an array inside the row.
    """
    names = F.array(*[F.lit(name) for name in labels])
    pairs = F.transform(
        F.col(prob_col), lambda p, i: F.struct((-p).alias("_p"), i.alias("_i"))
    )
    return (
        df.select(*ids, F.posexplode_outer(F.sort_array(pairs)).alias("_r", "_pair"))
        .filter(F.col("_r").isNotNull())
        .select(
            *ids,
            (F.col("_r") + 1).alias("rank"),
            F.get(names, F.col("_pair._i")).alias("label"),
            (-F.col("_pair._p")).alias("probability"),
        )
    )
