"""Scores against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from penmark.operators import attribution, evaluation


@pytest.fixture(scope="module")
def predictions(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] * 2
    return spark.createDataFrame(pairs, "label string, pred string")


def test_report(predictions):
    rows = {r["class"]: r for r in evaluation.classification_report(predictions).collect()}
    scores = lambda c: [rows[c][m] for m in ("precision", "recall", "f1", "support")]
    assert scores("a") == pytest.approx([3 / 5, 3 / 4, 2 / 3, 4])
    assert scores("b") == pytest.approx([2 / 3, 1.0, 0.8, 2])
    # A class that is never predicted scores zero instead of failing.
    assert scores("c") == [0.0, 0.0, 0.0, 2]
    assert scores("accuracy") == pytest.approx([5 / 8] * 3 + [8])
    assert scores("macro avg")[2] == pytest.approx((2 / 3 + 0.8) / 3)
    assert scores("weighted avg")[1] == pytest.approx(5 / 8)
    assert evaluation.accuracy(predictions).first()["accuracy"] == 5 / 8


def test_confusion_has_zeros_and_all_rows(predictions):
    rows = evaluation.confusion_matrix(predictions).collect()
    assert len(rows) == 9 and sum(r["n"] for r in rows) == 8
    assert {(r["label"], r["pred"]): r["n"] for r in rows}[("c", "c")] == 0


def test_cross_entropy_clips(spark):
    import math

    df = spark.createDataFrame(
        [(0, [0.5, 0.5], 1.0), (1, [1.0, 0.0], 3.0)], "label int, probability array<double>, w double"
    )
    floor = -math.log(1e-15)
    got = evaluation.cross_entropy(df).first()["loss"]
    assert got == pytest.approx((math.log(2) + floor) / 2)
    weighted = evaluation.cross_entropy(df, weight_col="w").first()["loss"]
    assert weighted == pytest.approx((math.log(2) + 3 * floor) / 4)


@pytest.fixture(scope="module")
def history(spark):
    rows = []
    for epoch, (loss, acc) in enumerate(
        [(5.0, 0.1), (4.0, 0.3), (4.0, 0.3), (4.5, 0.2), (1.0, 0.9)], start=1
    ):
        rows.append(("stops", epoch, loss, acc, loss, acc))
    for epoch in range(1, 4):
        rows.append(("runs on", epoch, 1.0 / epoch, 0.2 * epoch, 1.0 / epoch, 0.2 * epoch))
    return spark.createDataFrame(
        rows,
        "run string, epoch int, loss double, train_acc double, val_loss double, val_acc double",
    )


def test_best_epoch_is_the_first_of_equals(history):
    early = history.filter("epoch < 5")
    best = {r["run"]: r["best_epoch"] for r in evaluation.best_epoch(early).collect()}
    assert best == {"stops": 2, "runs on": 3}
    marked = evaluation.running_best(early).filter("run = 'stops'").orderBy("epoch").collect()
    assert [r["improved"] for r in marked] == [True, True, False, False]
    assert [r["best_so_far"] for r in marked] == [0.1, 0.3, 0.3, 0.3]


def test_early_stop(history):
    rows = {r["run"]: tuple(r)[1:] for r in evaluation.early_stop_epoch(history).collect()}
    assert rows == {"stops": (4, 2, True), "runs on": (3, 3, False)}


@pytest.mark.parametrize("block", [1, 2, 3])
def test_long_runs_scan_in_blocks(history, monkeypatch, block):
    whole = sorted(map(tuple, evaluation.running_best(history).collect()))
    stops = sorted(map(tuple, evaluation.early_stop_epoch(history).collect()))
    monkeypatch.setattr(evaluation, "EPOCH_BLOCK", block)
    assert sorted(map(tuple, evaluation.running_best(history).collect())) == whole
    assert sorted(map(tuple, evaluation.early_stop_epoch(history).collect())) == stops


def test_ranks_share_and_skip(spark):
    board = spark.createDataFrame(
        [("a", 0.5), ("b", 0.9), ("c", 0.5), ("d", 0.50001), ("e", 0.1)],
        "run string, best_val_acc double",
    )
    ranks = {r["run"]: r["rank"] for r in evaluation.rank_runs(board).collect()}
    assert ranks == {"b": 1, "d": 2, "a": 3, "c": 3, "e": 5}


def test_probability_ranking_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(7, [0.2, 0.4, 0.4])], "doc_id long, probability array<double>")
    rows = evaluation.rank_class_probabilities(df, ["x", "y", "z"]).collect()
    assert [(r["rank"], r["label"], r["probability"]) for r in rows] == [
        (1, "y", 0.4),
        (2, "z", 0.4),
        (3, "x", 0.2),
    ]


def test_attribution_ranking_equals_the_mean_of_rows(spark):
    rows = [(i, [float(i), float(i * i % 5)]) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, features array<double>")
    features = attribution.long_features(df, ["doc_id"])
    coefficients = spark.createDataFrame(
        [("p", 0, 0.5), ("p", 1, -2.0), ("q", 0, 0.0), ("q", 1, 1.0)],
        "class string, feature int, coef double",
    )
    background = attribution.background_means(features)
    per_row = attribution.linear_attribution(features, coefficients, background)
    mean = {
        (r["class"], r["feature"]): r["m"]
        for r in per_row.groupBy("class", "feature")
        .agg(F.avg(F.abs("contribution")).alias("m"))
        .collect()
    }
    ranking = attribution.attribution_ranking(features, coefficients, background).collect()
    assert {(r["class"], r["feature"]): r["importance"] for r in ranking} == pytest.approx(mean)
    sums = per_row.groupBy("class").agg(F.sum("contribution").alias("s")).collect()
    assert [r["s"] for r in sums] == pytest.approx([0.0, 0.0])
    arrays = attribution.attribution_arrays(df, coefficients, background, ["doc_id"])
    exploded = arrays.select("doc_id", "class", F.posexplode("contributions").alias("feature", "contribution"))
    key = lambda r: (r["doc_id"], r["class"], r["feature"])
    want = {key(r): r["contribution"] for r in per_row.collect()}
    assert {key(r): r["contribution"] for r in exploded.collect()} == pytest.approx(want)


def test_missing_labels_and_predictions_follow_one_rule(spark):
    pairs = [("a", "a"), ("a", None), (None, "a"), ("b", "b")]
    df = spark.createDataFrame(pairs, "label string, pred string")
    assert tuple(evaluation.accuracy(df).first()) == (pytest.approx(2 / 3), 3)
    rows = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert set(rows) == {"a", "b", "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"]["f1"] == pytest.approx(2 / 3) and rows["accuracy"]["support"] == 3
    assert rows["a"]["precision"] == 1.0 and rows["a"]["recall"] == 0.5
    counts = {(r["label"], r["pred"]): r["n"] for r in evaluation.confusion_matrix(df).collect()}
    assert counts == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 0, ("b", "b"): 1, ("a", None): 1}
    assert evaluation.macro_f1(df).first()["macro_f1"] == pytest.approx((2 / 3 + 1) / 2)


def test_cross_entropy_leaves_out_unscored_rows_and_refuses_unknown_labels(spark):
    import math

    schema = "label int, probability array<double>, w double"
    good = [(0, [0.5, 0.5], 1.0), (1, None, 5.0), (None, [0.5, 0.5], 5.0), (1, [0.5, None], 5.0)]
    got = evaluation.cross_entropy(spark.createDataFrame(good, schema), weight_col="w").first()
    assert got["loss"] == pytest.approx(math.log(2)) and got["n"] == 1
    with pytest.raises(Exception, match="no probability for label 2"):
        evaluation.cross_entropy(spark.createDataFrame([(2, [0.5, 0.5], 1.0)], schema)).first()


def test_epochs_and_runs_without_scores(spark):
    schema = "run string, epoch int, loss double, train_acc double, val_loss double, val_acc double"
    scores = {"a": [None, 0.4, 0.3, None], "b": [None, None]}
    rows = [
        (run, i, None, None, None if x is None else 1 - x, x)
        for run, xs in scores.items()
        for i, x in enumerate(xs, start=1)
    ]
    df = spark.createDataFrame(rows, schema)
    marked = evaluation.running_best(df).orderBy("run", "epoch").collect()
    assert [r["best_so_far"] for r in marked] == [None, 0.4, 0.4, 0.4, None, None]
    assert [r["improved"] for r in marked] == [False, True, False, False, False, False]
    stops = {r["run"]: tuple(r)[1:] for r in evaluation.early_stop_epoch(df).collect()}
    assert stops == {"a": (4, 2, True), "b": (2, None, False)}
    board = spark.createDataFrame(
        [("a", 0.5), ("b", None), ("c", 0.7), ("d", None)], "run string, best_val_acc double"
    )
    ranks = {r["run"]: r["rank"] for r in evaluation.rank_runs(board).collect()}
    assert ranks == {"c": 1, "a": 2, "b": 3, "d": 3}
