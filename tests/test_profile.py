"""Profiles, densities, labels and scaling against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.functions.words import word_count
from penmark.operators import density, labels, profile, scaling, sketches


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(200):
        words = (i * 7) % 23 + 1
        rows.append((i, "word. " * words, "a" if i % 4 else "b", "train" if i % 5 else "val"))
    rows.append((200, None, "a", "train"))
    rows.append((201, "no class", None, "train"))
    return spark.createDataFrame(
        rows, "doc_id long, text string, generated_by string, split string"
    ).cache()


def counts(corpus, label):
    return np.array(
        [
            len(r["text"].split())
            for r in corpus.filter(F.col("generated_by") == label).collect()
            if r["text"] is not None
        ],
        dtype=float,
    )


def test_class_summary_matches_numpy(corpus):
    for row in profile.class_summary(profile.with_lengths(corpus)).collect():
        x = counts(corpus, row["generated_by"])
        assert row["n"] == len(x)
        assert row["word_mean"] == pytest.approx(x.mean())
        assert row["word_median"] == np.median(x)
        assert row["word_std"] == pytest.approx(x.std())
        assert row["sent_len_mean"] == 1.0


def test_mean_sem_and_boxplot(corpus):
    wc = word_count(F.col("text"))
    for row in profile.class_mean_sem(corpus, wc).collect():
        x = counts(corpus, row["generated_by"])
        assert (row["mean"], row["sem"]) == pytest.approx((x.mean(), x.std() / np.sqrt(len(x))))
    for row in profile.boxplot_stats(corpus, wc, whisker=0.2).collect():
        x = counts(corpus, row["generated_by"])
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        low, high = q1 - 0.2 * (q3 - q1), q3 + 0.2 * (q3 - q1)
        assert (row["q1"], row["median"], row["q3"]) == (q1, q2, q3)
        assert row["whisker_low"] == min(q1, x[x >= low].min())
        assert row["whisker_high"] == max(q3, x[x <= high].max())
        assert row["outliers"] == ((x < low) | (x > high)).sum()


def test_percentiles(corpus):
    row = profile.length_percentiles(profile.with_lengths(corpus)).first()
    x = np.array(
        [len(r["text"].split()) for r in corpus.collect() if r["text"] is not None], dtype=float
    )
    assert row["word_p99"] == pytest.approx(np.percentile(x, 99))
    assert row["word_p995"] == pytest.approx(np.percentile(x, 99.5))


@pytest.mark.parametrize("ranked", [200_000, 3])
def test_continuous_percentile_is_exact(spark, monkeypatch, ranked):
    monkeypatch.setattr(sketches, "RANKED", ranked)
    rng = np.random.default_rng(3)
    x = [float(v) for v in rng.gamma(2.0, 3.0, size=500)] + [7.0] * 100
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (0.0,), (float("inf"),)], "v double")
    for share in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = profile.continuous_percentile(df, "v", share)
        assert got == pytest.approx(np.percentile(x, 100 * share))
    assert profile.continuous_percentile(df.filter("v is null"), "v", 0.5) is None


def test_density_matches_numpy_and_integrates(corpus):
    measured = profile.with_lengths(corpus)
    rows = density.class_density(measured, "word_count", points=50).collect()
    for label in "ab":
        x = counts(corpus, label)
        got = sorted((r["x"], r["density"]) for r in rows if r["generated_by"] == label)
        grid = np.linspace(x.min(), np.percentile(x, 99), 50)
        bw = 0.3 * x.std(ddof=1)
        kernel = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(1)
        assert [g[0] for g in got] == pytest.approx(list(grid))
        assert [g[1] for g in got] == pytest.approx(
            list(kernel / (len(x) * bw * np.sqrt(2 * np.pi)))
        )
    whole = density.length_density(measured, "word_count", points=400)
    for label in "ab":
        got = sorted((r["x"], r["density"]) for r in whole.collect() if r["generated_by"] == label)
        area = np.trapezoid([g[1] for g in got], [g[0] for g in got])
        assert area == pytest.approx(1.0, abs=0.02)


def test_class_weights_and_vocab(corpus):
    weights = {r["generated_by"]: r["weight"] for r in profile.class_weights(corpus).collect()}
    assert weights == pytest.approx({"a": 201 / (2 * 151), "b": 201 / (2 * 50)})
    assert {r["vocab"] for r in profile.vocab_size(corpus).collect()} == {1}


def test_labels_roundtrip_and_unseen(corpus, spark):
    mapping = labels.label_map(corpus)
    assert [tuple(r) for r in mapping.orderBy("label_id").collect()] == [("a", 0), ("b", 1)]
    coded = labels.encode_labels(corpus, mapping)
    back = labels.decode_labels(coded, mapping)
    assert back.filter(~F.col("label").eqNullSafe(F.col("generated_by"))).count() == 0
    unknown = labels.decode_labels(spark.createDataFrame([(9,)], "label_id int"), mapping)
    assert unknown.first()["label"] is None
    other = spark.createDataFrame([(1, "zzz")], "doc_id long, generated_by string")
    with pytest.raises(Exception, match="unseen label: zzz"):
        labels.encode_labels(other, mapping).collect()


def test_standardise_uses_population_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "x double, c double")
    rows = scaling.standardise(df, df, ["x", "c"]).collect()
    x = np.array([1.0, 2.0, 6.0])
    assert [r["x"] for r in rows] == pytest.approx(list((x - x.mean()) / x.std()))
    assert [r["c"] for r in rows] == [0.0, 0.0, 0.0]


def test_label_map_takes_any_number_of_labels(spark):
    rows = spark.range(10_001).select(F.format_string("%06d", "id").alias("generated_by"))
    mapping = labels.label_map(rows).orderBy("label").collect()
    assert [r["label_id"] for r in mapping] == list(range(10_001))
    assert mapping[7]["label"] == "000007"


def test_summaries_hold_counts_beyond_ten_digits(spark):
    from decimal import Decimal

    table = spark.createDataFrame(
        [(100, 20_000_000_000), (300, 20_000_000_000)], "value long, weight long"
    )
    words, words2 = profile._word_sums()
    row = table.agg(
        profile._mean(words).alias("mean"), profile._std(words, words2).alias("std"), words.alias("total")
    ).first()
    assert (row["mean"], row["std"], row["total"]) == (200.0, 100.0, Decimal(8_000_000_000_000))
