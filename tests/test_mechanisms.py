"""Bounded stream state, validated training, exact search by cells, sketches and grouped splits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from penmark.catalog.fixtures import corpus, vectors_learnable
from penmark.operators import evaluation, neighbours, profile, sampling, sketches
from penmark.plans import training
from penmark.session import new_path, remove_path
from penmark.sources import embeddings
from penmark.streaming.deduplication import BoundedDeduplication, deduplicate_stream

SMALL = "/root/testdata/sf0.001"
DAY = 86_400


# --- streams ------------------------------------------------------------------------------------


EVENTS = "doc_id long, text string, at timestamp"
FILES = [
    [(1, "a", "2024-01-10"), (2, "b", "2024-01-10"), (3, "a", "2024-01-09"), (4, None, "2024-01-10")],
    # Ten days later: 5 repeats a live text, 6 is late and unique, 7 late and repeated.
    [(5, "b", "2024-01-11"), (6, "c", "2024-01-01"), (7, "b", "2024-01-01"), (8, "d", "2024-01-20"), (9, None, None)],
    # The texts of January 10 are forgotten by now.
    [(10, "a", "2024-01-21"), (11, "d", "2024-01-21"), (12, "e", "2024-01-22"), (13, "a", "2024-01-22")],
    [(14, "f", "2024-03-01")],
    [(15, "g", "2024-05-01"), (16, "f", "2024-05-01")],  # f was new in the latest events so far
]


def arrive(spark, source, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, at string")
    frame.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(EVENTS).parquet(source)


def test_stream_state_is_bounded(spark):
    source, out, state = (new_path(spark, x) for x in ("events", "outcomes", "state"))
    sizes = []
    for rows in FILES:
        job = deduplicate_stream(arrive(spark, source, rows), out, state, ["doc_id"], "at", 5 * DAY)
        sizes.append(job.state_size(spark))
    ids = lambda name: sorted(r["doc_id"] for r in job.read(spark, name).collect())
    assert ids("first") == [2, 3, 4, 8, 10, 12, 14, 15]
    assert ids("repeated") == [1, 5, 9, 11, 13, 16]
    assert {(r["doc_id"], r["known"]) for r in job.read(spark, "late").collect()} == {(6, False), (7, True)}
    assert sum(len(ids(x)) for x in ("first", "repeated", "late")) == sum(map(len, FILES))
    # Every text that was ever new would be 8 keys; forgotten ones are gone.
    assert sizes == [3, 4, 3, 4, 2]
    texts = {r["doc_id"]: r["text"] for r in job.read(spark, "first").collect()}
    assert texts[3] == "a" and texts[4] is None


def test_stream_batch_can_be_tried_again(spark):
    out = new_path(spark, "retried")
    job = BoundedDeduplication(out, ("doc_id",), "at", 5 * DAY)
    frames = [
        spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.to_timestamp("at"))
        for rows in FILES
    ]
    for batch, frame in enumerate(frames[:3]):
        job.merge(frame, batch)
        job.merge(frame, batch)  # as after a lost driver
    ids = lambda name: sorted(r["doc_id"] for r in job.read(spark, name).collect())
    assert ids("first") == [2, 3, 4, 8, 10, 12] and ids("repeated") == [1, 5, 9, 11, 13] and ids("late") == [6, 7]
    job.merge(frames[0].limit(0), 3)
    assert job.state_size(spark) == 3


def test_removing_a_missing_path(spark):
    remove_path(spark, new_path(spark, "nothing"))


def test_a_batch_computes_its_rows_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def noted(text):
        computed.add(1)
        return text

    rows = spark.range(40).selectExpr(
        "id doc_id", "cast(id % 30 as string) text", "timestamp_seconds(id * 86400) at"
    )
    rows = rows.withColumn("text", F.udf(noted, "string")("text"))
    job = BoundedDeduplication(new_path(spark, "once"), ("doc_id",), "at", 5 * DAY)
    job.merge(rows.filter("doc_id < 20 or doc_id > 37"), 0)
    assert computed.value == 22
    job.merge(rows.filter("doc_id between 20 and 37"), 1)
    assert computed.value == 40
    late = {r["doc_id"] for r in job.read(spark, "late").collect()}
    assert late == set(range(20, 34)) and job.read(spark, "first").count() == 24


# --- training -----------------------------------------------------------------------------------


def test_training_keeps_the_best_block(spark, monkeypatch):
    rows = vectors_learnable(spark, SMALL)
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    trained = training.train_with_validation(
        train, val, hidden=(16,), block_iter=6, max_blocks=12, patience=2
    )
    history = trained.table(spark, "r")
    best = evaluation.best_epoch(history).first()
    stop = evaluation.early_stop_epoch(history, 2, "val_acc", "max").first()
    assert best["best_epoch"] == trained.best_epoch == stop["restore_epoch"]
    assert stop["stop_epoch"] == len(trained.history) and stop["stopped_early"] == trained.stopped_early
    losses = [h["loss"] for h in trained.history]
    assert losses[-1] < losses[0] and len(losses) > 1  # each block goes on from the one before
    scored = trained.best.pipeline.transform(training.with_vectors(val)).withColumn(
        "label", F.col("label").cast("string")
    )
    restored = evaluation.accuracy(scored, "label", "predicted_label").first()["accuracy"]
    assert math.isclose(restored, best["best_val_acc"])
    # Blocks add up to one longer training.
    once = training.train_with_validation(train, val, hidden=(16,), block_iter=60, max_blocks=1)
    assert once.best_epoch == 1 and len(once.history) == 1
    with pytest.raises(ValueError):
        training.train_with_validation(train, val, monitor="train_acc")


def test_weighted_training_scales_by_the_population(spark):
    rows = [(float(i), float(i % 3), "ab"[i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "x double, y double, generated_by string")
    trained = training.train_weighted_classifier(df, ["x", "y"])
    scaled = trained.pipeline.transform(df).select("features").collect()
    values = np.array([r["features"].toArray() for r in scaled])
    assert np.allclose(values.mean(axis=0), 0) and np.allclose(values.std(axis=0), 1)


# --- nearest vectors ----------------------------------------------------------------------------


def brute_neighbours(docs, queries, k):
    out = set()
    for q, v in queries.items():
        found = []
        for d, w in docs.items():
            cosine = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
            found.append((-round(cosine, 12), d))
        out |= {(q, r, d) for r, (_, d) in enumerate(sorted(found)[:k], 1)}
    return out


def frame(spark, vectors, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], f"{name} long, embedding array<double>")


@pytest.mark.parametrize("cells", [1, 7, None])
def test_neighbours_equal_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(neighbours, "SHARD", 50)
    rng = np.random.default_rng(11)
    docs = {i: rng.normal(size=12) for i in range(400)}
    for i in range(150, 290):  # a third are copies of one vector, up to length
        docs[i] = docs[5] * (1 + i % 3)
    queries = {1000 + i: rng.normal(size=12) for i in range(15)} | {5: docs[5], 6: -docs[5]}
    got = neighbours.nearest_vectors(frame(spark, docs, "vec_id"), frame(spark, queries, "query_id"), 12, cells=cells)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()} == brute_neighbours(docs, queries, 12)


def test_neighbours_skip_distant_cells(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    docs = {i: centers[i % 40] + 0.05 * rng.normal(size=16) for i in range(4000)}
    queries = {i: docs[i] for i in range(0, 4000, 40)} | {i: docs[i] for i in range(7, 4000, 80)}
    index = neighbours.build_index(frame(spark, docs, "vec_id"))
    found = neighbours.search_index(index, frame(spark, queries, "query_id"), 10)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found.rows.collect()} == brute_neighbours(docs, queries, 10)
    assert found.compared_pairs(index) < 0.5 * len(docs) * len(queries)


def test_neighbours_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1e-300, 0.0]), (7, [1e300, 1e300]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, schema)
    queries = docs.withColumnRenamed("vec_id", "query_id")
    got = neighbours.nearest_vectors(docs, queries, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(1, 1), (1, 6), (1, 7), (6, 1), (6, 6), (6, 7), (7, 7), (7, 1), (7, 6)]
    assert neighbours.nearest_vectors(docs.limit(0), queries, 5).collect() == []
    assert neighbours.nearest_vectors(docs, queries.limit(0), 5).collect() == []


# --- quantiles, distinct counts, levels ---------------------------------------------------------


SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0)


@pytest.mark.parametrize("ranked", [40, 200_000])
def test_quantiles_are_exact(spark, monkeypatch, ranked):
    monkeypatch.setattr(sketches, "RANKED", ranked)
    rng = np.random.default_rng(2)
    groups = {
        "wide": np.append(rng.random(20_000), 1e12),  # one value far beyond all others
        "tied": np.repeat([1.5, 2.5, 2.5], 4000),
        "skewed": rng.lognormal(0, 4, 9000),
        "one": np.array([-3.25]),
    }
    rows = [(g, float(x)) for g, values in groups.items() for x in values]
    rows += [("one", None), ("one", float("nan")), ("one", float("inf")), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["share"]): r["quantile"] for r in sketches.exact_quantiles(df, F.col("x"), SHARES, ["g"]).collect()}
    assert set(got) == {(g, s) for g in groups for s in SHARES}
    for (g, share), value in got.items():
        assert math.isclose(value, np.quantile(groups[g], share), rel_tol=1e-12), (g, share)
    whole = np.concatenate(list(groups.values()))
    for r in sketches.exact_quantiles(df, F.col("x"), SHARES).collect():
        assert math.isclose(r["quantile"], np.quantile(whole, r["share"]), rel_tol=1e-12) and r["n"] == len(whole)
    assert sketches.exact_quantiles(df.limit(0), F.col("x"), SHARES, ["g"]).collect() == []
    assert sketches.exact_quantiles(df.filter("g = 'none'"), F.col("x"), SHARES).collect() == []


def test_an_interval_that_misses_its_rank_is_widened(spark, monkeypatch):
    monkeypatch.setattr(sketches, "MARGIN", -0.2)  # intervals beside the wanted ranks
    values = np.random.default_rng(4).random(5000)
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    for r in sketches.exact_quantiles(df, F.col("x"), SHARES).collect():
        assert math.isclose(r["quantile"], np.quantile(values, r["share"]), rel_tol=1e-12)


def test_sketches_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 5).alias("g"), F.sqrt("id").alias("x"))
    stored = sketches.quantile_sketches(df, F.col("x"), ["g"])
    row = sketches.merged_quantiles(stored, [], SHARES).first()
    assert row["n"] == 60_000
    for share, value in zip(SHARES, row["quantiles"], strict=True):
        assert abs(value**2 / 59_999 - share) <= 2 * sketches.RANK_ERROR
    texts = spark.range(3000).select((F.col("id") % 3).alias("g"), F.concat_ws(" ", *[
        F.translate((F.col("id") + i).cast("string"), "0123456789", "abcdefghij") for i in range(8)
    ]).alias("text"))
    words = sketches.vocabulary_sketches(texts, ["g"])
    exact = texts.select(F.explode(F.split("text", " "))).distinct().count()
    estimate = sketches.merged_vocabulary(words).first()["vocab"]
    assert abs(estimate - exact) <= 3 * sketches.DISTINCT_ERROR * exact


def test_levels_come_from_one_scan(spark):
    plan = plan_of(profile.level_summary(profile.with_lengths(corpus(spark, SMALL))), "simple")
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan


# --- splits -------------------------------------------------------------------------------------


def test_no_text_is_in_two_splits(spark):
    rows = [(i, f"text {i}" if i % 3 else "copied", "xy"[i % 2]) for i in range(900)]
    rows += [(1000, None, "x"), (1001, None, "y"), (1002, "alone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, generated_by string")
    got = sampling.grouped_split(df).collect()
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in rows[:-1]]
    splits = {}
    for r in got:
        splits.setdefault(r["text"], set()).add(r["split"])
    assert all(len(s) == 1 for s in splits.values())
    # The largest group, a third of all rows, counts for the class of its first row.
    for name, share in (("train", 0.7), ("val", 0.15), ("test", 0.15)):
        assert abs(sum(r["split"] == name for r in got) - share * len(got)) <= 301
    distinct = df.filter("text <> 'copied'")
    got = sampling.grouped_split(distinct).collect()
    for label in "xy":
        own = [r["split"] for r in got if r["generated_by"] == label]
        assert abs(own.count("train") - 0.7 * len(own)) <= 2 and abs(own.count("val") - 0.15 * len(own)) <= 2


def test_groups_may_be_given(spark):
    df = spark.range(200).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("c").alias("generated_by")
    )
    got = sampling.grouped_split(df, F.floor(F.col("doc_id") / 4).cast("string")).collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["doc_id"] // 4, set()).add(r["split"])
    assert len(by_group) == 50 and all(len(s) == 1 for s in by_group.values())


# --- embedding store ----------------------------------------------------------------------------


def test_only_new_or_changed_texts_are_encoded(spark):
    path, encoded = new_path(spark, "store"), []

    def encode(df):
        encoded.append(sorted(r["doc_id"] for r in df.select("doc_id").collect()))
        return df.withColumn("embedding", F.array(F.length("text").cast("float")))

    schema = "doc_id long, text string, split string"
    day1 = [(1, "a", "train"), (2, "bb", "train"), (3, "ccc", "val"), (4, None, "val")]
    day2 = [(1, "a", "train"), (2, "changed", "train"), (3, "ccc", "val"), (4, None, "val"), (5, "new", "test")]
    run = lambda rows, name="len": embeddings.update_embeddings(
        spark.createDataFrame(rows, schema), path, name, encode
    )
    assert run(day1) == 4 and run(day1) == 0 and run(day2) == 2
    assert encoded == [[1, 2, 3, 4], [], [2, 5]]
    read = lambda name: {
        r["doc_id"]: r["embedding"] for r in embeddings.read_embeddings(spark, path, name).collect()
    }
    assert read("len") == {1: [1.0], 2: [7.0], 3: [3.0], 4: [None], 5: [3.0]}
    assert run(day2[:2], "other") == 2 and len(read("len")) == 5
    moved = [(1, "a", "test"), *day2[1:]]
    assert run(moved) == 1 and len(read("len")) == 5
