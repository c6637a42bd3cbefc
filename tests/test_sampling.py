"""Balancing and sampling invariants, skew and plan shape."""

import hashlib
from collections import Counter

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from penmark.operators import cleaning, sampling
from penmark.plans.recipes import BALANCES, TRANSFORMS, clean_recipe


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; class a has 60 %, class d four rows, one class is null, a third are copies."""
    label = (
        F.when(F.col("doc_id") % 500 == 7, "d")
        .when(F.col("doc_id") % 10 < 6, "a")
        .when(F.col("doc_id") % 10 < 8, "b")
        .when(F.col("doc_id") % 10 < 9, "c")
    )
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("same old text")).otherwise(
        F.concat(F.lit("text "), F.col("doc_id"))
    )
    return (
        spark.range(2000)
        .withColumnRenamed("id", "doc_id")
        .withColumn("generated_by", label)
        .withColumn("text", text)
        .withColumn("split", F.when(F.col("doc_id") % 7 == 0, "val").otherwise("train"))
        .cache()
    )


def place(doc_id, seed=42):
    return int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:15], 16), doc_id


def by_class(df):
    groups = {}
    for r in df.select("generated_by", "doc_id").collect():
        groups.setdefault(r["generated_by"], []).append(r["doc_id"])
    groups.pop(None, None)
    return {c: sorted(ids, key=place) for c, ids in groups.items()}


def test_downsample_is_the_hash_prefix_of_every_class(skewed):
    expected = by_class(skewed)
    n = min(len(ids) for ids in expected.values())
    got = by_class(sampling.downsample(skewed))
    assert {c: ids[:n] for c, ids in expected.items()} == got


def test_downsample_equals_the_window_form(skewed):
    from pyspark.sql import Window

    from penmark.functions.hashing import seeded_hash

    within = ["split", "generated_by"]
    window = Window.partitionBy(*within).orderBy(seeded_hash(42, ["doc_id"]), "doc_id")
    sizes = skewed.filter("generated_by is not null").groupBy(*within).count()
    smallest = sizes.groupBy("split").agg(F.min("count").alias("n"))
    plain = (
        skewed.filter("generated_by is not null")
        .withColumn("r", F.row_number().over(window))
        .join(smallest, "split")
        .filter("r <= n")
    )
    scaled = sampling.downsample(skewed, within=["split"])
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(plain) == ids(scaled)


def test_sampling_by_shuffle_join_gives_the_same_rows(skewed, monkeypatch):
    """The way beyond the broadcast limit."""
    import penmark.bounded as bounded

    expected = by_class(sampling.downsample(skewed))
    monkeypatch.setattr(bounded, "fetch_small", lambda df, limit=0: None)
    assert by_class(sampling.downsample(skewed)) == expected


def test_texts_are_not_shuffled_by_downsampling(skewed, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "generated_by")
    plan = plan_of(sampling.downsample(docs))
    assert "hashpartitioning" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_sample_per_class_and_rows(skewed):
    expected = by_class(skewed)
    got = by_class(sampling.sample_per_class(skewed, 50))
    assert got == {c: ids[:50] for c, ids in expected.items()}
    rows = [r["doc_id"] for r in sampling.sample_rows(skewed, 30).collect()]
    assert sorted(rows, key=place) == sorted(range(2000), key=place)[:30]
    assert sampling.sample_rows(skewed, 5000).count() == 2000


def test_head_per_class(skewed):
    got = by_class(sampling.head_per_class(skewed, 9))
    expected = {c: sorted(sorted(ids)[:9], key=place) for c, ids in by_class(skewed).items()}
    assert got == expected


def test_stratified_split_shares(skewed):
    parts = sampling.stratified_split(skewed)
    assert parts.count() == skewed.filter("generated_by is not null").count()
    counts = {(r[0], r[1]): r[2] for r in parts.groupBy("generated_by", "split").count().collect()}
    for c, ids in by_class(skewed).items():
        n = len(ids)
        assert counts.get((c, "train"), 0) == int(n * 0.7 + 1e-9)
        assert counts.get((c, "val"), 0) == int(n * 0.85 + 1e-9) - int(n * 0.7 + 1e-9)


def test_upsample_draws_like_python(skewed):
    expected = by_class(skewed)
    most = max(len(ids) for ids in expected.values())
    drawn = Counter()
    for c, ids in expected.items():
        for slot in range(most):
            h = int(hashlib.md5(f"42|{c}|{slot}".encode()).hexdigest()[:15], 16)
            drawn[ids[h % len(ids)]] += 1
    rows = sampling.upsample(skewed).select("doc_id", "draw_no").collect()
    assert Counter(r["doc_id"] for r in rows) == drawn
    assert len({tuple(r) for r in rows}) == len(rows) == most * len(expected)


def test_upsample_generates_slots_in_blocks(skewed, monkeypatch):
    expected = sorted(map(tuple, sampling.upsample(skewed).select("doc_id", "draw_no").collect()))
    monkeypatch.setattr(sampling, "SLOT_BLOCK", 7)
    got = sampling.upsample(skewed).select("doc_id", "draw_no")
    assert sorted(map(tuple, got.collect())) == expected


def test_remove_duplicates_keeps_the_first(spark):
    rows = [(3, "x"), (1, "x"), (2, None), (0, None), (4, "y"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in cleaning.remove_duplicates(df).collect())
    assert kept == [0, 1, 4, 5]


def test_hot_copy_is_reduced_before_the_shuffle(skewed):
    plan = plan_of(cleaning.remove_duplicates(skewed))
    assert "partial_min" in plan
    assert cleaning.remove_duplicates(skewed).filter("text = 'same old text'").count() == 1


def test_outliers_at_the_bounds(texts):
    # Quartiles 2 and 4 give bounds -1 and 7, both inclusive.
    sizes = [1, 2, 2, 3, 3, 4, 4, 7, 8]
    df = texts([" ".join("w" * n) for n in sizes] + [None])
    import numpy as np

    q1, q3 = np.percentile(sizes, [25, 75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    expected = [i for i, n in enumerate(sizes) if low <= n <= high]
    got = sorted(r["doc_id"] for r in cleaning.remove_outliers_iqr(df).collect())
    assert got == expected


@pytest.mark.parametrize("transform", TRANSFORMS)
@pytest.mark.parametrize("balance", BALANCES)
def test_recipes_balance_every_split(skewed, transform, balance):
    out = clean_recipe(skewed, transform, balance)
    sizes = {}
    for r in out.groupBy("split", "generated_by").count().collect():
        sizes.setdefault(r["split"], set()).add(r["count"])
    assert all(len(s) == 1 for s in sizes.values())
    texts = {r[0] for r in skewed.select("text").distinct().collect()}
    if transform in ("truncate", "remove_outliers"):
        assert {r[0] for r in out.select("text").distinct().collect()} <= texts


def test_copies_of_one_row_are_dealt_over_tasks(spark):
    rows = [(i, "big") for i in range(100_000)] + [(100_000, "one")]
    df = spark.createDataFrame(rows, "doc_id long, generated_by string").withColumn("text", F.lit("t"))
    drawn = sampling.upsample(df).filter("generated_by = 'one'")
    per_task = drawn.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in per_task) == 100_000 and len(per_task) > 1
    assert drawn.select("draw_no").distinct().count() == 100_000
