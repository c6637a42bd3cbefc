"""Vectors: padding, pooling, similarity and encoders."""

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from penmark.functions.vectors import cosine, pad_embedding
from penmark.operators import vectors as ops


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    rows[3] = (3, [0.0] * 6)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()


def test_pad(vecs):
    assert {len(r["e"]) for r in vecs.select(pad_embedding(F.col("embedding")).alias("e")).collect()} == {8}
    assert {len(r["e"]) for r in vecs.select(pad_embedding(F.col("embedding"), 3).alias("e")).collect()} == {6}


def brute(vecs):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in vecs.collect()}
    with np.errstate(invalid="ignore"):
        return {
            (q, d): float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
            for q, a in rows.items()
            for d, b in rows.items()
        }


def queries(vecs):
    return vecs.withColumnRenamed("vec_id", "query_id")


@pytest.mark.parametrize("block", [1024, 8])
def test_similarity_in_one_or_many_blocks(vecs, monkeypatch, block):
    monkeypatch.setattr(ops, "QUERY_BLOCK", block)
    got = {(r[0], r[1]): r[2] for r in ops.similarity_matrix(vecs, queries(vecs)).collect()}
    expected = brute(vecs)
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] is None if np.isnan(value) else got[key] == pytest.approx(value)


def test_top_k(vecs):
    rows = ops.similarity_matrix(vecs, queries(vecs).filter("query_id < 3"), top_k=4).collect()
    expected = brute(vecs)
    for q in range(3):
        best = sorted(range(40), key=lambda d: -np.nan_to_num(expected[(q, d)], nan=-2))[:4]
        assert [r["vec_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == q] == best


def test_native_cosine_agrees(vecs):
    a = vecs.filter("vec_id = 0").first()["embedding"]
    side = F.array(*[F.lit(float(x)) for x in a])
    rows = vecs.select("vec_id", cosine(F.col("embedding"), side).alias("c")).collect()
    expected = brute(vecs)
    for r in rows:
        assert r["c"] is None if r["vec_id"] == 3 else r["c"] == pytest.approx(expected[(0, r["vec_id"])])


def test_mean_pool_masks(spark):
    rows = [(1, 1, [1.0, 2.0]), (1, 1, [3.0, 6.0]), (1, 0, [99.0, 99.0]), (2, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "doc long, mask int, embedding array<float>")
    got = {r["doc"]: r["embedding"] for r in ops.mean_pool(df).collect()}
    assert got == {1: [2.0, 4.0], 2: [None, None]}


def test_hashed_embedding_is_unit_and_native(texts):
    df = ops.embed_texts(texts(["aa bb aa", "", None]), dim=16)
    assert "EvalPython" not in plan_of(df)
    norms = [float(np.linalg.norm(r["embedding"])) for r in df.orderBy("doc_id").collect()]
    assert norms == pytest.approx([1.0, 0.0, 0.0])


def test_hashed_embedding_reads_the_whole_text(texts):
    start = "aa " * 300
    rows = ops.embed_texts(texts([start + "bb", start + "cc"]), dim=1024).collect()
    assert rows[0]["embedding"] != rows[1]["embedding"]


def test_user_encoder(texts):
    def make():
        def encode(batch):
            return np.array([[len(t), t.count("a")] for t in batch], dtype="float32")

        return encode

    df = ops.encode_with_model(texts(["banana", "x"]), make, prefix="query: ")
    rows = [r["embedding"] for r in df.orderBy("doc_id").collect()]
    assert rows == [[13.0, 3.0], [8.0, 0.0]]
