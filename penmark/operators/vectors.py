"""Embeddings: hashed text vectors, pooling, padding, similarity and feature assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.bounded import fetch_small
from penmark.functions.tokens import vectoriser_tokens
from penmark.functions.words import prefix_text

QUERY_BLOCK = 1024


def embed_texts(
    df: DataFrame,
    dim: int = 64,
    text_col: str = "text",
    prefix: str = "",
    out: str = "embedding",
) -> DataFrame:
    """Append a dense unit vector of hashed token counts of the whole text.

    The default encoder: JVM-side, row by row, no shuffle and no external weights. A token counts
    in the place that the first 32 bits of its MD5 give, modulo ``dim``.
    """
    text = prefix_text(F.col(text_col), prefix) if prefix else F.col(text_col)
    tokens = vectoriser_tokens(F.coalesce(text, F.lit("")))
    place = lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim
    counter = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(dim)], inputCol="_tokens", outputCol="_tf"
    )
    hashed = counter.transform(
        df.withColumn("_tokens", F.transform(tokens, lambda t: place(t).cast("string")))
    )
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_tokens", "_tf", "_unit"
    )


def encode_with_model(
    df: DataFrame,
    make_encoder: Callable[[], Callable],
    batch_size: int = 8,
    text_col: str = "text",
    prefix: str = "",
    out: str = "embedding",
) -> DataFrame:
    """Append vectors from a user's batch encoder, loaded once per Python worker."""
    encode = predict_batch_udf(
        make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    text = prefix_text(F.col(text_col), prefix) if prefix else F.col(text_col)
    return df.withColumn(out, encode(text))


def mean_pool(
    tokens: DataFrame,
    ids: Sequence[str] = ("doc",),
    embedding_col: str = "embedding",
    mask_col: str = "mask",
) -> DataFrame:
    """Mean of the token vectors whose mask is 1, per document.

    Vectors are summed by a partial and a final aggregate, one buffer per document. A document
    without an unmasked token gets nulls.
    """
    vector = F.when(F.col(mask_col) == 1, F.col(embedding_col).cast("array<double>")).otherwise(
        F.transform(embedding_col, lambda _: F.lit(0.0).cast("double"))
    )
    sums = (
        tokens.withColumn("_v", array_to_vector(vector))
        .groupBy(*ids)
        .agg(
            Summarizer.sum(F.col("_v")).alias("_sum"),
            F.sum(F.when(F.col(mask_col) == 1, 1).otherwise(0)).alias("_n"),
        )
        .withColumn("_sum", vector_to_array("_sum"))
    )
    return sums.select(
        *ids, F.transform("_sum", lambda x: F.try_divide(x, F.col("_n"))).alias(embedding_col)
    )


def assemble_features(
    df: DataFrame, embedding_col: str, columns: Sequence[str], out: str = "features"
) -> DataFrame:
    """Append the embedding followed by the scalar columns, as one array of doubles."""
    scalars = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(out, F.concat(F.col(embedding_col).cast("array<double>"), scalars))


def _score_block(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str,
    query_id: str,
    embedding_col: str,
    top_k: int | None,
) -> DataFrame:
    import numpy as np
    import pyarrow as pa

    table = queries.select(query_id, embedding_col).toArrow()
    query_ids = table.column(query_id).combine_chunks()
    matrix = np.array(table.column(embedding_col).to_pylist(), dtype="float64")
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = matrix / lengths

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0)
            vectors = np.asarray(batch.column(1).flatten()).astype("float64")
            vectors = vectors.reshape(batch.num_rows, -1)
            with np.errstate(divide="ignore", invalid="ignore"):
                vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
                scores = vectors @ matrix.T
            if top_k is not None and top_k < len(vectors):
                # Keep everything up to the k-th score of the batch, ties included: the final
                # ranking breaks them by identity.
                filled = np.nan_to_num(scores, nan=-2.0)
                cut = np.partition(filled, len(filled) - top_k, axis=0)[len(filled) - top_k]
                rows, columns = np.nonzero(filled >= cut)
            else:
                rows, columns = np.indices(scores.shape).reshape(2, -1)
            values = scores[rows, columns]
            yield pa.RecordBatch.from_arrays(
                [
                    query_ids.take(pa.array(columns)),
                    ids.take(pa.array(rows)),
                    pa.array(values, mask=np.isnan(values)),
                ],
                names=[query_id, doc_id, "cosine"],
            )

    schema = T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(doc_id, docs.schema[doc_id].dataType),
            T.StructField("cosine", T.DoubleType()),
        ]
    )
    usable = docs.select(doc_id, F.col(embedding_col)).filter(F.col(embedding_col).isNotNull())
    return usable.mapInArrow(score, schema)


def similarity_matrix(
    docs: DataFrame,
    queries: DataFrame,
    doc_id: str = "vec_id",
    query_id: str = "query_id",
    embedding_col: str = "embedding",
    top_k: int | None = None,
) -> DataFrame:
    """Cosine of every query with every document, or of the ``top_k`` documents per query.

    Documents stream through a matrix product per Arrow batch; only query vectors travel, in
    blocks of at most ``QUERY_BLOCK``. More queries take more passes, never a larger broadcast.
    A vector of length zero has no cosine.
    """
    local = fetch_small(queries.select(query_id, embedding_col), QUERY_BLOCK)
    if local is not None:
        blocks = [local]
    else:
        number = queries.count() // (QUERY_BLOCK // 2) + 1
        block = F.pmod(F.xxhash64(query_id), F.lit(number))
        blocks = [queries.filter(block == i) for i in range(number)]
    scored = None
    for part in blocks:
        result = _score_block(docs, part, doc_id, query_id, embedding_col, top_k)
        scored = result if scored is None else scored.unionByName(result)
    if top_k is None:
        return scored
    best = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("cosine"), doc_id)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def centroids(df: DataFrame, class_col: str, embedding_col: str = "embedding") -> DataFrame:
    """Mean vector of every class."""
    return (
        df.withColumn("_v", array_to_vector(F.col(embedding_col).cast("array<double>")))
        .groupBy(class_col)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(embedding_col))
    )
