"""Embeddings, pooling, similarity, assembly and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.catalog.fixtures import (
    corpus,
    table,
    token_vectors,
    token_vectors_sql,
    vectors,
)
from penmark.catalog.registry import query
from penmark.functions.vectors import pad_embedding
from penmark.operators import attribution, neighbours
from penmark.operators import vectors as ops
from penmark.operators.labels import attach_labels as join_labels

LONG = """long AS (
  SELECT vec_id, label, unnest(range(0, len(embedding))) AS feature,
         CAST(unnest(embedding) AS double) AS x FROM embeddings)"""
CENTROIDS = f"""{LONG},
 coefs AS (SELECT label AS class, feature, avg(x) AS coef FROM long GROUP BY 1, 2),
 means AS (SELECT feature, avg(x) AS mean FROM long GROUP BY 1)"""
SCORES = f"""{CENTROIDS},
 products AS (SELECT class AS query_id, vec_id, sum(coef * x) AS dot, sum(coef * coef) AS cc, sum(x * x) AS xx
              FROM long JOIN coefs USING (feature) GROUP BY class, vec_id),
 scores AS (SELECT query_id, vec_id, dot / (sqrt(cc) * sqrt(xx)) AS cosine FROM products)"""


@query(
    "embed_texts",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower('passage: ' || text), '[\\p{L}\\p{N}_]{2,}')) AS token
                  FROM documents),
        b AS (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS bigint) % 64 AS dim, count(*) AS n FROM t GROUP BY 1, 2),
        s AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM b GROUP BY 1)
        SELECT d.doc_id, CAST(i AS integer) AS dim, CAST(CAST(coalesce(n / length, 0) AS float) AS double) AS value
        FROM (SELECT doc_id, unnest(range(0, 64)) AS i FROM documents) d
        LEFT JOIN b ON d.doc_id = b.doc_id AND d.i = b.dim LEFT JOIN s ON d.doc_id = s.doc_id""",
    doubles=["value"],
)
def embed_texts(spark, sf):
    embedded = ops.embed_texts(corpus(spark, sf), dim=64, prefix="passage: ")
    return embedded.select("doc_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query(
    "mean_pool",
    f"""WITH {token_vectors_sql()}, t AS (
          SELECT doc, mask, CAST(unnest(range(0, len(embedding))) AS integer) AS dim,
                 CAST(unnest(embedding) AS double) AS x FROM token_vectors)
        SELECT doc, dim, sum(x) FILTER (mask = 1) / nullif(sum(mask), 0) AS value FROM t GROUP BY doc, dim""",
    doubles=["value"],
)
def mean_pool(spark, sf):
    pooled = ops.mean_pool(token_vectors(spark, sf))
    return pooled.select("doc", F.posexplode("embedding").alias("dim", "value"))


@query(
    "pad_embedding",
    """SELECT vec_id, CAST(i AS integer) AS dim,
              CAST(CASE WHEN i < len(embedding) THEN embedding[i + 1] ELSE 0 END AS double) AS value
       FROM (SELECT vec_id, embedding, unnest(range(0, CAST(ceil(len(embedding) / 48) * 48 AS bigint))) AS i
             FROM embeddings)""",
)
def pad(spark, sf):
    padded = vectors(spark, sf).select("vec_id", pad_embedding(F.col("embedding"), 48).alias("e"))
    return padded.select("vec_id", F.posexplode("e").alias("dim", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


@query(
    "attach_labels",
    """SELECT vec_id, quality, toxic, CAST(i AS integer) AS dim, CAST(embedding[i + 1] AS double) AS value
       FROM (SELECT vec_id, quality, toxic, embedding, unnest(range(0, len(embedding))) AS i
             FROM embeddings JOIN labels ON vec_id = doc_id)""",
)
def attach_labels(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    joined = join_labels(vectors(spark, sf).drop("label"), labels, ids=("vec_id",))
    return joined.select(
        "vec_id", "quality", "toxic", F.posexplode("embedding").alias("dim", "value")
    ).withColumn("value", F.col("value").cast("double"))


def _queries(spark, sf):
    """Query vectors: the mean vector of every label."""
    return ops.centroids(vectors(spark, sf), "label").withColumnRenamed("label", "query_id")


@query(
    "similarity_matrix",
    f"WITH {SCORES} SELECT query_id, vec_id, cosine FROM scores",
    doubles=["cosine"],
)
def similarity_matrix(spark, sf):
    return ops.similarity_matrix(vectors(spark, sf), _queries(spark, sf))


@query(
    "cosine_similarity",
    f"""WITH {SCORES} SELECT query_id, vec_id, cosine, CAST(rank AS integer) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM scores)
        WHERE rank <= 5""",
    doubles=["cosine"],
)
def cosine_similarity(spark, sf):
    return ops.similarity_matrix(vectors(spark, sf), _queries(spark, sf), top_k=5)


@query(
    "assemble_features",
    f"""WITH wide AS (SELECT vec_id, list_concat(list_transform(embedding, lambda x: CAST(x AS double)),
                             [CAST(quality AS double), CAST(toxic AS double)]) AS f
                      FROM embeddings JOIN labels ON vec_id = doc_id)
        SELECT vec_id, CAST(unnest(range(0, len(f))) AS integer) AS feature, unnest(f) AS x FROM wide""",
)
def assemble_features(spark, sf):
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "vec_id")
    joined = join_labels(vectors(spark, sf).drop("label"), labels, ids=("vec_id",))
    wide = ops.assemble_features(joined, "embedding", ["quality", "toxic"])
    return attribution.long_features(wide, ["vec_id"])


def _linear_model(spark, sf):
    """Long features, centroid coefficients per label and background means."""
    rows = vectors(spark, sf)
    features = attribution.long_features(
        rows.select("vec_id", F.col("embedding").cast("array<double>").alias("features")),
        ["vec_id"],
    )
    coefficients = ops.centroids(rows, "label").select(
        F.col("label").alias("class"), F.posexplode("embedding").alias("feature", "coef")
    )
    return features, coefficients, attribution.background_means(features)


@query(
    "linear_attribution",
    f"""WITH {CENTROIDS} SELECT vec_id, class, CAST(feature AS integer) AS feature, coef * (x - mean) AS contribution
        FROM long JOIN coefs USING (feature) JOIN means USING (feature)""",
    doubles=["contribution"],
)
def linear_attribution(spark, sf):
    _, coefficients, background = _linear_model(spark, sf)
    rows = vectors(spark, sf).withColumn("features", F.col("embedding").cast("array<double>"))
    arrays = attribution.attribution_arrays(rows, coefficients, background, ["vec_id"])
    return arrays.select("vec_id", "class", F.posexplode("contributions").alias("feature", "contribution"))


@query(
    "attribution_ranking",
    f"""WITH {CENTROIDS} SELECT class, CAST(feature AS integer) AS feature, avg(abs(coef * (x - mean))) AS importance
        FROM long JOIN coefs USING (feature) JOIN means USING (feature) GROUP BY 1, 2""",
    doubles=["importance"],
)
def attribution_ranking(spark, sf):
    return attribution.attribution_ranking(*_linear_model(spark, sf))


@query(
    "nearest_vectors",
    """WITH units AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double)) AS e FROM embeddings),
        scores AS (
          SELECT q.vec_id AS query_id, d.vec_id AS vec_id, round(list_cosine_similarity(q.e, d.e), 12) AS cosine
          FROM units q, units d WHERE q.vec_id % 50 = 0)
        SELECT query_id, vec_id, cosine,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS integer) AS rank
        FROM scores QUALIFY rank <= 10""",
    doubles=["cosine"],
)
def nearest_vectors(spark, sf):
    """Exact search by cells, for every fiftieth vector against all."""
    rows = vectors(spark, sf)
    asked = rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return neighbours.nearest_vectors(rows, asked, 10)
