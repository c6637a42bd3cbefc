"""Views of the given tables in the shapes the operators expect, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.constants import BLANK_CLASS
from penmark.functions.hashing import hash_split
from penmark.operators.evaluation import softmax

WORD_RE = f"[^{BLANK_CLASS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash8(column: str) -> F.Column:
    digest = F.md5(F.concat_ws("|", F.lit("42"), F.col(column).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def sql_hash8(column: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', '42', cast({column} AS varchar))), 1, 8) AS bigint)"


def sql_hash(*columns: str) -> str:
    parts = ", ".join(["'42'", *[f"cast({c} AS varchar)" for c in columns]])
    return f"cast('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS bigint)"


def sql_words(text: str = "text") -> str:
    return f"regexp_extract_all({text}, '{WORD_RE}')"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a labelled corpus: language is the class, the split comes from a hash."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return documents.select(
        "doc_id",
        "text",
        F.col("lang").alias("generated_by"),
        "source",
        hash_split("doc_id").alias("split"),
    )


CORPUS = f"""corpus AS (
  SELECT doc_id, text, lang AS generated_by, source,
         CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {sql_hash8("doc_id")} % 10 AS b FROM documents))"""


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat_ws(" ", "html", "url").alias("text")
    )


NOISY = "noisy AS (SELECT page_id, concat_ws(' ', html, url) AS text FROM pages)"


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vectors_learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors labelled by the position of the largest of the first four coordinates."""
    first = F.slice("embedding", 1, 4)
    return vectors(spark, sf_dir).select(
        "vec_id",
        "embedding",
        (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("label"),
        hash_split("vec_id").alias("split"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with predictions that are right for about seven rows in ten."""
    bucket = hash8("vec_id") % 10
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("id"),
        "label",
        F.when(bucket < 7, F.col("label"))
        .otherwise((F.col("label") + bucket) % 10)
        .cast("int")
        .alias("pred"),
    )


PREDICTIONS = f"""predictions AS (
  SELECT vec_id AS id, label,
         CAST(CASE WHEN b < 7 THEN label ELSE (label + b) % 10 END AS integer) AS pred
  FROM (SELECT *, {sql_hash8("vec_id")} % 10 AS b FROM embeddings))"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities: softmax over the first ten coordinates, one per label."""
    scores = F.slice("embedding", 1, 10).cast("array<double>")
    return vectors(spark, sf_dir).select("vec_id", "label", softmax(scores).alias("probability"))


PROBABILITIES = """probabilities AS (
  SELECT vec_id, label, class, exp(s) / sum(exp(s)) OVER (PARTITION BY vec_id) AS p
  FROM (SELECT vec_id, label, unnest(range(0, 10)) AS class,
               unnest(list_transform(embedding[1:10], lambda x: CAST(x AS double))) AS s
        FROM embeddings))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-epoch run table from lineitem: suppliers are runs and ship months are epochs."""
    n = F.count("*")
    share = lambda flag: F.count(F.when(flag, 1)) / n
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("run"),
            ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).alias("epoch"),
        )
        .agg(
            (F.sum("l_quantity") / n).alias("loss"),
            share(F.col("l_linestatus") == "F").alias("train_acc"),
            (F.sum("l_linenumber") / n).alias("val_loss"),
            share(F.col("l_returnflag") == "N").alias("val_acc"),
        )
    )


HISTORY = """history AS (
  SELECT l_suppkey AS run, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) AS integer) AS epoch,
         sum(l_quantity) / count(*) AS loss,
         count(*) FILTER (l_linestatus = 'F') / count(*) AS train_acc,
         sum(l_linenumber) / count(*) AS val_loss,
         count(*) FILTER (l_returnflag = 'N') / count(*) AS val_acc
  FROM lineitem GROUP BY 1, 2)"""


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors grouped as four tokens per document, about a fifth of them masked."""
    vec = F.col("vec_id")
    return vectors(spark, sf_dir).select(
        F.floor(vec / 4).alias("doc"),
        (vec % 4).alias("pos"),
        F.when(hash8("vec_id") % 10 < 8, 1).otherwise(0).alias("mask"),
        "embedding",
    )


def token_vectors_sql() -> str:
    return f"""token_vectors AS (
  SELECT vec_id // 4 AS doc, vec_id % 4 AS pos,
         CASE WHEN {sql_hash8("vec_id")} % 10 < 8 THEN 1 ELSE 0 END AS mask, embedding
  FROM embeddings)"""
