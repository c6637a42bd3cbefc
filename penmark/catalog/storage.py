"""Round trips through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.catalog.fixtures import (
    CORPUS,
    HISTORY,
    WORD_RE,
    corpus,
    hash8,
    history,
    sql_hash8,
    vectors,
)
from penmark.catalog.profile import CLASS_SUMMARY, LENGTHS, lengths
from penmark.catalog.registry import query
from penmark.functions.hashing import hash_split
from penmark.functions.words import word_count
from penmark.operators.profile import class_summary
from penmark.plans import report
from penmark.session import new_path
from penmark.sources import corpus as corpora
from penmark.sources import embeddings, runs


@query("load_splits", f"WITH {CORPUS} SELECT doc_id, text, generated_by, split FROM corpus")
def load_splits(spark, sf):
    root = new_path(spark, "splits")
    for split in corpora.SPLITS:
        part = corpus(spark, sf).filter(F.col("split") == split)
        part.select("doc_id", "text", "generated_by").write.parquet(f"{root}/{split}")
    return corpora.load_splits(spark, root, columns=["doc_id", "text", "generated_by"])


@query("select_columns", "SELECT doc_id, lang FROM documents")
def select_columns(spark, sf):
    return corpora.select_columns(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "lang"])


@query("harmonise_schema", "SELECT doc_id, text, lang AS generated_by FROM documents")
def harmonise_schema(spark, sf):
    large = corpus(spark, sf).withColumnsRenamed({"text": "generation", "generated_by": "model"})
    return corpora.harmonise_schema(large, keep=["doc_id"])


@query(
    "union_splits",
    f"WITH {CORPUS} SELECT doc_id, generated_by, split FROM corpus",
)
def union_splits(spark, sf):
    rows = corpus(spark, sf).select("doc_id", "generated_by", "split")
    return corpora.union_splits([rows.filter(F.col("split") == s) for s in corpora.SPLITS])


@query("write_corpus", f"WITH {CORPUS} SELECT doc_id, text, generated_by, split FROM corpus")
def write_corpus(spark, sf):
    path = new_path(spark, "corpus")
    corpora.write_corpus(corpus(spark, sf).drop("source"), path)
    saved = corpora.load_corpus(spark, path)
    # Each split comes from a filter of its own, which reads one folder.
    return corpora.union_splits([saved.filter(F.col("split") == s) for s in corpora.SPLITS])


@query(
    "write_summary_json",
    f"WITH {CORPUS}, {LENGTHS} {CLASS_SUMMARY}",
    doubles=["word_mean", "word_std", "char_mean", "sent_len_mean"],
)
def write_summary_json(spark, sf):
    summary = class_summary(lengths(spark, sf))
    path = new_path(spark, "summary")
    runs.write_summary_json(summary, path)
    return spark.read.schema(summary.schema).json(path)


GLOBAL = {
    "word_count": ("mean", "median", "std", "min", "max"),
    "char_count": ("mean", "median", "std"),
    "avg_words_per_sentence": ("mean", "std"),
}
SQL_STATISTIC = {
    "mean": "avg({})",
    "median": "quantile_cont({}, 0.5)",
    "std": "stddev_pop({})",
    "min": "min({})",
    "max": "max({})",
}
GLOBAL_COLUMNS = [f"global_{measure}_{name}" for measure, names in GLOBAL.items() for name in names]


def sql_global() -> str:
    return ", ".join(
        f"(SELECT {SQL_STATISTIC[name].format(measure)} FROM lengths) AS global_{measure}_{name}"
        for measure, names in GLOBAL.items()
        for name in names
    )


def sql_split_rows() -> str:
    return ", ".join(
        f"(SELECT count(*) FROM lengths WHERE split = '{split}') AS {split}_rows" for split in corpora.SPLITS
    )


@query(
    "summary_document",
    f"""WITH {CORPUS}, {LENGTHS}, s AS ({CLASS_SUMMARY})
        SELECT 'documents' AS dataset, (SELECT count(*) FROM lengths) AS total,
               (SELECT count(DISTINCT generated_by) FROM lengths) AS classes,
               (SELECT string_agg(generated_by, ',' ORDER BY generated_by) FROM s) AS class_list,
               {sql_split_rows()}, {sql_global()},
               generated_by, n, word_mean, word_median, word_std, char_mean, sent_len_mean
        FROM s""",
    doubles=["word_mean", "word_std", "char_mean", "sent_len_mean"]
    + [c for c in GLOBAL_COLUMNS if c.endswith(("mean", "std"))],
)
def summary_document(spark, sf):
    """Every field of the document, read back from JSON."""
    document = report.summary_document(lengths(spark, sf), "documents")
    path = new_path(spark, "summary-document")
    runs.write_summary_json(document, path)
    saved = spark.read.schema(document.schema).json(path)
    return saved.select(
        "dataset",
        "total",
        "classes",
        F.array_join("class_list", ",").alias("class_list"),
        *[F.element_at("splits", split).alias(f"{split}_rows") for split in corpora.SPLITS],
        *[
            F.col(f"global.{measure}.{name}").alias(f"global_{measure}_{name}")
            for measure, names in GLOBAL.items()
            for name in names
        ],
        F.explode("per_class").alias("generated_by", "c"),
    ).select("*", "c.*").drop("c")


@query(
    "append_run_log",
    f"""WITH {HISTORY} SELECT CAST(run AS varchar) AS run, epoch, loss, train_acc, val_acc, NULL::double AS test_accuracy
        FROM history
        UNION ALL SELECT CAST(run AS varchar), NULL, NULL, NULL, NULL, max(val_acc) FROM history GROUP BY run""",
    doubles=["loss", "train_acc", "val_acc", "test_accuracy"],
)
def append_run_log(spark, sf):
    epochs = history(spark, sf).select(
        F.col("run").cast("string"), "epoch", "loss", "train_acc", "val_acc"
    )
    final = epochs.groupBy("run").agg(F.max("val_acc").alias("test_accuracy"))
    path = new_path(spark, "run-log")
    runs.append_run_log(epochs, path)
    runs.append_run_log(final, path)
    return runs.read_run_log(spark, path).select(
        "run", "epoch", "loss", "train_acc", "val_acc", "test_accuracy"
    )


def _run_results(spark, sf):
    """One JSON document per run, built from the run table, written and read back."""
    by_flag = (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy(F.col("l_suppkey").alias("run"), F.col("l_returnflag").alias("class"))
        .agg(
            (F.count(F.when(F.col("l_linestatus") == "F", 1)) / F.count("*")).alias("precision"),
            (F.sum("l_linenumber") / (7 * F.count("*"))).alias("recall"),
            F.count("*").cast("double").alias("support"),
        )
    )
    metrics = F.struct("precision", "recall", F.col("precision").alias("f1-score"), "support")
    # A mean of sorted numbers does not depend on the order of rows, so that equal runs share a rank.
    shares = F.sort_array(F.collect_list("precision"))
    per_class = by_flag.groupBy("run").agg(
        F.map_from_entries(F.collect_list(F.struct("class", metrics))).alias("per_class"),
        (F.aggregate(shares, F.lit(0.0), lambda total, x: total + x) / F.size(shares)).alias("test_accuracy"),
        F.map_from_entries(
            F.collect_list(F.struct("class", (F.ascii("class") - 65).alias("id")))
        ).alias("label2id"),
    )
    epochs = history(spark, sf).groupBy("run").agg(
        F.max("val_acc").alias("best_val_acc"),
        F.sort_array(F.collect_list(F.struct("epoch", "loss", "train_acc", "val_acc"))).alias(
            "training_history"
        ),
    )
    documents = epochs.join(per_class, "run").select(
        F.col("run").cast("string"),
        "best_val_acc",
        F.struct(
            "test_accuracy", "per_class", F.lit("").alias("report_text")
        ).alias("test_stats"),
        "training_history",
        "label2id",
    )
    path = new_path(spark, "run-results")
    documents.write.json(path)
    return runs.read_run_results(spark, path, multi_line=False)


FLAGS = """flags AS (
  SELECT CAST(l_suppkey AS varchar) AS run, l_returnflag AS class,
         count(*) FILTER (l_linestatus = 'F') / count(*) AS precision,
         sum(l_linenumber) / (7 * count(*)) AS recall, CAST(count(*) AS double) AS support
  FROM lineitem GROUP BY 1, 2)"""


@query(
    "read_run_results",
    f"""WITH {HISTORY}, {FLAGS}
        SELECT run, best_val_acc, test_accuracy, CAST(classes AS integer) AS classes, CAST(epochs AS integer) AS epochs
        FROM (SELECT CAST(run AS varchar) AS run, max(val_acc) AS best_val_acc, count(*) AS epochs FROM history GROUP BY 1)
        JOIN (SELECT run, avg(precision) AS test_accuracy, count(*) AS classes FROM flags GROUP BY 1) USING (run)""",
    doubles=["best_val_acc", "test_accuracy"],
)
def read_run_results(spark, sf):
    return runs.run_scores(_run_results(spark, sf))


@query(
    "run_leaderboard",
    f"""WITH {HISTORY}, {FLAGS},
        h AS (SELECT CAST(run AS varchar) AS run, max(val_acc) AS best_val_acc,
                     last(val_acc ORDER BY epoch) AS last_val_acc,
                     last(train_acc ORDER BY epoch) - last(val_acc ORDER BY epoch) AS gap
              FROM history GROUP BY 1),
        t AS (SELECT run, avg(precision) AS test_accuracy FROM flags GROUP BY 1)
        SELECT *, rank() OVER (ORDER BY test_accuracy DESC) AS rank FROM h JOIN t USING (run)""",
    doubles=["test_accuracy", "best_val_acc", "last_val_acc", "gap"],
)
def run_leaderboard(spark, sf):
    return runs.run_leaderboard(_run_results(spark, sf))


@query(
    "run_class_metrics",
    f"WITH {FLAGS} SELECT run, class, precision, recall, precision AS f1, support FROM flags",
    doubles=["precision", "recall", "f1"],
)
def run_class_metrics(spark, sf):
    return runs.run_class_metrics(_run_results(spark, sf))


@query(
    "run_history",
    f"WITH {HISTORY} SELECT CAST(run AS varchar) AS run, epoch, loss, train_acc, val_acc FROM history",
    doubles=["loss", "train_acc", "val_acc"],
)
def run_history(spark, sf):
    return runs.run_history(_run_results(spark, sf))


@query(
    "embedding_store",
    f"""SELECT vec_id, label, 'given' AS encoder, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'val' ELSE 'test' END AS split,
               CAST(i AS integer) AS dim, CAST(embedding[i + 1] AS double) AS value
        FROM (SELECT *, {sql_hash8("vec_id")} % 10 AS b, unnest(range(0, len(embedding))) AS i FROM embeddings)""",
)
def embedding_store(spark, sf):
    path = new_path(spark, "embeddings")
    rows = vectors(spark, sf).withColumn("split", hash_split("vec_id"))
    embeddings.write_embeddings(rows, path, "given")
    embeddings.write_embeddings(rows, path, "again")
    saved = corpora.union_splits(
        [embeddings.read_embeddings(spark, path, "given", s) for s in corpora.SPLITS]
    )
    return saved.select(
        "vec_id", "label", "encoder", "split", F.posexplode("embedding").alias("dim", "value")
    ).withColumn("value", F.col("value").cast("double"))


FIRST_RUN = f"({sql_hash8('doc_id')} % 10) < 7"
CHANGED = f"({sql_hash8('doc_id')} % 10) = 0"


@query(
    "embedding_store_update",
    f"""WITH {CORPUS}, second AS (
          SELECT doc_id, split, CASE WHEN {CHANGED} THEN 'again ' || text ELSE text END AS text,
            {CHANGED} OR NOT {FIRST_RUN} AS encoded FROM corpus)
        SELECT doc_id, split, CAST(len(regexp_extract_all(text, '{WORD_RE}')) AS double) AS words,
          CAST(length(text) AS double) AS chars, (SELECT count(*) FROM corpus WHERE {FIRST_RUN}) AS first_run,
          (SELECT count(*) FROM second WHERE encoded) AS second_run, 0 AS third_run FROM second""",
)
def embedding_store_update(spark, sf):
    """A store in two runs: the second encodes new and changed texts alone, a third one nothing."""
    rows = corpus(spark, sf).select("doc_id", "text", "split")
    bucket = hash8("doc_id") % 10
    changed = rows.withColumn(
        "text", F.when(bucket == 0, F.concat(F.lit("again "), F.col("text"))).otherwise(F.col("text"))
    )
    measure = lambda df: df.withColumn(
        "embedding", F.array(word_count(F.col("text")).cast("float"), F.length("text").cast("float"))
    )
    path = new_path(spark, "embedding-updates")
    encoded = [
        embeddings.update_embeddings(run, path, "lengths", measure)
        for run in (rows.filter(bucket < 7), changed, changed)
    ]
    return embeddings.read_embeddings(spark, path, "lengths").select(
        "doc_id",
        F.col("split").cast("string").alias("split"),
        F.get("embedding", F.lit(0)).cast("double").alias("words"),
        F.get("embedding", F.lit(1)).cast("double").alias("chars"),
        F.lit(encoded[0]).cast("long").alias("first_run"),
        F.lit(encoded[1]).cast("long").alias("second_run"),
        F.lit(encoded[2]).alias("third_run"),
    )
