"""Training-run results and summaries as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.operators.evaluation import rank_runs

# Schema of one run result. It is explicit because inference would turn class names into fields.
RUN_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("best_val_acc", T.DoubleType()),
        T.StructField(
            "test_stats",
            T.StructType(
                [
                    T.StructField("test_accuracy", T.DoubleType()),
                    T.StructField(
                        "per_class",
                        T.MapType(
                            T.StringType(),
                            T.StructType(
                                [
                                    T.StructField("precision", T.DoubleType()),
                                    T.StructField("recall", T.DoubleType()),
                                    T.StructField("f1-score", T.DoubleType()),
                                    T.StructField("support", T.DoubleType()),
                                ]
                            ),
                        ),
                    ),
                    T.StructField("report_text", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "training_history",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("epoch", T.IntegerType()),
                        T.StructField("loss", T.DoubleType()),
                        T.StructField("train_acc", T.DoubleType()),
                        T.StructField("val_acc", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("label2id", T.MapType(T.StringType(), T.IntegerType())),
    ]
)

# Schema of a run log: epoch records, and one final record with the test score.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("train_acc", T.DoubleType()),
        T.StructField("val_acc", T.DoubleType()),
        T.StructField("lr", T.DoubleType()),
        T.StructField("best_val_acc", T.DoubleType()),
        T.StructField("test_accuracy", T.DoubleType()),
        T.StructField("report", T.StringType()),
    ]
)


def write_summary_json(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Save a table as JSON, doubles rounded to ``digits`` if given."""
    if digits is not None:
        df = df.withColumns(
            {
                f.name: F.round(f.name, digits)
                for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            }
        )
    df.write.mode("errorifexists").json(path)


def append_run_log(df: DataFrame, path: str) -> None:
    """Append epoch or final records as JSON lines."""
    df.write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """All records of a log; ``log_epochs`` and ``log_results`` tell their two kinds apart."""
    return spark.read.schema(LOG_SCHEMA).json(path)


def log_epochs(log: DataFrame) -> DataFrame:
    """The epoch records, in the columns of a history."""
    return log.filter(F.col("epoch").isNotNull()).select(
        "run", "epoch", "loss", "train_acc", "val_acc", "lr", "best_val_acc"
    )


def log_results(log: DataFrame) -> DataFrame:
    """The final records with the test score."""
    return log.filter(F.col("epoch").isNull()).select("run", "test_accuracy", "report")


def read_run_results(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per run result. A result without a ``run`` field is named by its folder."""
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    raw = spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).json(path)
    return raw.withColumn("run", F.coalesce("run", folder))


def run_scores(results: DataFrame) -> DataFrame:
    """(run, best_val_acc, test_accuracy, classes, epochs)."""
    return results.select(
        "run",
        "best_val_acc",
        F.col("test_stats.test_accuracy").alias("test_accuracy"),
        F.size("label2id").alias("classes"),
        F.size("training_history").alias("epochs"),
    )


def run_leaderboard(results: DataFrame) -> DataFrame:
    """(run, test_accuracy, best_val_acc, last_val_acc, gap, rank) from the results alone.

    The gap is last training minus last validation accuracy; ranks follow the test accuracy.
    """
    last = F.element_at("training_history", -1)
    board = results.select(
        "run",
        F.col("test_stats.test_accuracy").alias("test_accuracy"),
        "best_val_acc",
        last["val_acc"].alias("last_val_acc"),
        (last["train_acc"] - last["val_acc"]).alias("gap"),
    )
    return rank_runs(board, "test_accuracy")


def run_class_metrics(results: DataFrame) -> DataFrame:
    """(run, class, precision, recall, f1, support) from the per-class map."""
    return results.select(
        "run", F.explode_outer("test_stats.per_class").alias("class", "_m")
    ).select(
        "run",
        "class",
        F.col("_m.precision").alias("precision"),
        F.col("_m.recall").alias("recall"),
        F.col("_m").getField("f1-score").alias("f1"),
        F.col("_m.support").alias("support"),
    )


def run_history(results: DataFrame) -> DataFrame:
    """(run, epoch, loss, train_acc, val_acc), one row per epoch."""
    return results.select("run", F.inline_outer("training_history"))
