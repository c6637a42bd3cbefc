"""The nested corpus summary and the nested list of top terms, one JSON document each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.operators.profile import class_summary, corpus_summary


def summary_document(
    lengths: DataFrame, dataset: str, class_col: str = "generated_by", split_col: str = "split"
) -> DataFrame:
    """One row: totals, rows per split, corpus statistics and a map of class statistics.

    Only class and split tables are gathered into maps; they have one entry per class or split.
    """
    per_class = class_summary(lengths, class_col)
    statistics = F.struct(*[c for c in per_class.columns if c != class_col])
    classes = per_class.agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(class_col), statistics)))
    )
    splits = (
        lengths.groupBy(split_col)
        .agg(F.count("*").alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct(split_col, "n"))))
    )
    whole = corpus_summary(lengths, class_col).withColumns(
        {"_per_class": classes.scalar(), "_splits": splits.scalar()}
    )
    part = lambda prefix, names: F.struct(
        *[F.col(f"{prefix}_{name}").alias(name) for name in names]
    )
    return whole.select(
        F.lit(dataset).alias("dataset"),
        F.col("_splits").alias("splits"),
        "total",
        "classes",
        F.sort_array(F.map_keys("_per_class")).alias("class_list"),
        F.struct(
            part("word", ["mean", "median", "std", "min", "max"]).alias("word_count"),
            part("char", ["mean", "median", "std"]).alias("char_count"),
            part("sent_len", ["mean", "std"]).alias("avg_words_per_sentence"),
        ).alias("global"),
        F.col("_per_class").alias("per_class"),
    )


def top_terms_document(terms: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """(class, terms): the ranked terms of each class as an array of (term, mean weight)."""
    entry = F.struct("rank", "term", "mean_tfidf")
    ranked = terms.groupBy(class_col).agg(F.sort_array(F.collect_list(entry)).alias("_t"))
    return ranked.select(
        class_col,
        F.transform(
            "_t", lambda t: F.struct(t["term"].alias("term"), t["mean_tfidf"].alias("mean_tfidf"))
        ).alias("terms"),
    )
