"""Per-class and per-corpus statistics.

Length measures are integers, so exact quantiles are taken from (value, weight) tables: rows
collapse before the shuffle and no class is ever sorted or held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.functions import words as w
from penmark.functions.tokens import alpha_tokens
from penmark.operators.cleaning import value_counts
from penmark.operators.sketches import exact_quantiles
from penmark.session import materialise


def with_lengths(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the three length measures of every text."""
    text = F.col(text_col)
    return df.withColumns(
        {
            "word_count": w.word_count(text),
            "char_count": w.char_count(text),
            "avg_words_per_sentence": w.avg_words_per_sentence(text),
        }
    )


def class_distribution(df: DataFrame, class_col: str = "generated_by") -> DataFrame:
    return (
        df.filter(F.col(class_col).isNotNull())
        .groupBy(class_col)
        .agg(F.count("*").alias("n"))
    )


def class_word_stats(
    df: DataFrame,
    class_col: str = "generated_by",
    text_col: str = "text",
    within: Sequence[str] = ("split",),
) -> DataFrame:
    """Texts, truncated mean, minimum and maximum of words per class and split."""
    return (
        df.filter(F.col(class_col).isNotNull())
        .select(*within, class_col, w.word_count(F.col(text_col)).alias("_wc"))
        .groupBy(*within, class_col)
        .agg(
            F.count("_wc").alias("n"),
            F.avg("_wc").cast("bigint").alias("avg_words"),
            F.min("_wc").alias("min_words"),
            F.max("_wc").alias("max_words"),
        )
    )


def split_sizes(
    df: DataFrame, class_col: str = "generated_by", split_col: str = "split"
) -> DataFrame:
    """Rows per split and the whole-number share per class of the corpus."""
    classes = df.agg(F.countDistinct(class_col)).scalar()
    return (
        df.groupBy(split_col)
        .agg(F.count("*").alias("n"))
        .withColumn("classes", classes)
        .withColumn(
            "per_class", F.floor(F.try_divide(F.col("n"), F.col("classes"))).cast("bigint")
        )
    )


def length_table(lengths: DataFrame, by: Sequence[str]) -> DataFrame:
    """Collapse texts to (by, word_count) with the sums that the summaries need.

    One row per class and word count is left of any number of texts.
    """
    chars, sent = F.col("char_count"), F.col("avg_words_per_sentence")
    return (
        lengths.filter(F.col("char_count").isNotNull())
        .groupBy(*by, F.col("word_count").alias("value"))
        .agg(
            F.count("*").alias("weight"),
            F.sum(chars.cast("decimal(18,0)")).alias("chars"),
            F.sum(chars.cast("decimal(18,0)") * chars.cast("decimal(18,0)")).alias("chars2"),
            F.sum(sent).alias("sents"),
            F.sum(sent * sent).alias("sents2"),
        )
    )


def _mean(total: Column) -> Column:
    return F.try_divide(total.cast("double"), F.sum("weight").cast("double"))


def _std(total: Column, squares: Column) -> Column:
    """Population deviation of integers from exact sums: sqrt(n*S2 - S1^2) / n."""
    n = F.sum("weight").cast("decimal(20,0)")
    total, squares = total.cast("decimal(38,0)"), squares.cast("decimal(38,0)")
    # Around the rounded mean m the sums are small: sum (x - m)^2 = S2 - m (2 S1 - n m), and the
    # deviation from the mean itself differs by (S1 - n m) / n. No product needs over 38 digits.
    mean = F.round(F.try_divide(total, n), 0).cast("decimal(12,0)")
    rest = (total - (n * mean).cast("decimal(38,0)")).cast("decimal(25,0)")
    around = squares - ((total + rest).cast("decimal(26,0)") * mean).cast("decimal(38,0)")
    count = F.sum("weight").cast("double")
    shift = F.try_divide(rest.cast("double"), count)
    variance = F.try_divide(around.cast("double"), count) - shift * shift
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def _word_sums() -> tuple[Column, Column]:
    x = F.col("value").cast("decimal(9,0)")
    weight = F.col("weight").cast("decimal(20,0)")
    return F.sum(x * weight), F.sum(x * x * weight)


def _summaries() -> dict[str, Column]:
    words, words2 = _word_sums()
    chars, chars2 = F.sum("chars"), F.sum("chars2")
    sent_mean = _mean(F.sum("sents"))
    return {
        "word_mean": _mean(words),
        "word_median": F.percentile("value", F.lit(0.5), F.col("weight")),
        "word_std": _std(words, words2),
        "char_mean": _mean(chars),
        "char_std": _std(chars, chars2),
        "sent_len_mean": sent_mean,
        "sent_len_std": F.sqrt(
            F.greatest(_mean(F.sum("sents2")) - sent_mean * sent_mean, F.lit(0.0))
        ),
    }


def corpus_summary(df: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """One row for the whole corpus; ``df`` carries the columns of ``with_lengths``."""
    char_median = value_counts(df, [], F.col("char_count")).agg(
        F.percentile("value", F.lit(0.5), F.col("weight"))
    )
    return length_table(df, [class_col]).agg(
        F.coalesce(F.sum("weight"), F.lit(0)).alias("total"),
        F.countDistinct(class_col).alias("classes"),
        F.min("value").alias("word_min"),
        F.max("value").alias("word_max"),
        *[column.alias(name) for name, column in _summaries().items()],
    ).withColumn("char_median", char_median.scalar())


def class_summary(df: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """One row per class; ``df`` carries the columns of ``with_lengths``."""
    columns = _summaries()
    wanted = ["word_mean", "word_median", "word_std", "char_mean", "sent_len_mean"]
    counts = length_table(df.filter(F.col(class_col).isNotNull()), [class_col])
    return counts.groupBy(class_col).agg(
        F.sum("weight").alias("n"), *[columns[name].alias(name) for name in wanted]
    )


def class_mean_sem(
    df: DataFrame, value: Column, class_col: str = "generated_by"
) -> DataFrame:
    """Mean of an integer per class with its standard error, population deviation over root n."""
    counts = value_counts(df.filter(F.col(class_col).isNotNull()), [class_col], value)
    words, words2 = _word_sums()
    return counts.groupBy(class_col).agg(
        _mean(words).alias("mean"),
        F.try_divide(_std(words, words2), F.sqrt(F.sum("weight"))).alias("sem"),
    )


def continuous_percentile(df: DataFrame, value: str, share: float) -> float | None:
    """The exact percentile, linearly interpolated, of the positive finite values of a column.

    Unlike counts, a continuous measure can have about as many values as rows; sketches narrow the
    interval that is ranked.
    """
    x = F.col(value)
    found = exact_quantiles(df, F.when(x > 0, x), [share]).first()
    return None if found is None else found["quantile"]


def sentence_quartiles(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quartiles of words per sentence; ``df`` carries the columns of ``with_lengths``."""
    return exact_quantiles(df, F.col("avg_words_per_sentence"), (0.25, 0.5, 0.75), by)


LEVELS = (("split", "generated_by"), ("split",), ("generated_by",), ())


def level_summary(
    df: DataFrame, levels: Sequence[Sequence[str]] = LEVELS, split_col: str = "split", class_col: str = "generated_by"
) -> DataFrame:
    """Length statistics of all levels from one scan; ``df`` carries the columns of ``with_lengths``.

    Texts collapse to one row per split, class and word count first, and those rows alone are
    repeated for the levels. ``level`` names the columns that a row is grouped by, joined by a
    comma; the others are null. Rows without a split or class are left out.
    """
    known = df.filter(F.col(split_col).isNotNull() & F.col(class_col).isNotNull())
    counts = length_table(known, [split_col, class_col])
    names = [
        F.when(F.grouping(c) == 0, F.lit(name)) for c, name in ((split_col, "split"), (class_col, "class"))
    ]
    return counts.groupingSets([list(level) for level in levels], split_col, class_col).agg(
        F.concat_ws(",", *names).alias("level"),
        F.sum("weight").alias("n"),
        F.min("value").alias("word_min"),
        F.max("value").alias("word_max"),
        *[column.alias(name) for name, column in _summaries().items()],
    )


def length_percentiles(df: DataFrame) -> DataFrame:
    """Axis limits of the length plots; ``df`` carries the columns of ``with_lengths``."""
    weight = F.col("weight")
    words = value_counts(df, [], F.col("word_count")).agg(
        F.percentile("value", F.array(F.lit(0.99), F.lit(0.995)), weight).alias("q")
    )
    chars = value_counts(df, [], F.col("char_count")).agg(
        F.percentile("value", F.lit(0.99), weight).alias("q")
    )
    # Sentence means are materialised because finding their percentile reads them repeatedly.
    sentences = materialise(df.select("avg_words_per_sentence"), "sentence-means")
    return words.select(
        F.get("q", F.lit(0)).alias("word_p99"),
        F.get("q", F.lit(1)).alias("word_p995"),
        chars.scalar().alias("char_p99"),
        F.lit(continuous_percentile(sentences, "avg_words_per_sentence", 0.99))
        .cast("double")
        .alias("sent_len_p99"),
    )


def boxplot_stats(
    df: DataFrame, value: Column, class_col: str = "generated_by", whisker: float = 1.5
) -> DataFrame:
    """Quartiles, whisker ends and the number of points beyond them, per class."""
    counts = value_counts(df.filter(F.col(class_col).isNotNull()), [class_col], value)
    quartiles = counts.groupBy(class_col).agg(
        F.percentile(
            "value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("weight")
        ).alias("q")
    )
    boxes = quartiles.select(
        class_col, *[F.get("q", F.lit(i)).alias(f"q{i + 1}") for i in range(3)]
    )
    low = F.col("q1") - whisker * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + whisker * (F.col("q3") - F.col("q1"))
    x, weight = F.col("value"), F.col("weight")
    return (
        counts.join(boxes, class_col)
        .groupBy(class_col, "q1", "q2", "q3")
        .agg(
            F.least("q1", F.min(F.when(x >= low, x))).alias("whisker_low"),
            F.greatest("q3", F.max(F.when(x <= high, x))).alias("whisker_high"),
            F.sum(F.when((x < low) | (x > high), weight).otherwise(0)).alias("outliers"),
        )
        .withColumnRenamed("q2", "median")
    )


def vocab_size(
    df: DataFrame, class_col: str = "generated_by", text_col: str = "text", approx: bool = False
) -> DataFrame:
    """Distinct letter-only words per class."""
    word = F.explode_outer(F.array_distinct(alpha_tokens(F.col(text_col)))).alias("word")
    rows = df.filter(F.col(class_col).isNotNull()).select(class_col, word)
    if approx:
        return rows.groupBy(class_col).agg(F.approx_count_distinct("word").alias("vocab"))
    pairs = rows.distinct()
    return pairs.groupBy(class_col).agg(F.count("word").alias("vocab"))


def class_weights(df: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """Balanced weights: rows over classes times class size."""
    sizes = class_distribution(df, class_col)
    total = sizes.agg(F.sum("n")).scalar()
    classes = sizes.agg(F.count("*")).scalar()
    return sizes.select(
        class_col, "n", (total.cast("double") / (classes * F.col("n"))).alias("weight")
    )


def distinct_classes(df: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """Sorted labels, each with its position."""
    labels = df.filter(F.col(class_col).isNotNull()).select(class_col).distinct()
    return labels.orderBy(class_col)


def summary_report(
    lengths: DataFrame, vocabulary: DataFrame, class_col: str = "generated_by"
) -> DataFrame:
    """Per-class table of the summary and the vocabulary sizes, with the corpus total."""
    rows = class_summary(lengths, class_col)
    total = rows.agg(F.sum("n")).scalar()
    return (
        rows.drop("word_std")
        .join(vocabulary, class_col, "left")
        .withColumn("vocab", F.coalesce("vocab", F.lit(0)))
        .withColumn("total", total)
    )
