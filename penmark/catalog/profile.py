"""Corpus and class statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.catalog.fixtures import CORPUS, corpus, sql_hash, sql_words
from penmark.catalog.registry import query, register
from penmark.catalog.text import ALPHA, AVG_SENT, sql_count_chars
from penmark.constants import DENSITY_PUNCTUATION, TERM_SAMPLE
from penmark.functions.style import punctuation_density
from penmark.functions.words import word_count
from penmark.operators import density, profile, sampling, sketches
from penmark.session import materialise

LENGTHS = f"""lengths AS (
  SELECT *, len({sql_words()}) AS word_count, length(text) AS char_count,
         {AVG_SENT} AS avg_words_per_sentence FROM corpus)"""
WITH = f"WITH {CORPUS}, {LENGTHS}"


def lengths(spark, sf):
    return profile.with_lengths(corpus(spark, sf)).drop("text")


@query(
    "class_distribution",
    f"WITH {CORPUS} SELECT generated_by, count(*) AS n FROM corpus GROUP BY generated_by",
)
def class_distribution(spark, sf):
    return profile.class_distribution(corpus(spark, sf))


@query(
    "class_word_stats",
    f"""{WITH} SELECT split, generated_by, count(*) AS n,
          CAST(floor(avg(word_count)) AS bigint) AS avg_words,
          min(word_count) AS min_words, max(word_count) AS max_words
        FROM lengths GROUP BY split, generated_by""",
)
def class_word_stats(spark, sf):
    return profile.class_word_stats(corpus(spark, sf))


@query(
    "split_sizes",
    f"""WITH {CORPUS} SELECT split, count(*) AS n,
          (SELECT count(DISTINCT generated_by) FROM corpus) AS classes,
          count(*) // (SELECT count(DISTINCT generated_by) FROM corpus) AS per_class
        FROM corpus GROUP BY split""",
)
def split_sizes(spark, sf):
    return profile.split_sizes(corpus(spark, sf))


@query(
    "corpus_summary",
    f"""{WITH} SELECT count(*) AS total, count(DISTINCT generated_by) AS classes,
          min(word_count) AS word_min, max(word_count) AS word_max,
          avg(word_count) AS word_mean, quantile_cont(word_count, 0.5) AS word_median,
          stddev_pop(word_count) AS word_std,
          avg(char_count) AS char_mean, stddev_pop(char_count) AS char_std,
          avg(avg_words_per_sentence) AS sent_len_mean,
          stddev_pop(avg_words_per_sentence) AS sent_len_std,
          quantile_cont(char_count, 0.5) AS char_median FROM lengths""",
    doubles=["word_mean", "word_std", "char_mean", "char_std", "sent_len_mean", "sent_len_std"],
)
def corpus_summary(spark, sf):
    return profile.corpus_summary(lengths(spark, sf))


CLASS_SUMMARY = """SELECT generated_by, count(*) AS n, avg(word_count) AS word_mean,
  quantile_cont(word_count, 0.5) AS word_median, stddev_pop(word_count) AS word_std,
  avg(char_count) AS char_mean, avg(avg_words_per_sentence) AS sent_len_mean
  FROM lengths GROUP BY generated_by"""


@query(
    "class_summary",
    f"{WITH} {CLASS_SUMMARY}",
    doubles=["word_mean", "word_std", "char_mean", "sent_len_mean"],
)
def class_summary(spark, sf):
    return profile.class_summary(lengths(spark, sf))


@query(
    "class_mean_sem",
    f"""{WITH} SELECT generated_by, avg(word_count) AS mean,
          stddev_pop(word_count) / sqrt(count(*)) AS sem FROM lengths GROUP BY generated_by""",
    doubles=["mean", "sem"],
)
def class_mean_sem(spark, sf):
    return profile.class_mean_sem(corpus(spark, sf), word_count(F.col("text")))


@query(
    "length_percentiles",
    f"""{WITH} SELECT quantile_cont(word_count, 0.99) AS word_p99,
          quantile_cont(word_count, 0.995) AS word_p995,
          quantile_cont(char_count, 0.99) AS char_p99,
          quantile_cont(avg_words_per_sentence, 0.99) FILTER (avg_words_per_sentence > 0) AS sent_len_p99
        FROM lengths""",
    doubles=["word_p99", "word_p995", "char_p99", "sent_len_p99"],
)
def length_percentiles(spark, sf):
    return profile.length_percentiles(lengths(spark, sf))


@query(
    "sentence_quartiles",
    f"""{WITH} SELECT split, generated_by, share, count(*) AS n,
          CASE share WHEN 0.25 THEN quantile_cont(avg_words_per_sentence, 0.25)
            WHEN 0.5 THEN quantile_cont(avg_words_per_sentence, 0.5)
            ELSE quantile_cont(avg_words_per_sentence, 0.75) END AS quantile
        FROM lengths, (VALUES (0.25::double), (0.5::double), (0.75::double)) shares(share) GROUP BY split, generated_by, share""",
    doubles=["quantile"],
)
def sentence_quartiles(spark, sf):
    return profile.sentence_quartiles(lengths(spark, sf), ["split", "generated_by"])


@query(
    "sentence_quartiles_sketched",
    f"""{WITH} SELECT generated_by, count(*) AS n, true AS close FROM lengths GROUP BY generated_by""",
)
def sentence_quartiles_sketched(spark, sf):
    """Per class, whether quartiles from united sketches of the splits keep their rank error."""
    rows = lengths(spark, sf)
    x = F.col("avg_words_per_sentence")
    shares = (0.25, 0.5, 0.75)
    stored = materialise(sketches.quantile_sketches(rows, x, ["split", "generated_by"]), "sketches")
    quantiles = sketches.merged_quantiles(stored, ["generated_by"], shares)
    ranked = rows.join(quantiles, "generated_by").groupBy("generated_by", "n").agg(
        *[F.avg((x < F.col("quantiles")[i]).cast("double")).alias(f"below{i}") for i in range(3)],
        *[F.avg((x <= F.col("quantiles")[i]).cast("double")).alias(f"upto{i}") for i in range(3)],
    )
    close = F.lit(True)
    for i, share in enumerate(shares):
        error = sketches.RANK_ERROR
        close &= (F.col(f"below{i}") <= share + error) & (F.col(f"upto{i}") >= share - error)
    return ranked.select("generated_by", "n", close.alias("close"))


@query(
    "level_summary",
    f"""{WITH} SELECT split, generated_by,
          concat_ws(',', CASE WHEN grouping(split) = 0 THEN 'split' END,
            CASE WHEN grouping(generated_by) = 0 THEN 'class' END) AS level,
          count(*) AS n, min(word_count) AS word_min, max(word_count) AS word_max,
          avg(word_count) AS word_mean, quantile_cont(word_count, 0.5) AS word_median,
          stddev_pop(word_count) AS word_std, avg(char_count) AS char_mean, stddev_pop(char_count) AS char_std,
          avg(avg_words_per_sentence) AS sent_len_mean, stddev_pop(avg_words_per_sentence) AS sent_len_std
        FROM lengths GROUP BY GROUPING SETS ((split, generated_by), (split), (generated_by), ())""",
    doubles=["word_mean", "word_std", "char_mean", "char_std", "sent_len_mean", "sent_len_std"],
)
def level_summary(spark, sf):
    return profile.level_summary(lengths(spark, sf))


@query(
    "boxplot_stats",
    f"""{WITH}, q AS (
          SELECT generated_by, quantile_cont(word_count, 0.25) AS q1,
                 quantile_cont(word_count, 0.5) AS median, quantile_cont(word_count, 0.75) AS q3
          FROM lengths GROUP BY generated_by),
        b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
        SELECT generated_by, q1, median, q3,
               least(q1, min(word_count) FILTER (word_count >= low)) AS whisker_low,
               greatest(q3, max(word_count) FILTER (word_count <= high)) AS whisker_high,
               count(*) FILTER (word_count < low OR word_count > high) AS outliers
        FROM lengths JOIN b USING (generated_by) GROUP BY generated_by, q1, median, q3""",
)
def boxplot_stats(spark, sf):
    return profile.boxplot_stats(corpus(spark, sf), word_count(F.col("text")))


def sql_sample(k: int, source: str) -> str:
    return f"""(SELECT * FROM {source} QUALIFY row_number() OVER (
      PARTITION BY generated_by ORDER BY {sql_hash("doc_id")}, doc_id) <= {k})"""


VOCAB = f"""(SELECT generated_by, count(DISTINCT word) AS vocab FROM (
  SELECT generated_by, unnest({ALPHA}) AS word FROM {sql_sample(5000, "corpus")})
  GROUP BY generated_by)"""


def vocabulary(spark, sf):
    return profile.vocab_size(sampling.sample_per_class(corpus(spark, sf), TERM_SAMPLE))


@query("vocab_size", f"WITH {CORPUS} SELECT * FROM {VOCAB}")
def vocab_size(spark, sf):
    return vocabulary(spark, sf)


@query(
    "vocab_size_sketched",
    f"""WITH {CORPUS}, words AS (SELECT generated_by, unnest({ALPHA}) AS word FROM corpus)
        SELECT generated_by, count(DISTINCT word) AS vocab, true AS close FROM words GROUP BY GROUPING SETS ((generated_by), ())""",
)
def vocab_size_sketched(spark, sf):
    """Exact sizes per class and of the corpus, and whether united sketches come within three errors."""
    rows = corpus(spark, sf)
    stored = materialise(sketches.vocabulary_sketches(rows, ["split", "generated_by"]), "sketches")
    exact = profile.vocab_size(rows).union(
        profile.vocab_size(rows.withColumn("generated_by", F.lit(""))).select(
            F.lit(None).cast("string").alias("generated_by"), "vocab"
        )
    )
    estimated = sketches.merged_vocabulary(stored, ["generated_by"]).union(
        sketches.merged_vocabulary(stored).select(F.lit(None).cast("string"), "vocab")
    )
    named = estimated.toDF("_class", "_estimate")
    gap = F.abs(F.col("_estimate") - F.col("vocab")) / F.greatest("vocab", F.lit(1))
    return exact.join(named, F.col("generated_by").eqNullSafe(F.col("_class")), "left").select(
        "generated_by", "vocab", (gap <= 3 * sketches.DISTINCT_ERROR).alias("close")
    )


@query(
    "vocab_size_of_samples",
    f"""WITH {CORPUS} SELECT generated_by, count(DISTINCT word) AS vocab FROM (
          SELECT generated_by, unnest({ALPHA}) AS word FROM {sql_sample(60, "corpus")}) GROUP BY generated_by""",
)
def vocab_size_of_samples(spark, sf):
    """The published sample of 5,000 takes all rows of a small table; one of 60 does not."""
    return profile.vocab_size(sampling.sample_per_class(corpus(spark, sf), 60))


@query(
    "class_weights",
    f"""WITH {CORPUS}, c AS (SELECT generated_by, count(*) AS n FROM corpus GROUP BY generated_by)
        SELECT generated_by, n,
               (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c""",
    doubles=["weight"],
)
def class_weights(spark, sf):
    return profile.class_weights(corpus(spark, sf))


@query(
    "summary_report",
    f"""{WITH}, s AS ({CLASS_SUMMARY})
        SELECT s.* EXCLUDE (word_std), coalesce(vocab, 0) AS vocab,
               CAST((SELECT count(*) FROM lengths) AS bigint) AS total
        FROM s LEFT JOIN {VOCAB} v USING (generated_by)""",
    doubles=["word_mean", "char_mean", "sent_len_mean"],
)
def summary_report(spark, sf):
    return profile.summary_report(lengths(spark, sf), vocabulary(spark, sf))


@query("distinct_classes", f"WITH {CORPUS} SELECT DISTINCT generated_by FROM corpus ORDER BY 1")
def distinct_classes(spark, sf):
    return profile.distinct_classes(corpus(spark, sf))


def sql_density(data: str, points: int = 300) -> str:
    """Kernel density per class over ``data`` (generated_by, value): clipped at the 99th percentile."""
    return f"""data AS ({data}),
      g AS (SELECT generated_by, count(*) AS n, min(value) AS low,
                   quantile_cont(value, 0.99) AS high, 0.3 * stddev_samp(value) AS bw
            FROM data GROUP BY generated_by HAVING count(*) > 1),
      grid AS (SELECT *, low + point * (high - low) / {points - 1} AS x
               FROM (SELECT *, CAST(unnest(range({points})) AS integer) AS point FROM g) WHERE bw > 0)
      SELECT generated_by, point, any_value(x) AS x,
             sum(exp(-0.5 * ((x - value) / bw) ** 2)) / any_value(n * bw * sqrt(2 * pi())) AS density
      FROM data JOIN grid USING (generated_by) GROUP BY generated_by, point"""


def _register_density(name: str, measure: str, expression: str, source: str = "lengths"):
    def run(spark, sf):
        return density.class_density(lengths(spark, sf), measure)

    data = f"""SELECT generated_by, CAST({expression} AS double) AS value
               FROM {sql_sample(3000, f"(SELECT * FROM {source} WHERE {expression} > 0)")}"""
    register(name, run, f"{WITH}, {sql_density(data)}", doubles=["x", "density"])


_register_density("class_density_words", "word_count", "word_count")
_register_density("class_density_chars", "char_count", "char_count")
_register_density("class_density_sentences", "avg_words_per_sentence", "avg_words_per_sentence")


@query(
    "class_density_punctuation",
    f"""WITH {CORPUS}, heads AS (
          SELECT doc_id, generated_by,
                 {sql_count_chars(DENSITY_PUNCTUATION)} / length(text) AS density FROM corpus
          QUALIFY row_number() OVER (PARTITION BY generated_by ORDER BY doc_id) <= 5000),
        {sql_density("SELECT generated_by, density AS value FROM "
                     + sql_sample(3000, "(SELECT * FROM heads WHERE density > 0)"))}""",
    doubles=["x", "density"],
)
def class_density_punctuation(spark, sf):
    heads = sampling.head_per_class(corpus(spark, sf), TERM_SAMPLE)
    measured = heads.withColumn("punctuation", punctuation_density(F.col("text"))).drop("text")
    return density.class_density(measured, "punctuation")


@query(
    "class_density_binned",
    f"""{WITH}, exact AS ({"WITH " + sql_density(
        "SELECT generated_by, avg_words_per_sentence AS value FROM lengths WHERE avg_words_per_sentence > 0")})
        SELECT generated_by, point, x, density, true AS close FROM exact""",
    doubles=["x", "density"],
)
def class_density_binned(spark, sf):
    """The density of all rows, and whether that of binned values is within its error bound."""
    rows = materialise(lengths(spark, sf).select("doc_id", "generated_by", "avg_words_per_sentence"), "means")
    exact = density.class_density(rows, "avg_words_per_sentence", sample=None)
    binned = density.binned_density(rows, "avg_words_per_sentence").select(
        "generated_by", "point", F.col("x").alias("_x"), F.col("density").alias("_density"), "error"
    )
    gap = F.abs(F.col("density") - F.col("_density"))
    close = (F.abs(F.col("x") - F.col("_x")) < 1e-9) & (gap <= F.col("error") + 1e-9)
    return exact.join(binned, ["generated_by", "point"], "left").select(
        "generated_by", "point", "x", "density", F.coalesce(close, F.lit(False)).alias("close")
    )


@query(
    "length_density",
    f"""{WITH}, c AS (SELECT generated_by, char_count AS value, count(*) AS k
                      FROM lengths GROUP BY 1, 2),
        g AS (SELECT generated_by, count(*) AS n, min(char_count) - 0.5 * (max(char_count) - min(char_count)) AS low,
                     max(char_count) + 0.5 * (max(char_count) - min(char_count)) AS high,
                     count(*) ** (-0.2) * stddev_samp(char_count) AS bw FROM lengths GROUP BY generated_by),
        grid AS (SELECT *, low + point * (high - low) / 999 AS x
                 FROM (SELECT *, CAST(unnest(range(1000)) AS integer) AS point FROM g))
        SELECT generated_by, point, any_value(x) AS x,
               sum(k * exp(-0.5 * ((x - value) / bw) ** 2)) / any_value(n * bw * sqrt(2 * pi())) AS density
        FROM c JOIN grid USING (generated_by) GROUP BY generated_by, point""",
    doubles=["x", "density"],
)
def length_density(spark, sf):
    return density.length_density(lengths(spark, sf), "char_count")
