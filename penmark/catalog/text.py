"""Text transformations, scalar features and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.catalog.fixtures import (
    CORPUS,
    NOISY,
    WORD_RE,
    corpus,
    labelled_docs,
    noisy,
    sql_words,
)
from penmark.catalog.registry import query
from penmark.constants import (
    BLANK_CLASS,
    DENSITY_PUNCTUATION,
    HEDGE_WORDS,
    STYLE_FEATURES,
    STYLE_STOPWORDS,
)
from penmark.functions import words as w
from penmark.functions.style import punctuation_density, stylometric_features
from penmark.functions.tokens import alpha_tokens
from penmark.operators import cleaning

def text() -> F.Column:
    return F.col("text")


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def sql_truncated(n: int, text: str = "text") -> str:
    return f"array_to_string({sql_words(text)}[1:{n}], ' ')"


def sql_padded(n: int) -> str:
    pads = f"list_transform(range({n}), lambda i: '<PAD>')"
    return f"array_to_string(list_concat({sql_words()}, {pads})[1:{n}], ' ')"


SENT_LENS = (
    "list_filter(list_transform(string_split_regex(text, '[.!?]+'), "
    f"lambda s: len({sql_words('s')})), lambda n: n > 0)"
)
AVG_SENT = f"coalesce(list_sum({SENT_LENS}) / nullif(len({SENT_LENS}), 0), 0.0)"
ALPHA = (
    r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), "
    "lambda t: regexp_full_match(t, '[a-z]+'))"
)


def sql_count_chars(chars: str, text: str = "text") -> str:
    quoted = chars.replace("'", "''")
    return f"(length({text}) - length(translate({text}, '{quoted}', '')))"


@query(
    "drop_null_rows",
    """SELECT d.doc_id, text, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE text IS NOT NULL AND quality IS NOT NULL""",
)
def drop_null_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    joined = corpus(spark, sf).join(labels, "doc_id", "left")
    return cleaning.drop_null_rows(joined, ["doc_id", "text", "quality"])


@query(
    "remove_duplicates",
    f"""WITH {CORPUS} SELECT doc_id, text, generated_by FROM corpus
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def remove_duplicates(spark, sf):
    return cleaning.remove_duplicates(corpus(spark, sf)).select("doc_id", "text", "generated_by")


@query(
    "remove_outliers_iqr",
    f"""WITH {CORPUS}, counted AS (SELECT *, len({sql_words()}) AS wc FROM corpus),
        q AS (SELECT split, quantile_cont(wc, 0.25) AS q1, quantile_cont(wc, 0.75) AS q3
              FROM counted GROUP BY split)
        SELECT doc_id, split, text FROM counted JOIN q USING (split)
        WHERE wc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def remove_outliers(spark, sf):
    kept = cleaning.remove_outliers_iqr(corpus(spark, sf), within=["split"])
    return kept.select("doc_id", "split", "text")


@query("filter_split", f"WITH {CORPUS} SELECT doc_id, text, generated_by FROM corpus WHERE split = 'val'")
def filter_split(spark, sf):
    return cleaning.filter_split(corpus(spark, sf), "val").drop("source")


@query(
    "filter_finite_positive",
    f"""WITH {CORPUS}, x AS (SELECT doc_id, {AVG_SENT} AS avg_words FROM corpus)
        SELECT doc_id, avg_words FROM x WHERE avg_words > 0 AND isfinite(avg_words)""",
    doubles=["avg_words"],
)
def filter_finite_positive(spark, sf):
    measured = corpus(spark, sf).select(
        "doc_id", w.avg_words_per_sentence(text()).alias("avg_words")
    )
    return cleaning.filter_finite_positive(measured, "avg_words")


@query("truncate_words", f"SELECT doc_id, {sql_truncated(300)} AS text FROM documents")
def truncate_words(spark, sf):
    return corpus(spark, sf).select("doc_id", w.truncate_words(text(), 300).alias("text"))


@query("pad_or_truncate_words", f"SELECT doc_id, {sql_padded(500)} AS text FROM documents")
def pad_or_truncate_words(spark, sf):
    return corpus(spark, sf).select("doc_id", w.pad_or_truncate_words(text()).alias("text"))


SPLIT_ROWS = f"""pieces AS (
  SELECT * EXCLUDE (text), words, unnest(range(0, greatest(1, CAST(ceil(len(words) / 500) AS bigint)))) AS chunk_no
  FROM (SELECT *, {sql_words()} AS words FROM corpus)),
chunks AS (
  SELECT * EXCLUDE (words, chunk_no), CAST(chunk_no AS integer) AS chunk_no,
         CASE WHEN len(words) > 0
              THEN array_to_string(words[chunk_no * 500 + 1 : (chunk_no + 1) * 500], ' ') END AS text
  FROM pieces)"""


@query("split_words", f"WITH {CORPUS}, {SPLIT_ROWS} SELECT doc_id, chunk_no, text FROM chunks")
def split_words(spark, sf):
    return cleaning.split_words(corpus(spark, sf)).select("doc_id", "chunk_no", "text")


@query(
    "clean_noise",
    f"""WITH {NOISY} SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(
          text, '<[^<>]*>', '', 'g'), 'http{WORD_RE}|www\\.{WORD_RE}', '', 'g'),
          '[{BLANK_CLASS}]+', ' ', 'g')) AS text FROM noisy""",
)
def clean_noise(spark, sf):
    return noisy(spark, sf).select("page_id", w.clean_noise(text()).alias("text"))


@query("lowercase_text", f"WITH {NOISY} SELECT page_id, lower(text) AS text FROM noisy")
def lowercase_text(spark, sf):
    return noisy(spark, sf).select("page_id", w.lowercase_text(text()).alias("text"))


@query(
    "remove_punctuation",
    rf"""WITH {NOISY} SELECT page_id,
         regexp_replace(text, '[^\p{{L}}\p{{N}}_{BLANK_CLASS}]', '', 'g') AS text FROM noisy""",
)
def remove_punctuation(spark, sf):
    return noisy(spark, sf).select("page_id", w.remove_punctuation(text()).alias("text"))


@query("prefix_text", "SELECT doc_id, 'passage: ' || text AS text FROM documents")
def prefix_text(spark, sf):
    return corpus(spark, sf).select("doc_id", w.prefix_text(text()).alias("text"))


@query("word_count", f"SELECT doc_id, CAST(len({sql_words()}) AS bigint) AS word_count FROM documents")
def word_count(spark, sf):
    return corpus(spark, sf).select("doc_id", w.word_count(text()).alias("word_count"))


@query("char_count", "SELECT doc_id, CAST(length(text) AS bigint) AS char_count FROM documents")
def char_count(spark, sf):
    return corpus(spark, sf).select("doc_id", w.char_count(text()).alias("char_count"))


@query(
    "avg_words_per_sentence",
    f"SELECT doc_id, {AVG_SENT} AS avg_words FROM documents",
    doubles=["avg_words"],
)
def avg_words_per_sentence(spark, sf):
    return corpus(spark, sf).select("doc_id", w.avg_words_per_sentence(text()).alias("avg_words"))


@query(
    "punctuation_density",
    f"""SELECT page_id, coalesce({sql_count_chars(DENSITY_PUNCTUATION)} / nullif(length(text), 0), 0.0)
        AS density FROM (SELECT page_id, concat_ws(' ', html, url) AS text FROM pages)""",
    doubles=["density"],
)
def density(spark, sf):
    return noisy(spark, sf).select("page_id", punctuation_density(text()).alias("density"))


@query(
    "alpha_tokens",
    f"""SELECT doc_id, token, CAST(count(*) AS bigint) AS n FROM (
          SELECT doc_id, unnest({ALPHA}) AS token FROM documents) GROUP BY doc_id, token""",
)
def alpha(spark, sf):
    return (
        corpus(spark, sf)
        .select("doc_id", F.explode_outer(alpha_tokens(text())).alias("token"))
        .filter(F.col("token").isNotNull())
        .groupBy("doc_id", "token")
        .agg(F.count("*").alias("n"))
    )


def stylometric_sql(view: str, keys: str) -> str:
    """The fifteen measures over a view with a ``text`` column, from lists of words."""
    e = "1e-8"
    sylls = "len(regexp_extract_all(t, '[aeiouy]+'))"
    wps = "(n / nullif(s, 0))"
    bullets = f"len(regexp_extract_all(text, '(?m)^[{BLANK_CLASS}]*[-•*][{BLANK_CLASS}]'))"
    upper = (
        r"len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), "
        "lambda t: regexp_full_match(t, '[A-Z]{2,}')))"
    )
    measures = {
        "avg_word_len": "coalesce(list_sum(list_transform(ws, lambda t: length(t))) / nullif(n, 0), 0.0)",
        "type_token_ratio": f"len(list_distinct(ws)) / (n + {e})",
        "avg_sent_len": "coalesce(list_sum(sl) / nullif(s, 0), 0.0)",
        "punct_rate": f"{sql_count_chars('.,!?;:')} / (length(text) + {e})",
        "flesch": f"coalesce(206.835 - 1.015 * {wps} - 84.6 * (syll / nullif(n, 0)), 0.0)",
        "stopword_ratio": f"len(list_filter(ws, lambda t: t IN {sql_list(STYLE_STOPWORDS)})) / (n + {e})",
        "sent_len_std": "coalesce(list_stddev_pop(sl), 0.0)",
        "bullet_rate": f"{bullets} / (s + {e})",
        "question_rate": f"{sql_count_chars('?')} / (s + {e})",
        "paren_rate": f"{sql_count_chars('(')} / (n + {e})",
        "upper_ratio": f"{upper} / (n + {e})",
        "bigram_diversity": "len(list_distinct(list_transform(range(1, greatest(n, 1)), "
        f"lambda i: ws[i] || ' ' || ws[i + 1]))) / (greatest(n - 1, 0) + {e})",
        "syllable_score": f"syll / (n + {e})",
        "fog": f"coalesce(0.4 * ({wps} + 100.0 * complex / nullif(n, 0)), 0.0)",
        "hedge_ratio": f"len(list_filter(ws, lambda t: t IN {sql_list(HEDGE_WORDS)})) / (n + {e})",
    }
    columns = ", ".join(f"CAST({measures[m]} AS double) AS {m}" for m in STYLE_FEATURES)
    return f"""(SELECT {keys}, {columns} FROM (
      SELECT *, coalesce(list_sum(list_transform(ws, lambda t: greatest(1, {sylls}))), 0) AS syll,
             len(list_filter(ws, lambda t: {sylls} >= 3)) AS complex
      FROM (SELECT *, len(ws) AS n, len(sl) AS s
            FROM (SELECT *, {ALPHA} AS ws, {SENT_LENS} AS sl FROM {view}))))"""


@query(
    "stylometric_features",
    f"SELECT * FROM {stylometric_sql('documents', 'doc_id')}",
    doubles=STYLE_FEATURES,
)
def stylometrics(spark, sf):
    return stylometric_features(corpus(spark, sf).select("doc_id", "text")).drop("text")


@query(
    "stylometric_features_of_turns",
    f"SELECT * FROM {stylometric_sql('conversations', 'conv_id, turn, role')}",
    doubles=STYLE_FEATURES,
)
def turn_stylometrics(spark, sf):
    return stylometric_features(spark.read.parquet(f"{sf}/conversations.parquet")).drop("text")


@query(
    "labelled_lengths",
    f"""SELECT quality, toxic, count(*) AS n, CAST(sum(len({sql_words()})) AS bigint) AS words
        FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic""",
)
def labelled_lengths(spark, sf):
    return (
        labelled_docs(spark, sf)
        .groupBy("quality", "toxic")
        .agg(F.count("*").alias("n"), F.sum(w.word_count(text())).alias("words"))
    )
