"""Label ids, TF-IDF, token ids and standardised features."""

from __future__ import annotations

from pyspark.sql import functions as F

from penmark.catalog.fixtures import CORPUS, corpus
from penmark.catalog.profile import sql_sample
from penmark.catalog.registry import query
from penmark.catalog.text import sql_list, stylometric_sql
from penmark.constants import ENGLISH_STOP_WORDS, STYLE_FEATURES, STYLE_STOPWORDS, TERM_SAMPLE
from penmark.functions.style import stylometric_features
from penmark.operators import labels, sampling, scaling, tfidf, tokenids
from penmark.plans import report
from penmark.session import materialise, new_path
from penmark.sources import runs

LABEL_MAP = """label_map AS (
  SELECT generated_by AS label, CAST(row_number() OVER (ORDER BY generated_by) - 1 AS integer) AS label_id
  FROM (SELECT DISTINCT generated_by FROM corpus WHERE split = 'train'))"""


def train_rows(spark, sf):
    return corpus(spark, sf).filter(F.col("split") == "train")


@query(
    "encode_labels",
    f"""WITH {CORPUS}, {LABEL_MAP} SELECT doc_id, generated_by, label_id
        FROM corpus JOIN label_map ON generated_by = label""",
)
def encode_labels(spark, sf):
    mapping = labels.label_map(train_rows(spark, sf))
    encoded = labels.encode_labels(corpus(spark, sf), mapping)
    return encoded.select("doc_id", "generated_by", "label_id")


@query(
    "decode_labels",
    f"""WITH {CORPUS}, {LABEL_MAP} SELECT doc_id, label_id, label
        FROM corpus JOIN label_map ON generated_by = label""",
)
def decode_labels(spark, sf):
    mapping = labels.label_map(train_rows(spark, sf))
    coded = labels.encode_labels(corpus(spark, sf), mapping)
    return labels.decode_labels(coded.select("doc_id", "label_id"), mapping)


def sql_tokens(stop_words=()) -> str:
    tokens = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
    if stop_words:
        tokens = f"list_filter({tokens}, lambda t: t NOT IN {sql_list(stop_words)})"
    return tokens


def sql_grams(low: int, high: int) -> str:
    parts = [
        f"list_transform(range(1, len(toks) - {n - 2}), lambda i: array_to_string(toks[i:i + {n - 1}], ' '))"
        for n in range(low, high + 1)
    ]
    joined = parts[0]
    for part in parts[1:]:
        joined = f"list_concat({joined}, {part})"
    return joined


def sql_tfidf(
    fit: str,
    apply: str,
    features: int,
    grams: tuple[int, int],
    min_df: int = 1,
    stop_words=(),
    sublinear: bool = False,
) -> str:
    """CTEs ``vocabulary`` and ``weights`` for a fit relation and a relation to transform."""

    def counted(source: str) -> str:
        return f"""(SELECT doc_id, generated_by, term, count(*) AS n FROM (
          SELECT doc_id, generated_by, unnest({sql_grams(*grams)}) AS term
          FROM (SELECT doc_id, generated_by, {sql_tokens(stop_words)} AS toks FROM {source}))
          GROUP BY doc_id, generated_by, term)"""

    weight = "(1 + ln(n))" if sublinear else "n"
    return f"""vocabulary AS (
      SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS integer) AS term_id, tf, df,
             ln((1 + (SELECT count(*) FROM {fit})) / (1 + df)) + 1 AS idf
      FROM (SELECT term, CAST(sum(n) AS bigint) AS tf, count(*) AS df FROM {counted(fit)}
            GROUP BY term HAVING count(*) >= {min_df} ORDER BY tf DESC, term LIMIT {features})),
    weights AS (
      SELECT doc_id, generated_by, term, term_id,
             w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf
      FROM (SELECT doc_id, generated_by, term, term_id, {weight} * idf AS w
            FROM {counted(apply)} JOIN vocabulary USING (term)))"""


TRAIN = "(SELECT * FROM corpus WHERE split = 'train')"
HELD_OUT = "(SELECT * FROM corpus WHERE split <> 'train')"


@query(
    "tfidf_vocabulary",
    f"""WITH {CORPUS}, {sql_tfidf(TRAIN, TRAIN, 50000, (1, 4))}
        SELECT term, term_id, tf, df, idf FROM vocabulary""",
    doubles=["idf"],
)
def tfidf_vocabulary(spark, sf):
    return tfidf.tfidf_fit(train_rows(spark, sf), tfidf.TRAIN_CONFIG).vocabulary


@query(
    "tfidf_vocabulary_trigrams",
    f"""WITH {CORPUS}, {sql_tfidf(TRAIN, TRAIN, 5000, (1, 3))}
        SELECT term, term_id, tf, df, idf FROM vocabulary""",
    doubles=["idf"],
)
def tfidf_vocabulary_trigrams(spark, sf):
    return tfidf.tfidf_fit(train_rows(spark, sf), tfidf.SMALL_TRIGRAM_CONFIG).vocabulary


@query(
    "tfidf_fit_transform",
    f"""WITH {CORPUS}, {sql_tfidf("corpus", "corpus", 5000, (1, 1))}
        SELECT doc_id, term, term_id, tfidf FROM weights""",
    doubles=["tfidf"],
)
def tfidf_fit_transform(spark, sf):
    return tfidf.tfidf_fit_transform(corpus(spark, sf), tfidf.UNIGRAM_CONFIG)


@query(
    "tfidf_transform",
    f"""WITH {CORPUS}, {sql_tfidf(TRAIN, HELD_OUT, 50000, (1, 3))}
        SELECT doc_id, term, term_id, tfidf FROM weights""",
    doubles=["tfidf"],
)
def tfidf_transform(spark, sf):
    model = tfidf.tfidf_fit(train_rows(spark, sf), tfidf.TRIGRAM_CONFIG)
    return model.transform(corpus(spark, sf).filter(F.col("split") != "train"))


def sql_top_terms(sample: int, stop_words=STYLE_STOPWORDS) -> str:
    return f"""WITH {CORPUS}, sampled AS (SELECT * FROM {sql_sample(sample, "corpus")}),
        {sql_tfidf("sampled", "sampled", 20000, (1, 2), 5, stop_words, sublinear=True)},
        means AS (SELECT generated_by, term, sum(tfidf) / any_value(docs) AS mean_tfidf
                  FROM weights JOIN (SELECT generated_by, count(*) AS docs FROM sampled GROUP BY 1)
                  USING (generated_by) GROUP BY generated_by, term)
        SELECT generated_by, term, mean_tfidf, CAST(rank AS integer) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY generated_by
                                       ORDER BY round(mean_tfidf, 12) DESC, term) AS rank FROM means)
        WHERE rank <= 15"""


def _top_terms(spark, sf, sample):
    rows = sampling.sample_per_class(corpus(spark, sf), sample)
    config = tfidf.TfidfConfig(
        20_000, (1, 2), min_df=5, stop_words=tuple(STYLE_STOPWORDS), sublinear_tf=True
    )
    return tfidf.top_terms(rows, config)


@query("top_terms", sql_top_terms(TERM_SAMPLE), doubles=["mean_tfidf"])
def top_terms(spark, sf):
    return _top_terms(spark, sf, TERM_SAMPLE)


@query("top_terms_english", sql_top_terms(TERM_SAMPLE, ENGLISH_STOP_WORDS), doubles=["mean_tfidf"])
def top_terms_english(spark, sf):
    """The published profile, with English stop words."""
    return tfidf.top_terms(sampling.sample_per_class(corpus(spark, sf), TERM_SAMPLE), tfidf.PROFILE_CONFIG)


@query("top_terms_document", sql_top_terms(60), doubles=["mean_tfidf"])
def top_terms_document(spark, sf):
    """Of samples of 60 texts per class, written as the published document and read back."""
    document = report.top_terms_document(_top_terms(spark, sf, 60))
    path = new_path(spark, "top-terms")
    runs.write_summary_json(document, path)
    saved = spark.read.schema(document.schema).json(path)
    return saved.select("generated_by", F.posexplode("terms").alias("place", "t")).select(
        "generated_by", "t.term", "t.mean_tfidf", (F.col("place") + 1).alias("rank")
    )


@query(
    "encode_token_ids",
    f"""WITH {CORPUS}, {sql_tfidf("corpus", "corpus", 5000, (1, 1))},
        kept AS (SELECT doc_id, ({sql_tokens()})[1:256] AS toks FROM corpus),
        looked AS (SELECT doc_id, pos, coalesce(term_id + 2, 1) AS id
                   FROM (SELECT doc_id, unnest(toks) AS term, unnest(range(0, len(toks))) AS pos FROM kept)
                   LEFT JOIN vocabulary USING (term)),
        lists AS (SELECT doc_id, list(id ORDER BY pos) AS found FROM looked GROUP BY doc_id)
        SELECT doc_id, CAST(i AS integer) AS position,
               CAST(CASE WHEN found IS NOT NULL AND i < len(found) THEN found[i + 1] ELSE 0 END AS integer) AS input_id,
               CAST(CASE WHEN found IS NOT NULL AND i < len(found) THEN 1 ELSE 0 END AS integer) AS mask
        FROM (SELECT kept.doc_id, found, unnest(range(0, 256)) AS i FROM kept LEFT JOIN lists USING (doc_id))""",
)
def encode_token_ids(spark, sf):
    docs = corpus(spark, sf)
    vocabulary = tfidf.tfidf_fit(docs, tfidf.UNIGRAM_CONFIG).vocabulary
    coded = tokenids.encode_token_ids(docs, vocabulary)
    return coded.select(
        "doc_id", F.posexplode(F.arrays_zip("input_ids", "attention_mask"))
    ).select(
        "doc_id",
        F.col("pos").alias("position"),
        F.col("col.input_ids").alias("input_id"),
        F.col("col.attention_mask").alias("mask"),
    )


_STYLE = stylometric_sql("corpus", "doc_id, split")
_SCALED = ", ".join(
    f"({c} - (SELECT avg({c}) FROM fitted)) / (SELECT CASE WHEN stddev_pop({c}) > 1e-12 "
    f"THEN stddev_pop({c}) ELSE 1 END FROM fitted) AS {c}"
    for c in STYLE_FEATURES
)


@query(
    "standardise",
    f"""WITH {CORPUS}, style AS MATERIALIZED (SELECT * FROM {_STYLE}),
        fitted AS (SELECT * FROM style WHERE split = 'train')
        SELECT doc_id, split, {_SCALED} FROM style""",
    doubles=STYLE_FEATURES,
)
def standardise(spark, sf):
    # Written once: fitting and scaling both read the features.
    style = materialise(
        stylometric_features(corpus(spark, sf).select("doc_id", "split", "text")).drop("text"), "style"
    )
    train = style.filter(F.col("split") == "train")
    return scaling.standardise(train, style, STYLE_FEATURES)
