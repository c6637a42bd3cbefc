"""Streaming jobs run to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from penmark.catalog.fixtures import WORD_RE, hash8, sql_hash8, table
from penmark.catalog.models import classifier_on_texts
from penmark.catalog.registry import query
from penmark.catalog.text import AVG_SENT, sql_truncated
from penmark.constants import BLANK_CLASS
from penmark.sources.models import load_pipeline, save_pipeline
from penmark.session import TEXT_ROWS, is_folder, new_path
from penmark.streaming.cleaning import clean_rows
from penmark.streaming.cleaning import clean_stream as clean
from penmark.streaming.deduplication import OUTCOMES, deduplicate_stream
from penmark.streaming.scoring import score_stream as score
from penmark.streaming.scoring import write_available


def _arriving(spark, sf):
    """The documents as a stream: the files of their folder, or the one file, for which a stream
    needs the folder that holds it."""
    path = f"{sf}/documents.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return source.parquet(path)
    return source.option("pathGlobFilter", "documents.parquet").parquet(sf)


def _run(spark, stream, label):
    out = new_path(spark, label)
    write_available(stream, out, new_path(spark, f"{label}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "clean_stream",
    f"""SELECT text, CAST(len(regexp_extract_all(text, '{WORD_RE}')) AS bigint) AS word_count,
          CAST(length(text) AS bigint) AS char_count, {AVG_SENT} AS avg_words_per_sentence
        FROM (SELECT DISTINCT {sql_truncated(500)} AS text FROM documents)""",
    doubles=["avg_words_per_sentence"],
)
def clean_stream(spark, sf):
    cleaned = clean(_arriving(spark, sf).select("doc_id", "text"), ["doc_id"]).drop("doc_id")
    return _run(spark, cleaned, "clean-stream")


@query("score_stream", "SELECT doc_id, true AS same FROM documents")
def score_stream(spark, sf):
    """Of every document: the saved model scores it alike as a stream and as a table."""
    trained, _ = classifier_on_texts(spark, sf)
    path = new_path(spark, "stream-model")
    save_pipeline(trained.pipeline, path)
    texts = _arriving(spark, sf).select("doc_id", "text")
    streamed = _run(spark, score(texts, load_pipeline(path), ["doc_id"]), "score-stream")
    direct = score(table(spark, sf, "documents").select("doc_id", "text"), trained.pipeline, ["doc_id"])
    return same_rows(streamed, direct)


def same_rows(streamed, direct):
    """One row for each of a document; those that share a ``doc_id``, null included, meet in the order of their scores."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("predicted_label", "confidence"))
    one = streamed.withColumn("_nth", nth)
    other = direct.withColumn("_nth", nth).select(
        F.col("doc_id").alias("_id"),
        F.col("_nth").alias("_at"),
        F.col("predicted_label").alias("_label"),
        F.col("confidence").alias("_c"),
    )
    same = (F.col("predicted_label") == F.col("_label")) & (F.abs(F.col("confidence") - F.col("_c")) < 1e-12)
    pair = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_nth") == F.col("_at"))
    return one.join(other, pair, "full").select(
        F.coalesce("doc_id", "_id").alias("doc_id"), F.coalesce(same, F.lit(False)).alias("same")
    )


# Documents as the events of eight days that arrive in four runs. Two tenths of them come one or two
# runs late, and texts are forgotten after one day.
ARRIVALS, DAYS, TTL = 4, 8, 86_400
NOISE = ("lowercase", "punctuation")


def sql_bounded() -> str:
    plain = rf"regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{BLANK_CLASS}]+', '', 'g')"
    parts = [
        f"""arrivals AS (
          SELECT doc_id, {sql_truncated(500, plain)} AS text, doc_id * {DAYS * TTL * 1_000_000} // n AS micros,
            least({ARRIVALS - 1}, doc_id * {ARRIVALS} // n + CASE h WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS batch
          FROM (SELECT *, {sql_hash8("doc_id")} % 10 AS h, (SELECT max(doc_id) + 1 FROM documents) AS n FROM documents)
        ), state_0 AS (SELECT text, micros FROM arrivals WHERE false)"""
    ]
    for b in range(ARRIVALS):
        limit = f"(SELECT coalesce(max(micros), -1) - {TTL * 1_000_000} FROM arrivals WHERE batch < {b})"
        parts += [
            f"live_{b} AS (SELECT * FROM state_{b} WHERE micros >= {limit})",
            f"""new_{b} AS (
              SELECT * FROM arrivals
              WHERE batch = {b} AND micros >= {limit} AND text NOT IN (SELECT text FROM live_{b})
              QUALIFY row_number() OVER (PARTITION BY text ORDER BY micros, doc_id) = 1)""",
            f"state_{b + 1} AS (SELECT * FROM live_{b} UNION ALL SELECT text, micros FROM new_{b})",
            f"""out_{b} AS (
              SELECT batch, doc_id, CASE WHEN micros < {limit} THEN 'late'
                  WHEN doc_id IN (SELECT doc_id FROM new_{b}) THEN 'first' ELSE 'repeated' END AS outcome,
                text IN (SELECT text FROM live_{b}) AS known, length(text) AS n_chars
              FROM arrivals WHERE batch = {b})""",
        ]
    union = " UNION ALL ".join(f"SELECT * FROM out_{b}" for b in range(ARRIVALS))
    return f"""WITH {", ".join(parts)}
        SELECT CAST(batch AS int) AS batch, doc_id, outcome, CASE outcome WHEN 'late' THEN known END AS known,
          CASE WHEN outcome <> 'repeated' THEN CAST(n_chars AS int) END AS n_chars FROM ({union})"""


@query("clean_stream_bounded", sql_bounded())
def clean_stream_bounded(spark, sf):
    """Every document once: as the first of its text, as a repetition, or as late."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    n = documents.agg(F.max("doc_id") + 1).scalar()
    late = F.when(hash8("doc_id") % 10 == 0, 1).when(hash8("doc_id") % 10 == 1, 2).otherwise(0)
    events = documents.withColumn("n", n).select(
        "doc_id",
        "text",
        F.timestamp_micros(F.expr(f"doc_id * {DAYS * TTL * 1_000_000}L div n")).alias("event_time"),
        F.least(F.lit(ARRIVALS - 1), F.expr(f"doc_id * {ARRIVALS} div n") + late).alias("run"),
    )
    source, out, state = (new_path(spark, x) for x in ("arriving", "bounded", "bounded-state"))
    for run in range(ARRIVALS):
        arrived = events.filter(F.col("run") == run).drop("run")
        arrived.write.option("parquet.block.size", TEXT_ROWS).mode("append").parquet(source)
        stream = spark.readStream.schema(events.drop("run").schema).parquet(source)
        job = deduplicate_stream(clean_rows(stream, NOISE), out, state, ["doc_id"], "event_time", TTL)
    first, repeated, late_rows = (job.read(spark, outcome) for outcome in OUTCOMES)
    text_length = F.length("text").alias("n_chars")
    nothing = F.lit(None)
    return (
        first.select("batch", "doc_id", F.lit("first").alias("outcome"), nothing.cast("boolean").alias("known"), text_length)
        .union(repeated.select("batch", "doc_id", F.lit("repeated"), nothing.cast("boolean"), nothing.cast("int")))
        .union(late_rows.select("batch", "doc_id", F.lit("late"), "known", text_length))
    )
