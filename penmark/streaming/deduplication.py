"""Exact deduplication of arriving texts with a state that is bounded by a time to live.

Every micro-batch is merged into tables of the output folder. A row is *first* if no text like it
is among the live keys, *repeated* if one is, and *late* if its event time lies before the
watermark, where keys may have been forgotten already. So each row is in exactly one of three
tables, and late rows are a second output instead of being lost. The state holds 32 bytes and a
time for each text that was new within the time to live before the latest event.

All a batch writes lies in folders with its number, and it reads those of the batch before. A batch
that is tried again after a failure overwrites its own folders with the same rows; the output has
each row once even if the driver is lost in the middle of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from penmark.operators.cleaning import text_key
from penmark.session import TEXT_ROWS, remove_path

OUTCOMES = ("first", "repeated", "late")


@dataclass(frozen=True)
class BoundedDeduplication:
    """Merges micro-batches into the tables below ``out``.

    ``ids`` identify a row and are not null. The time to live is in seconds of event time: a text
    is known until the watermark, the latest event time of earlier batches less the time to live,
    has passed the event time of its first row. Rows without an event time are never late and count
    as the latest of their batch. Null texts equal each other.
    """

    out: str
    ids: tuple[str, ...]
    time_col: str
    ttl_seconds: int
    text_col: str = "text"

    def path(self, name: str, batch: int | None = None) -> str:
        return f"{self.out}/{name}" + ("" if batch is None else f"/batch={batch}")

    def _state(self, spark: SparkSession, batch: int) -> DataFrame:
        """(key, micros) after a batch; empty before the first one."""
        schema = T.StructType().add("key", "binary").add("micros", "long")
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path("state", batch))

    def _mark(self, spark: SparkSession, batch: int) -> int | None:
        """Latest event time, in microseconds, up to a batch."""
        if batch < 0:
            return None
        return spark.read.schema("micros long").parquet(self.path("marks", batch)).first()["micros"]

    def merge(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch. Its rows are computed once and written with their keys; texts are read from
        there for the outputs. The rest of the work is on keys, where copies of a text collapse
        before the shuffle."""
        spark, ids = rows.sparkSession, list(self.ids)
        mark = self._mark(spark, batch - 1)
        watermark = None if mark is None else mark - self.ttl_seconds * 1_000_000
        key = F.coalesce(text_key(self.text_col), F.unhex(F.lit("")))
        keyed = rows.withColumns({"_key": key, "_micros": F.unix_micros(self.time_col)})
        keyed = self._write(keyed, "rows", batch, TEXT_ROWS)
        keys = keyed.select(*ids, F.col("_key").alias("key"), F.col("_micros").alias("micros"))
        latest = keys.agg(F.max("micros")).first()[0]
        latest = max((x for x in (mark, latest) if x is not None), default=None)
        keys = keys.withColumn("micros", F.coalesce("micros", F.lit(latest), F.lit(0)))
        late = F.lit(False) if watermark is None else F.col("micros") < watermark
        # Rows without a time have none of the watermark's past.
        late_row = F.lit(False) if watermark is None else F.coalesce(F.col("_micros") < watermark, F.lit(False))
        live = self._state(spark, batch - 1)
        if watermark is not None:
            live = live.filter(F.col("micros") >= watermark)

        in_time = keys.filter(~late)
        candidates = in_time.groupBy("key").agg(F.min(F.struct("micros", *ids)).alias("row"))
        new = self._write(candidates.join(live, "key", "left_anti").select("key", "row.*"), "new", batch)
        first_ids = new.select(*ids)
        known = live.select("key", F.lit(True).alias("known"))
        late_ids = (
            keys.filter(late).join(known, "key", "left").select(*ids, F.coalesce("known", F.lit(False)).alias("known"))
        )
        in_time_rows, late_rows = (keyed.filter(x).select(*rows.columns) for x in (~late_row, late_row))
        self._write(in_time_rows.join(first_ids, ids, "left_semi"), "first", batch)
        self._write(in_time.join(first_ids, ids, "left_anti").select(*ids, "key"), "repeated", batch)
        self._write(late_rows.join(late_ids, ids), "late", batch)
        self._write(live.union(new.select("key", "micros")), "state", batch)
        self._write(spark.range(1).select(F.lit(latest).cast("long").alias("micros")), "marks", batch)
        # The batch before is still needed if this one is tried again.
        for name, age in (("rows", 0), ("new", 0), ("state", 2), ("marks", 2)):
            if batch >= age:
                remove_path(spark, self.path(name, batch - age))

    def _write(self, df: DataFrame, name: str, batch: int, row_group: int | None = None) -> DataFrame:
        path = self.path(name, batch)
        writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
        writer.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def start(self, texts: DataFrame, checkpoint: str) -> StreamingQuery:
        """Process everything that has arrived, then stop."""
        return (
            texts.writeStream.foreachBatch(self.merge)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def read(self, spark: SparkSession, outcome: str) -> DataFrame:
        """Rows of one outcome, with the number of their batch."""
        return spark.read.parquet(self.path(outcome))

    def state_size(self, spark: SparkSession) -> int:
        """Keys after the last batch."""
        states = spark.read.schema("micros long, batch int").parquet(self.path("state"))
        return states.filter(F.col("batch") == states.agg(F.max("batch")).scalar()).count()


def deduplicate_stream(
    texts: DataFrame,
    out: str,
    checkpoint: str,
    ids: Sequence[str],
    time_col: str,
    ttl_seconds: int,
    text_col: str = "text",
) -> BoundedDeduplication:
    """Run the deduplication over all that has arrived and wait for its end."""
    job = BoundedDeduplication(out, tuple(ids), time_col, ttl_seconds, text_col)
    job.start(texts, checkpoint).awaitTermination()
    return job
