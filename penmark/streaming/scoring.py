"""Scoring arriving texts with a saved pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(texts: DataFrame, pipeline: PipelineModel, keep: list[str]) -> DataFrame:
    """Predicted label and its probability for each text of a stream or table; no state."""
    return pipeline.transform(texts).select(
        *keep,
        "predicted_label",
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, append it as Parquet, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
