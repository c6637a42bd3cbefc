"""Dense label ids in sorted order, fitted on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.ranges import with_positions


def label_map(train: DataFrame, class_col: str = "generated_by") -> DataFrame:
    """(label, label_id) for the distinct labels, ids from 0 in sorted order."""
    labels = train.filter(F.col(class_col).isNotNull()).select(F.col(class_col).alias("label"))
    numbered = with_positions(labels.distinct(), [F.col("label").asc()], "label_id")
    return numbered.withColumn("label_id", F.col("label_id").cast("int"))


def encode_labels(
    df: DataFrame, mapping: DataFrame, class_col: str = "generated_by"
) -> DataFrame:
    """Append ``label_id``; a label that training did not have raises an error."""
    joined = df.join(mapping.withColumnRenamed("label", class_col), class_col, "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.col(class_col))).cast("int")
    checked = F.when(
        F.col("label_id").isNull() & F.col(class_col).isNotNull(), unseen
    ).otherwise(F.col("label_id"))
    return joined.select(*df.columns, checked.alias("label_id"))


def decode_labels(
    df: DataFrame, mapping: DataFrame, id_col: str = "label_id", out: str = "label"
) -> DataFrame:
    """Append the label of an id; an unknown id gives null."""
    names = mapping.select(F.col("label_id").alias(id_col), F.col("label").alias(out))
    return df.join(names, id_col, "left").select(*df.columns, out)


def attach_labels(features: DataFrame, labels: DataFrame, ids: tuple[str, ...] = ("doc_id",)):
    """Join features and labels on the identity instead of by position."""
    return features.join(labels, list(ids))
