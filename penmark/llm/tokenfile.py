"""Token ids of a corpus as files of entropy-coded blocks, in ascending order of documents.

``write_token_file`` range-sorts the texts by ``doc_id`` (the only shuffle), tokenises them into a
table of the shared folder, counts the ids (as many counts as the vocabulary has reach the driver),
and codes runs of documents as independent blocks with one shared table. The folder holds

    blocks     Parquet; one row per block: its run of documents and its coded ids
    parts      Parquet; ids before each range of documents (one row per range)
    table      Parquet; id and scaled frequency

``read_token_file`` decodes the blocks in parallel and returns the documents with their places.

Defined results: a null or empty text is the end id alone; documents of one ``doc_id`` follow each
other in the order of their texts; a null ``doc_id`` comes first; repeated rows are kept; an empty
table gives a file without blocks; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penmark.llm import rans
from penmark.llm.arrowtext import row_slices
from penmark.llm.tokenise import stretches, with_end
from penmark.session import new_path

BLOCK_TOKENS = 1 << 20
END_ID = 2
SLICE_BYTES = 12 << 20  # texts encoded at a time

IDS = "part int, seq long, before long, doc_id long, n_tokens long, ids binary"
BLOCKS = (
    "part int, seq long, before long, n_docs long, n_tokens long, "
    "doc_ids binary, no_id binary, lengths binary, block binary"
)
DOCUMENTS = "part int, before long, doc_id long, n_tokens long, ids binary"


def _tokenised(docs: DataFrame, tokenizer_path: str, end_id: int, width: str) -> DataFrame:
    """One row per document in range order: range, place in it, ids before it in it, its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = stretches(tokenizer_path, drop_spaces=True), TaskContext.get().partitionId()
        seq = before = 0
        for batch in (part for whole in batches for part in row_slices(whole, 1, SLICE_BYTES)):
            ids, bounds = with_end(*encoder.encode(batch.column(1)), end_id)
            size = np.dtype(width).itemsize
            raw = pa.py_buffer(ids.astype(width))
            places = pa.py_buffer((bounds * size).astype(np.int64))
            binary = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, places, raw])
            n = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(batch), part, np.int32)),
                    pa.array(seq + np.arange(len(batch))),
                    pa.array(before + bounds[:-1]),
                    batch.column(0),
                    pa.array(n),
                    binary.cast(pa.binary()),
                ],
                names=[f.split()[0] for f in IDS.split(", ")],
            )
            seq, before = seq + len(batch), before + int(bounds[-1])

    ordered = (
        docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) tie")
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(run, IDS)


def _counts(ids: DataFrame, vocabulary: int, width: str) -> np.ndarray:
    """Number of occurrences of each id; at most one row per id of the vocabulary is fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), width), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    table = rows.toArrow()
    out = np.zeros(vocabulary, np.int64)
    out[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return out


def _blocks(ids: DataFrame, frequencies: np.ndarray, width: str, block_tokens: int) -> DataFrame:
    """Runs of consecutive documents, coded; a run ends at ``block_tokens`` or with its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequencies)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            part, seq, before = rows[0][:3]
            values = np.concatenate([np.frombuffer(r[5], width) for r in rows])
            record = [
                part,
                seq,
                before,
                len(rows),
                len(values),
                np.array([r[3] or 0 for r in rows], "<i8").tobytes(),
                np.packbits([r[3] is None for r in rows]).tobytes(),
                np.array([r[4] for r in rows], "<i8").tobytes(),
                rans.encode(values, table),
            ]
            return pa.RecordBatch.from_pylist(
                [dict(zip(names, record))], schema=pa.schema(list(zip(names, types)))
            )

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if rows and (
                    held >= block_tokens or row[0] != rows[0][0] or row[1] != rows[-1][1] + 1
                ):
                    yield flush()
                    rows, held = [], 0
                rows.append(row)
                held += row[4]
        if rows:
            yield flush()

    names = [f.split()[0] for f in BLOCKS.split(", ")]
    types = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in BLOCKS.split(", ")]
    return ids.mapInArrow(run, BLOCKS)


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Write the ids of all texts to the folder ``path`` in ascending order of ``doc_id``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    scratch = new_path(spark, "token-ids")
    _tokenised(docs, tokenizer_path, end_id, width).write.option("compression", "zstd").parquet(scratch)
    ids = spark.read.schema(IDS).parquet(scratch)
    frequencies = rans.Table.scaled(_counts(ids, vocabulary, width))
    seen = np.flatnonzero(frequencies)
    spark.createDataFrame(
        pa.table({"id": seen, "frequency": frequencies[seen]}), "id long, frequency long"
    ).coalesce(1).write.parquet(f"{path}/table")
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    # One row per range of documents, as many as the shuffle had partitions.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.parquet(
        f"{path}/parts"
    )
    _blocks(ids, frequencies, width, block_tokens).write.option("compression", "none").parquet(
        f"{path}/blocks"
    )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids (little-endian unsigned 32-bit) of each document."""
    table = spark.read.parquet(f"{path}/table").toArrow()  # bounded by the vocabulary
    frequencies = np.zeros(int(max(table.column("id").to_pylist(), default=0)) + 1, np.int64)
    frequencies[table.column("id").to_numpy()] = table.column("frequency").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(frequencies)
        for batch in batches:
            for row in batch.to_pylist():
                ids = rans.decode(row["block"], table)
                lengths = np.frombuffer(row["lengths"], "<i8")
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                missing = np.unpackbits(
                    np.frombuffer(row["no_id"], np.uint8), count=len(lengths)
                ).astype(bool)
                whole = pa.Array.from_buffers(
                    pa.large_binary(),
                    len(lengths),
                    [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lengths), row["part"], np.int32)),
                        pa.array(row["before"] + bounds[:-1]),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=missing),
                        pa.array(lengths),
                        whole.cast(pa.binary()),
                    ],
                    names=[f.split()[0] for f in DOCUMENTS.split(", ")],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    starts = spark.read.schema("part int, start long").parquet(f"{path}/parts")
    # One row per range of documents, as many as the writing shuffle had partitions.
    return (
        blocks.mapInArrow(run, DOCUMENTS)
        .join(F.broadcast(starts), "part")
        .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
    )
