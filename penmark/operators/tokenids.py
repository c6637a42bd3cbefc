"""Fixed-length token ids and attention masks over a word-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.functions.tokens import vectoriser_tokens

PAD_ID = 0
UNKNOWN_ID = 1
FIRST_TERM_ID = 2
# Rows that a task encodes at a time.
ROWS = 4096


def encode_token_ids(
    df: DataFrame,
    vocabulary: DataFrame,
    max_len: int = 256,
    ids: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """(ids, input_ids, attention_mask): truncated and right-padded to ``max_len``.

    ``vocabulary`` is the local (term, term_id) table of a fitted model with unigrams, bounded by its
    ``max_features``; every task gets it. Tokens are cut in the JVM and looked up in Arrow batches, so
    nothing is shuffled. A null text has no tokens.
    """
    known = vocabulary.select("term", "term_id").toArrow()
    terms = known.column("term").combine_chunks()
    numbers = known.column("term_id").to_numpy().astype(np.int32) + FIRST_TERM_ID
    numbers = np.append(numbers, np.int32(UNKNOWN_ID))  # the place -1 of an unknown token
    ids = list(ids)
    tokens = F.slice(vectoriser_tokens(F.coalesce(F.col(text_col), F.lit(""))), 1, max_len)
    kept = df.select(*ids, tokens.alias("_tokens"))
    row = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType(
        [*df.select(*ids).schema.fields, T.StructField("input_ids", row), T.StructField("attention_mask", row)]
    )

    def fixed(values: np.ndarray) -> pa.Array:
        offsets = np.arange(len(values) + 1, dtype=np.int32) * max_len
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column(len(ids))
                found = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
                lengths = lists.value_lengths().to_numpy()
                mask = np.arange(max_len) < lengths[:, None]
                encoded = np.full(mask.shape, PAD_ID, np.int32)
                encoded[mask] = numbers[found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(ids)], fixed(encoded), fixed(mask.astype(np.int32))], names=schema.names
                )

    return kept.mapInArrow(run, schema)
