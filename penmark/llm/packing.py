"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best fit: a task keeps a fixed number of open bins. A bitset has one bit for
each amount of free space that some open bin has, so the tightest bin for a piece is the lowest set
bit at or above its length. A piece that fits nowhere opens a bin; if all places are taken, the
fullest open bin is closed for it. The pieces of some megabytes of text arrive longest first, which lets
later, shorter pieces fill the gaps. Texts are neither shuffled nor gathered, and a task's memory
is bounded by the open bins and those texts.

Defined results: a null or empty text is the end id alone; a null ``doc_id`` is kept; repeated rows
are packed each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from penmark.llm.arrowtext import row_slices
from penmark.llm.tokenise import stretches, with_end

SEQUENCE_LENGTH = 1024
OPEN_BINS = 4096
END_ID = 2
SLICE_BYTES = 12 << 20  # texts encoded and sorted by length at a time

SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


class OpenBins:
    """At most ``limit`` bins of ``capacity`` that still take pieces."""

    def __init__(self, capacity: int, limit: int, first_name: int = 0):
        self.capacity, self.limit, self.next_name = capacity, limit, first_name
        self.free_bits, self.open = 0, 0
        self.with_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        names = self.with_free[free]
        name = names.pop()
        if not names:
            self.free_bits ^= 1 << free
        self.open -= 1
        return name

    def place(self, length: int) -> tuple[int, int]:
        """Name of the bin that takes a piece, and the place of the piece in it."""
        fitting = self.free_bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            free, name = self.capacity, self.next_name
            self.next_name += 1
        left = free - length
        if left:
            if self.open == self.limit:  # the fullest closes first
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            self.with_free[left].append(name)
            self.free_bits |= 1 << left
            self.open += 1
        return name, self.capacity - free


def cut(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and size of each piece; only the first of a document may be short."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = sizes - (pieces - 1) * length
    start = np.where(number == 0, 0, first[doc] + (number - 1) * length)
    return doc, number, start, np.where(number == 0, first[doc], length)


def best_fit_pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = SEQUENCE_LENGTH,
    open_bins: int = OPEN_BINS,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds its ids, little-endian 32-bit."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = stretches(tokenizer_path, drop_spaces=False)
        bins = OpenBins(length, open_bins, TaskContext.get().partitionId() << 40)
        for batch in (part for whole in batches for part in row_slices(whole, 1, SLICE_BYTES)):
            ids, bounds = with_end(*encoder.encode(batch.column(1)), end_id)
            doc, number, start, size = cut(bounds, length)
            at = bounds[doc] + start
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            slices = [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), (at + size).tolist())]
            names, places = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            for i in np.argsort(-size, kind="stable").tolist():
                names[i], places[i] = bins.place(int(size[i]))
            columns = [
                batch.column(0).take(pa.array(doc)),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(np.fromiter(map(zlib.crc32, slices), np.int64, len(slices))),
                pa.array(names),
                pa.array(places),
            ]
            if with_ids:
                columns.append(pa.array([bytes(s) for s in slices], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = SCHEMA + (", ids binary" if with_ids else "")
    fields = [part.split()[0] for part in schema.split(", ")]
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(pack, schema)
