"""Whole texts of an Arrow batch as flat numpy arrays: bytes, words and their places."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word is a run of bytes outside space, tab, newline, VT, FF and CR.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_BLANK = np.isin(np.arange(256), BLANKS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """Words of a batch. ``data`` holds them back to back, each followed by one space."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray  # document i has the words docs[i]:docs[i + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the bounds of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Words of each text, with A-Z lower-cased on request."""
    data, bounds = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = ~_IS_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = bounds[1:][bounds[1:] > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    docs = np.searchsorted(starts, bounds)
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    spaced = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, ord(" "), np.uint8)
    letters = np.ones(len(spaced), bool)
    letters[new_ends] = False
    spaced[letters] = data[inside]
    return Words(spaced, new_ends - lengths, new_ends, docs)


def string_array(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Adjacent slices of UTF-8 bytes as an Arrow array of strings, without copying."""
    bounds = np.ascontiguousarray(bounds, np.int64)
    return pa.Array.from_buffers(
        pa.large_string(),
        len(bounds) - 1,
        [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))],
    )


def gather_runs(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for every run (s, n), back to back."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


# Texts that a worker takes apart at a time, so that its memory does not follow the Arrow batch.
SLICE_BYTES = 4 << 20


def row_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES):
    """The batch in runs of rows whose texts have about ``limit`` bytes; a longer text is a run."""
    if not len(batch):
        return
    _, bounds = text_bytes(batch.column(column))
    start = 0
    while start < len(batch):
        end = int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1
        end = min(max(end, start + 1), len(batch))
        yield batch.slice(start, end - start)
        start = end
