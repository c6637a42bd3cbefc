"""Static range asymmetric numeral system over blocks of token ids.

One table of frequencies, scaled to a power of two, serves all blocks. A block deals its ids to
``lanes`` coders in turn; all lanes advance together in numpy, and each has a 64-bit state that
sheds or takes one 32-bit word at a time. After every ``CHECKPOINT`` rounds the block notes all
lane states and its place in the words, so that any segment can be decoded without the ones
before it; each segment has a CRC-32 of its ids.

Bytes of a block, little-endian: magic, lanes, bits, rounds between checkpoints, ids, words,
segments; then for each segment its first word and its checksum; the lane states of each segment;
the words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RNS1"
LANES = 1024
BITS = 20
CHECKPOINT = 256  # rounds of all lanes
_HEAD = struct.Struct("<4sIIIQQI")
_LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
_WORD = np.uint64(32)


class Table:
    """Scaled frequencies of the ids that occur; one table serves all blocks of a file."""

    def __init__(self, frequencies: np.ndarray, bits: int = BITS):
        if frequencies.sum() != 1 << bits:
            raise ValueError("frequencies do not fill the table")
        self.bits = bits
        self.frequencies = frequencies.astype(np.uint64)
        self.before = np.cumsum(self.frequencies) - self.frequencies
        self.symbols = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)

    @staticmethod
    def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
        """Frequencies that sum to 2**bits, at least 1 for each id that occurs."""
        total, size = int(counts.sum()), 1 << bits
        seen = np.flatnonzero(counts)
        if len(seen) > size:
            raise ValueError(f"{len(seen)} different ids do not fit into {bits} bits")
        out = np.zeros(len(counts), np.int64)
        if not total:
            out[0] = size
            return out
        exact = counts[seen] / total * size
        out[seen] = np.maximum(1, np.floor(exact))
        spare = size - int(out.sum())
        if spare > 0:
            out[seen[np.argmax(counts[seen])]] += spare
        order = seen[np.argsort(-counts[seen], kind="stable")]
        while spare < 0:  # rare ids were raised to 1: frequent ones pay in proportion
            can = out[order] - 1
            pay = np.minimum(can, np.ceil(can / can.sum() * -spare).astype(np.int64))
            pay = np.minimum(pay, np.maximum(0, -spare - (np.cumsum(pay) - pay)))
            out[order] -= pay
            spare = size - int(out.sum())
        return out


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    """The bytes of one block."""
    bits = np.uint64(table.bits)
    states = np.full(lanes, _LOW, np.uint64)
    rounds = -(-len(ids) // lanes)
    segments = -(-rounds // every)
    chunks: list[np.ndarray] = [np.zeros(0, np.uint32)] * rounds
    marks = np.zeros((segments, lanes), np.uint64)
    room = np.uint64(63 - table.bits)
    for r in range(rounds - 1, -1, -1):
        part = ids[r * lanes : (r + 1) * lanes]
        x, f = states[: len(part)], table.frequencies[part]
        full = x >= (f << room)
        chunks[r] = x[full].astype(np.uint32)
        x = np.where(full, x >> _WORD, x)
        q = x // f
        states[: len(part)] = (q << bits) + (x - q * f) + table.before[part]
        if r % every == 0:
            marks[r // every] = states
    sizes = np.fromiter(map(len, chunks), np.int64, rounds)
    firsts = (np.cumsum(sizes) - sizes)[::every].astype("<u8")
    sums = [
        zlib.crc32(ids[s * every * lanes : (s + 1) * every * lanes].astype("<u4").tobytes())
        for s in range(segments)
    ]
    words = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
    head = _HEAD.pack(MAGIC, lanes, table.bits, every, len(ids), len(words), segments)
    return b"".join(
        [
            head,
            firsts.tobytes(),
            np.array(sums, "<u4").tobytes(),
            marks.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
        ]
    )


def decode(block: bytes, table: Table, segments: range | None = None) -> np.ndarray:
    """Ids of the block, or of the given run of segments only; a wrong checksum raises."""
    magic, lanes, bits, every, count, words, parts = _HEAD.unpack_from(block)
    if magic != MAGIC or bits != table.bits:
        raise ValueError("not a block of this table")
    at = _HEAD.size
    firsts = np.frombuffer(block, "<u8", parts, at)
    sums = np.frombuffer(block, "<u4", parts, at + 8 * parts)
    marks = np.frombuffer(block, "<u8", parts * lanes, at + 12 * parts).reshape(parts, lanes)
    stream = np.frombuffer(block, "<u4", words, at + 12 * parts + 8 * parts * lanes)
    wanted = range(parts) if segments is None else segments
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    span = every * lanes
    low, high = min(wanted.start * span, count), min(wanted.stop * span, count)
    out = np.zeros(high - low, np.uint32)
    for s in wanted:
        states, place = marks[s].astype(np.uint64), int(firsts[s])
        end = min((s + 1) * span, count)
        for a in range(s * span, end, lanes):
            x = states[: min(lanes, end - a)]
            slot = x & mask
            got = table.symbols[slot]
            out[a - low : a - low + len(x)] = got
            x = table.frequencies[got] * (x >> shift) + slot - table.before[got]
            short = np.flatnonzero(x < _LOW)
            x[short] = (x[short] << _WORD) | stream[place : place + len(short)]
            place += len(short)
            states[: len(x)] = x
        if zlib.crc32(out[s * span - low : end - low].astype("<u4").tobytes()) != int(sums[s]):
            raise ValueError(f"checksum of segment {s} differs")
    return out
