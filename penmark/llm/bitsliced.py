"""Near-duplicates by 64-bit SimHash fingerprints, compared in bit slices.

``fingerprints`` hashes the word shingles of whole texts and takes the majority of each bit. Equal
fingerprints collapse first. Two of them at most ``radius`` bits apart agree in at least two of
``radius + 2`` blocks of bits, so they meet under the key of such a pair of blocks. A task gets the
fingerprints of its keys in order, stores their bit planes vertically, and adds the differing
planes of 64 pairs at a time into carry-save counters; a word of pairs is abandoned once all of
them are beyond the radius. A key sends on one link per fingerprint, never its pairs, and keys with
more than ``TILE`` fingerprints are dealt in tiles to one task for each pair of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.arrowtext import Words, row_slices, split_words
from penmark.llm.components import connected_components
from penmark.session import materialise

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
TILE = 1 << 15
# Runs of a key up to this length are compared row against row, longer ones by search.
SHORT_RUN = 48

# Texts whose shingles a worker hashes at a time; their places take some hundred times as much.
SLICE_BYTES = 1 << 20

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: Words, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, back to back, and their number in each text."""
    counts = np.diff(words.docs)
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    first = np.repeat(words.docs[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(
        int(shingles.sum())
    )
    last = first + np.repeat(np.minimum(counts, size), shingles) - 1
    raw, digest = words.data.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(raw[a:b], seed)
            for a, b in zip(words.starts[first].tolist(), words.ends[last].tolist())
        ),
        np.uint64,
        len(first),
    )
    return hashes, shingles


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority of each bit over the hashes of each text; zero for a text without any."""
    filled = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.uint64)
    if len(filled):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = (np.cumsum(sizes) - sizes)[filled]
        votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        won = votes * 2 > sizes[filled][:, None]
        out[filled] = np.packbits(won, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def text_fingerprints(column: pa.Array, size: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Majority bits of the hashes of all shingles of each text; zero without words."""
    return majority_bits(*shingle_hashes(split_words(column, lower=True), size, seed))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint, as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 1, SLICE_BYTES):
                found = text_fingerprints(part.column(1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found)], names=["doc_id", "fp"]
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        run, "doc_id long, fp long"
    )


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, mask) of radius + 2 blocks that share the 64 bits."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]


def _keys(distinct: DataFrame, radius: int, tile: int) -> DataFrame:
    """Each fingerprint under the keys of all pairs of blocks, hot keys split into pairs of tiles."""
    parts = [F.shiftrightunsigned("fp", shift).bitwiseAND(mask) for shift, mask in _blocks(radius)]
    keys = [
        F.struct(F.lit(i).alias("pair"), parts[a].alias("x"), parts[b].alias("y"))
        for i, (a, b) in enumerate(combinations(range(radius + 2), 2))
    ]
    rows = distinct.select("fp", F.inline(F.array(*keys)))
    hot = rows.groupBy("pair", "x", "y").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
    tiles = F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    return (
        rows.join(hot, ["pair", "x", "y"], "left")
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .select("pair", "x", "y", "fp", "own", F.explode(others).alias("other"))
        .select("pair", "x", "y", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )


def within(difference: Iterator[np.ndarray], alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``alive`` whose differing planes sum to ``radius`` at most.

    ``difference`` yields one plane after the other and takes, through ``send``, the places of the
    words that are still alive.
    """
    width = max(1, radius.bit_length())
    shape = alive.shape
    flat = alive.ravel()
    at = np.flatnonzero(flat)
    ok = flat[at]
    counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
    plane = difference.send(None)
    for step in range(64):
        carry = plane & ok
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        ok &= ~carry  # past what the counters hold
        if step % 8 == 7 and step < 63:
            beyond = _exceeds(counters, radius)
            ok &= ~beyond
            keep = np.flatnonzero(ok)
            if len(keep) < len(ok) // 2 or not len(keep):  # abandon words without a lane left
                at, ok, counters = at[keep], ok[keep], [c[keep] for c in counters]
                if not len(at):
                    return np.zeros(shape, np.uint64)
        if step < 63:
            plane = difference.send(at)
    ok &= ~_exceeds(counters, radius)
    out = np.zeros(flat.shape, np.uint64)
    out[at] = ok
    return out.reshape(shape)


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above ``radius``."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans as words of 64 lanes along the last axis."""
    spare = -bits.shape[-1] % 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], spare), bool)], axis=-1)
    packed = np.packbits(bits, axis=-1, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    """Numbers of the lanes that are set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of the values, 64 values to a word."""
    return _pack(
        np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool)
    )


def short_runs(values: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) inside runs of equal ``runs``; both arrays are in the order of rows."""
    left, right = [], []
    longest = int(np.bincount(runs).max()) if len(runs) else 0
    for by in range(1, longest):
        rows = np.flatnonzero(runs[by:] == runs[:-by])
        if not len(rows):
            continue
        # Only rows that have a partner at this distance take part.
        difference = _planes(values[rows] ^ values[rows + by])
        alive = _pack(np.ones(len(rows), bool))
        close = _lanes(within(_given(difference, np.flatnonzero(alive)), alive, radius))
        left.append(rows[close])
        right.append(rows[close] + by)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _given(difference: np.ndarray, at: np.ndarray):
    for p in range(64):
        at = yield difference[p, at]
        if at is None:
            return


def _against(planes: np.ndarray, queries: np.ndarray, at: np.ndarray):
    """Differences of the queries (rows) from the stored lanes (columns of words)."""
    width = planes.shape[1]
    ones = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _ALL, np.uint64(0))
    for p in range(64):
        at = yield planes[p, at % width] ^ ones[at // width, p]
        if at is None:
            return


def long_run(
    values: np.ndarray, radius: int, block: int = 64, partner: np.ndarray | None = None
) -> np.ndarray:
    """For each value the least index that it is linked with, directly or through others.

    A search from one value to the next: what has been reached is compared only with what has not,
    so a dense group takes few comparisons and only stray values make it longer. ``partner``, if
    given, gets the value within the radius from which each one was reached.
    """
    root = np.arange(len(values))
    order = np.arange(len(values))  # values not reached yet
    while len(order):
        start, order = order[0], order[1:]
        frontier = np.array([start])
        planes = _planes(values[order]) if len(order) else None
        alive = np.ones(len(order), bool)
        while len(frontier) and alive.any():
            some, frontier = frontier[:block], frontier[block:]
            if alive.sum() < len(alive) // 2:
                order, alive = order[alive], np.ones(int(alive.sum()), bool)
                planes = _planes(values[order])
            lanes = np.repeat(_pack(alive)[None, :], len(some), axis=0)
            near = within(_against(planes, values[some], np.flatnonzero(lanes)), lanes, radius)
            got = _lanes(np.bitwise_or.reduce(near, axis=0))
            got = got[got < len(order)]
            if partner is not None:
                bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, got]
                partner[order[got]] = some[bits.argmax(axis=0)]
            root[order[got]] = start
            alive[got] = False
            frontier = np.concatenate([frontier, order[got]])
        order = order[alive]
    return root


def _links(keys: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join what each key holds within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_keys, rest = np.zeros((0, 5), np.int64), np.zeros(0, np.uint64)
        batches = iter(batches)
        while True:
            batch = next(batches, None)
            if batch is not None:
                new = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1).astype(np.int64)
                rest_keys = np.concatenate([rest_keys, new])
                rest = np.concatenate([rest, batch.column(5).to_numpy().view(np.uint64)])
            if not len(rest):
                if batch is None:
                    return
                continue
            change = np.flatnonzero((rest_keys[1:] != rest_keys[:-1]).any(axis=1)) + 1
            done = len(rest) if batch is None else int(change[-1]) if len(change) else 0
            yield from compare(rest[:done], np.concatenate([[0], change[change < done], [done]]))
            rest_keys, rest = rest_keys[done:], rest[done:]
            if batch is None:
                return

    def compare(values: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        a, b = [], []
        short = (sizes > 1) & (sizes <= SHORT_RUN)
        rows = np.repeat(short, sizes)
        if rows.any():
            chosen = values[rows]
            i, j = short_runs(chosen, np.repeat(np.arange(len(sizes)), sizes)[rows], radius)
            a.append(chosen[i])
            b.append(chosen[j])
        for k in np.flatnonzero(sizes > SHORT_RUN).tolist():
            run_values = values[bounds[k] : bounds[k + 1]]
            root = long_run(run_values, radius)
            linked = np.flatnonzero(root != np.arange(len(root)))
            a.append(run_values[root[linked]])
            b.append(run_values[linked])
        if a:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"]
            )

    columns = ["pair", "x", "y", "i", "j"]
    return (
        keys.repartition(*columns)
        .sortWithinPartitions(*columns)
        .select(*columns, "fp")
        .mapInArrow(run, "a long, b long")
    )


def fingerprint_components(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fp, component (its least linked fp) and component_id (least doc_id) of each distinct fp."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    # Equal pairs of blocks may be spread over several tiles; repeated links are merged.
    linked = connected_components(_links(_keys(distinct.select("fp"), radius, tile), radius))
    members = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    return materialise(
        members.join(least, "component").select("fp", "component", "component_id"), "components"
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links.

    A null text has no words; texts without words have fingerprint zero and are linked like any
    other. Rows with a null doc_id are kept and do not name a component unless all its ids are null.
    Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    prints = materialise(fingerprints(docs), "prints")
    classes = fingerprint_components(prints, radius).select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
