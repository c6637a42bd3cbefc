"""One document of each group of near-duplicates: every pair of likeness 0.8 or more is linked.

Documents with the same words collapse first. The others get a 64-bit SimHash of their shingles of
five words, and ``BANDS`` keys, each a hash of ``BAND_ROWS`` least shingle hashes. Documents that
share a key meet, and the bit-sliced comparison of ``bitsliced`` finds which of them are within some
bits of each other. It runs at rising radii and keeps the links that join what smaller radii left
apart, so a key sends on at most one link per document, the closest ones, and never its pairs.
Keys with more than ``TILE`` documents are dealt in tiles, one task for each pair of tiles. The
texts of every link are compared exactly; links whose sets of shingles have a Jaccard likeness of
``LEAST_LIKENESS`` or more form groups.

These links are a forest of candidates: one that fails the comparison may hide another that would
not, and some pairs share no key. So a second pass takes all pairs of different groups that can be
alike. Sets of n shingles with a likeness of 0.8 or more share one of the first n - ceil(0.8 n) + 1
shingles in any common order (prefix filter), and one near the front of both. Shingles that a sample
holds often come last in the order; the sample decides how many pairs meet, not which are found. Sets
of a and b shingles with that likeness differ in (a + b) / 9 at most, and each difference changes one
of their parity bits, so pairs with more different bits are passed over where they meet. The
texts of the others are compared as well, and pairs inside a group need no comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.llm.arrowtext import row_slices, split_words
from penmark.llm.bitsliced import SHORT_RUN, SLICE_BYTES, long_run, majority_bits, shingle_hashes, short_runs
from penmark.llm.columns import apart
from penmark.llm.components import connected_components
from penmark.session import materialise, scratch

SHINGLE_WORDS = 5
LEAST_LIKENESS = 0.8
BANDS = 8
BAND_ROWS = 3
# 0.8 in likeness is a cosine of 0.89, or 9.7 bits of 64 on average with a deviation of 2.9.
RADII = (4, 8, 12, 16)
TILE = 1 << 14
# Documents whose shingles are counted for the order of the prefix filter, the least count of a
# frequent shingle, and how many of them are told apart.
ORDER_DOCS = 1 << 14
ORDER_COUNT = 3
ORDER_SHINGLES = 1 << 18
# Bits of a set of shingles, each the parity of those that fall on it, in words of 64.
PARITY_WORDS = 16
SEED = 42


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of hashes modulo 2^64, one pair for each least hash."""
    random = np.random.Generator(np.random.PCG64(SEED))
    return random.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(
        0, 2**63, count, np.uint64
    )


def _mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose high bits depend on all bits."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys (columns) of each text (rows) from its shingle hashes, which begin at ``starts``."""
    factors, summands = _multipliers(BANDS * BAND_ROWS)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        for row in range(BAND_ROWS):
            i = band * BAND_ROWS + row
            least = np.minimum.reduceat(_mixed(hashes * factors[i] + summands[i]), starts)
            keys[:, band] = _mixed(keys[:, band] ^ least) + np.uint64(band)
    return keys


def _distinct_shingles(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, back to back, and their text."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of shingles that several documents of a sample hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, 0, SLICE_BYTES):
                found, _ = _distinct_shingles(
                    *shingle_hashes(split_words(part.column(0), lower=True), SHINGLE_WORDS, SEED)
                )
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    every = max(1, -(-docs.count() // ORDER_DOCS))
    table = (
        docs.filter(F.pmod(F.xxhash64("doc_id", "hash"), F.lit(every)) == 0)
        .select("text")
        .mapInArrow(run, "shingle long")
        .groupBy("shingle")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= ORDER_COUNT)
        .orderBy(F.desc("n"), "shingle")
        .limit(ORDER_SHINGLES)
        .toArrow()
    )
    hashes = table.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], table.column("n").to_numpy()[order]


def prefixes(
    hashes: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First shingles of each text in the common order, back to back, their number, the number of
    distinct shingles, and the parity bits (columns) of all of them."""
    found, doc = _distinct_shingles(hashes, sizes)
    counts = np.zeros(len(found), np.int64)
    if len(frequent[0]):
        at = np.minimum(np.searchsorted(frequent[0], found), len(frequent[0]) - 1)
        counts = np.where(frequent[0][at] == found, frequent[1][at], 0)
    order = np.lexsort((found, counts, doc))
    n = np.bincount(doc, minlength=len(sizes))
    first = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
    place = np.arange(len(found)) - np.repeat(np.cumsum(n) - n, n)
    return found[order][place < np.repeat(first, n)], first, n, parity_bits(found, doc, len(sizes))


def parity_bits(found: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
    """PARITY_WORDS integers (columns) of each of ``count`` texts (rows): a bit is the parity of the
    distinct shingles ``found`` of the text that fall on it."""
    places = PARITY_WORDS * 64
    at = doc * places + (_mixed(found) % np.uint64(places)).astype(np.int64)
    odd = np.bincount(at, minlength=count * places) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64).reshape(count, PARITY_WORDS)


def sketches(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, hash, words, fp, bands, n, bits, prefix) of rows (doc_id, text, hash): a hash of the words
    of the text, its fingerprint, its keys, its number of shingles, their parity bits and the first of
    them by ``frequent``; a text without words has none of them and the hash zero. Of the same words in a task the first row
    alone has a prefix."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(frequent or (np.zeros(0, np.uint64), np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in row_slices(batch, 1, SLICE_BYTES):
                words = split_words(part.column(1), lower=True)
                hashes, sizes = shingle_hashes(words, SHINGLE_WORDS, SEED)
                filled = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[filled]
                keys = np.zeros((len(sizes), BANDS), np.uint64)
                if len(filled):
                    keys[filled] = band_keys(hashes, starts)
                raw = words.data.tobytes()
                first, last = words.docs[:-1], words.docs[1:] - 1
                whole = np.zeros(len(sizes), np.uint64)
                for i in filled.tolist():
                    whole[i] = xxhash.xxh64_intdigest(raw[words.starts[first[i]] : words.ends[last[i]]], SEED)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[filled].ravel().view(np.int64)))
                front, lengths, n, odd = prefixes(hashes, sizes, order.value)
                new = np.zeros(len(sizes), bool)
                for i in filled.tolist():
                    if int(whole[i]) not in seen:
                        seen.add(int(whole[i]))
                        new[i] = True
                front = front[np.repeat(new, lengths)]
                offsets = np.concatenate([[0], np.cumsum(np.where(new, lengths, 0))]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(front.view(np.int64)))
                offsets = np.arange(0, odd.size + 1, PARITY_WORDS, dtype=np.int32)
                bits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(odd.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(whole.view(np.int64)),
                        pa.array(majority_bits(hashes, sizes).view(np.int64)),
                        bands,
                        pa.array(n.astype(np.int32)),
                        bits,
                        prefix,
                    ],
                    names=["doc_id", "hash", "words", "fp", "bands", "n", "bits", "prefix"],
                )

    columns = "doc_id long, hash long, words long, fp long, bands array<long>, n int, bits array<long>, prefix array<long>"
    return docs.mapInArrow(run, columns)


def _closest_links(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) within the largest radius that join all that can be joined, close ones first."""
    group = np.arange(len(values))
    left, right = [], []
    for radius in RADII:
        if len(np.unique(group)) == 1:
            break
        partner = np.full(len(values), -1)
        root = long_run(values, radius, partner=partner)
        linked = np.flatnonzero(partner >= 0)
        for i in linked[np.argsort(root[linked], kind="stable")].tolist():
            a, b = group[i], group[partner[i]]
            if a != b:  # smaller radii left these apart
                group[group == max(a, b)] = min(a, b)
                left.append(i)
                right.append(int(partner[i]))
    return np.array(left, np.int64), np.array(right, np.int64)


def spanning_links(
    count: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (left, right) between ``count`` rows those of a least spanning forest, by rounds in
    which every tree takes its shortest link to another."""
    tree = np.arange(count)
    found: list[np.ndarray] = []
    rank = np.empty(len(left), np.int64)
    rank[np.lexsort((right, left, lengths))] = np.arange(len(left))  # no two links are equally long
    link_of = np.argsort(rank)
    while True:
        a, b = tree[left], tree[right]
        open_now = np.flatnonzero(a != b)
        if not len(open_now):
            break
        best = np.full(count, len(left), np.int64)
        np.minimum.at(best, a[open_now], rank[open_now])
        np.minimum.at(best, b[open_now], rank[open_now])
        trees = np.flatnonzero(best < len(left))
        chosen = link_of[best[trees]]
        found.append(np.unique(chosen))
        parent = np.arange(count)
        parent[trees] = a[chosen] + b[chosen] - trees  # the other end
        both = parent[parent] == np.arange(count)  # two trees that took the same link
        parent = np.where(both & (parent > np.arange(count)), np.arange(count), parent)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        tree = parent[tree]
    links = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return left[links], right[links]


def _run_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, x, i, j, words, fp) in order of the first four: links (a, b) of words."""
    rest: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        bounds = np.concatenate([[0], change, [len(rows)]])
        sizes = np.diff(bounds)
        values = np.ascontiguousarray(rows[:, 5]).view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        # Short runs all at once: every pair within the largest radius, then a forest of them.
        chosen = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT_RUN), sizes))
        if len(chosen):
            runs = np.repeat(np.arange(len(sizes)), sizes)[chosen]
            i, j = short_runs(values[chosen], runs, RADII[-1])
            i, j = chosen[i], chosen[j]
            i, j = spanning_links(len(rows), i, j, np.bitwise_count(values[i] ^ values[j]))
            a.append(rows[i, 4])
            b.append(rows[j, 4])
        for k in np.flatnonzero(sizes > SHORT_RUN).tolist():
            run = slice(bounds[k], bounds[k + 1])
            i, j = _closest_links(values[run])
            a.append(rows[run, 4][i])
            b.append(rows[run, 4][j])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        new = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)], axis=1).astype(np.int64)
        rows = np.concatenate([*rest, new])
        # The last key may go on in the next batch.
        change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
        done = int(change[-1]) if len(change) else 0
        if done:
            yield links(rows[:done])
        rest = [rows[done:]]
    if rest and len(rest[0]):
        yield links(rest[0])


def candidate_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct links (a, b), a < b, of rows (words, fp, bands) with different words."""
    rows = distinct.select("words", "fp", F.posexplode_outer("bands").alias("band", "x")).filter("x is not null")
    shared = rows.groupBy("band", "x").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("words"), F.col("tiles")).cast("int")
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    order = ["band", "x", "i", "j"]
    keys = (
        rows.join(shared, ["band", "x"])
        .withColumn("tiles", tiles)
        .withColumn("own", own)
        .select("band", "x", "words", "fp", "own", F.explode(others).alias("other"))
        .select(
            "band", "x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "words", "fp"
        )
    )
    # A fixed number of tasks: rows are short for the work that they make, and would be put together.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = (
        keys.repartition(tasks, *order)
        .sortWithinPartitions(*order, "words")
        .mapInArrow(_run_links, "a long, b long")
    )
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def likeness(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Jaccard likeness of the sets of shingles of two columns of texts, row by row."""
    sides = []
    for column in (left, right):
        hashes, sizes = shingle_hashes(split_words(column, lower=True), SHINGLE_WORDS, SEED)
        ends = np.cumsum(sizes)
        sides.append([np.unique(hashes[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
    out = np.ones(len(left))
    for i, (a, b) in enumerate(zip(*sides, strict=True)):
        common = len(np.intersect1d(a, b, assume_unique=True))
        union = len(a) + len(b) - common
        out[i] = common / union if union else 1.0
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, left, right): links whose texts are alike."""
    for batch in batches:
        for part in row_slices(batch, 2, SLICE_BYTES):
            for piece in row_slices(part, 3, SLICE_BYTES):
                alike = pa.array(likeness(piece.column(2), piece.column(3)) >= LEAST_LIKENESS)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(i).filter(alike) for i in range(2)], names=["a", "b"]
                )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, words, place) in order: those whose shingle other words hold, each once."""
    rest = np.zeros((0, 3), np.int64)

    def met(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        same = rows[1:, 0] == rows[:-1, 0]
        rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], names=["shingle", "words", "place"]
        )

    for batch in batches:
        if not len(batch):
            continue
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
        rows = np.concatenate([rest, rows])
        # The last shingle may go on in the next batch.
        done = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if done:
            yield met(rows[:done])
        rest = rows[done:]
    if len(rest):
        yield met(rest)


def shared_prefixes(prints: DataFrame) -> DataFrame:
    """(shingle, words, place) of the shingles that stand in the prefixes of several word sequences."""
    rows = prints.select("words", F.posexplode_outer("prefix").alias("place", "shingle")).filter("shingle is not null")
    # A fixed number of tasks, as in ``candidate_links``.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.select("shingle", "words", F.col("place").cast("long").alias("place"))
        .repartition(tasks, "shingle")
        .sortWithinPartitions("shingle", "words")
        .mapInArrow(_met, "shingle long, words long, place long")
    )


def open_pairs(shared: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of words in different groups that can be alike, of rows of
    ``shared_prefixes`` and (words, n, bits, component): overlaps of 4/9 of both sizes are 0.8 in likeness,
    and leave 1/9 of them for differences."""
    rows = shared.join(members.drop("bits"), "words")
    mixed = (
        rows.groupBy("shingle")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high")
        .select("shingle")
    )
    rows = rows.join(mixed, "shingle", "left_semi").withColumn("left_over", F.col("n") - F.col("place"))
    rows = rows.join(members.select("words", "bits"), "words")
    columns = ("words", "n", "component", "left_over", "bits")
    one, other = (rows.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in ("a", "b"))
    enough = 9 * F.least("a_left_over", "b_left_over") >= 4 * (F.col("a_n") + F.col("b_n"))
    apart_in = sum(F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(PARITY_WORDS))
    few = 9 * apart_in <= F.col("a_n") + F.col("b_n")
    different = (F.col("a_words") < F.col("b_words")) & (F.col("a_component") != F.col("b_component"))
    return (
        one.join(other, "shingle")
        .filter(different & enough & few)
        .select(F.col("a_words").alias("a"), F.col("b_words").alias("b"))
        .distinct()
    )


def alike(links: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (a, b) whose texts are alike, written; ``distinct`` names a row of ``docs`` for each words."""
    linked = links.select(F.col("a").alias("words")).union(links.select("b")).distinct()
    # Texts of linked documents alone; rows that repeat an id and a text come once.
    wanted = distinct.join(linked, "words").select("words", "doc_id", "hash")
    texts = (
        docs.withColumn("_id", F.xxhash64("doc_id"))
        .join(wanted.select("words", F.xxhash64("doc_id").alias("_id"), "hash"), ["_id", "hash"])
        .groupBy("words")
        .agg(F.first("text").alias("text"))
    )
    with scratch(texts, "linked-texts") as texts:
        pairs = (
            links.join(texts.select(F.col("words").alias("a"), F.col("text").alias("left")), "a")
            .join(texts.select(F.col("words").alias("b"), F.col("text").alias("right")), "b")
            .select("a", "b", "left", "right")
        )
        return materialise(pairs.mapInArrow(_verified, "a long, b long"), "alike")


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(words, doc_id, hash, component) of each distinct word sequence of ``docs`` (doc_id, text,
    hash): its least row, and the least row's words of its group as ``component``."""
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    with scratch(sketches(docs, frequent_shingles(docs)), "sketches") as prints:
        distinct = materialise(
            prints.groupBy("words")
            .agg(
                F.min(row).alias("row"), F.first("fp").alias("fp"), F.first("bands").alias("bands"),
                F.first("n").alias("n"), F.first("bits").alias("bits"),
            )
            .select("words", "row.*", "fp", "bands", "n", "bits"),
            "distinct",
        )
        prefixes = materialise(shared_prefixes(prints), "prefixes")
    with scratch(candidate_links(distinct.select("words", "fp", "bands")), "links") as links:
        close = connected_components(alike(links, distinct, docs))
    # What the candidates left apart: all other pairs that can be alike.
    members = distinct.select("words", "n", "bits").join(close.withColumnRenamed("node", "words"), "words", "left")
    members = members.withColumn("component", F.coalesce("component", "words"))
    edges = close.select(F.col("node").alias("a"), F.col("component").alias("b"))
    with scratch(open_pairs(prefixes, members), "open-pairs") as others:
        groups = connected_components(edges.union(alike(others, distinct, docs)))
    return distinct.join(groups.withColumnRenamed("node", "words"), "words", "left").select(
        "words", "last", "doc_id", "hash", F.coalesce("component", "words").alias("component")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each group of near-duplicates.

    Rows without a doc_id rank last. Of different texts under one doc_id in a group the one with the
    least hash stays, of repeated rows one. Null and empty texts, and texts of blanks, are alike and
    like no others. All columns are kept, and an empty table stays empty. Python gets ids and texts
    and returns hashes; the rows themselves are joined once, at the end.
    """
    docs, restored = apart(docs, ("doc_id", "text"))
    keyed = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_id", F.xxhash64("doc_id"))
    narrow = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("_hash").alias("hash"))
    chosen = (
        near_copy_groups(narrow)
        .groupBy("component")
        .agg(F.min(F.struct("last", "doc_id", "hash")).alias("row"))
        .select(
            F.xxhash64(F.col("row.doc_id").cast(docs.schema["doc_id"].dataType)).alias("_id"),
            F.col("row.hash").alias("_hash"),
        )
    )
    # One exchange of the rows serves the join and the removal of repeated rows.
    kept = keyed.join(chosen, ["_id", "_hash"], "left_semi")
    return restored(kept.dropDuplicates(["_id", "_hash"]))
