"""Hashed maximum-entropy language model with a class-factored softmax.

A token is predicted in three steps: a family of classes and the class within it, both from the words
before by a softmax over hashed n-gram and skip features; then the word within its class by
frequency. Classes are: rare words (unknown ones and those seen once), the end of a text, the most
frequent words one by one, and groups of the other words by how they begin and end; ``FAMILY`` of
them in that order are a family. So a token takes two softmaxes over 16 instead of one over 256. With
all weights at zero the classes have their frequencies, so training starts from a unigram model.

Texts are tokenised once into chunks, each with a dictionary of its own; a window over the
dictionaries adds up each word's occurrences in training texts (one row for each word and chunk), and
the counts return to their chunks. So the vocabulary is never held in one place. Training takes the
chunks in ``ROUNDS`` disjoint parts: each task makes stochastic gradient steps over its part from
the common weights, and the next weights are the mean of the changes, summed exactly in fixed
point. Weights, 17 rows of 16 numbers for each of ``BUCKETS``, are all that reaches the driver. Scoring goes
through the chunks once in sparse batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.arrowtext import gather_runs, row_slices, split_words, string_array
from penmark.llm.hdlang import remainder
from penmark.session import materialise

FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 12 << 20
FREQUENT = 126  # words with a class of their own
FREQUENT_SHARE = 1 / 4096  # of all tokens, which such a word has at least
GROUPS = 128
CLASSES = 2 + FREQUENT + GROUPS
FAMILY = 16  # classes of a family
FAMILIES = CLASSES // FAMILY
# Rows of weights of a bucket: one for the families, then one for the classes of each family.
ROWS = 1 + FAMILIES
RARE, END = 0, 1
BUCKETS = 1 << 13  # a power of two
ROUNDS = 2
BATCH = 4096  # a power of two
RATE = 0.3
SCALE = 1024  # fixed point of the changes of weights
WEIGHT_BLOCK = 1024  # rows of weights that are summed together

CHUNK = (
    "chunk long, words array<long>, groups array<int>, counts array<long>, "
    "doc_ids array<long>, held array<boolean>, lengths array<long>, codes binary"
)


def _one(values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A list column with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, mask=mask))


def _packed(codes: np.ndarray) -> bytes:
    """Codes as compressed planes of their bytes; high bytes are mostly alike."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * count, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, count).T).view("<u4").ravel()


def _chunks(docs: DataFrame) -> DataFrame:
    """Tokenised texts, a few million bytes to a row: dictionary, training counts and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in row_slices(batch, 1, CHUNK_BYTES):
                words = split_words(part.column(1), lower=True)
                # Slices with the space that follows each word lie back to back.
                cuts = np.concatenate([words.starts, [len(words.data)]])
                coded = string_array(words.data, cuts).dictionary_encode()
                codes = coded.indices.to_numpy().astype(np.uint32)
                known = coded.dictionary
                places = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1]
                raw = known.buffers()[2].to_pybytes() if len(known) else b""
                ends = places.tolist()
                hashes = np.fromiter(
                    (xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(ends, ends[1:])),
                    np.uint64,
                    len(known),
                ).view(np.int64)
                letters = np.frombuffer(raw, np.uint8).astype(np.int64)
                first = letters[places[:-1]]
                second = letters[np.minimum(places[:-1] + 1, places[1:] - 1)]
                last = letters[np.maximum(places[1:] - 2, places[:-1])]
                marked = (last < 0x30) | ((last > 0x39) & (last < 0x61))
                groups = ((first * 31 + second) % (GROUPS // 2)) * 2 + marked
                held = part.column(2).to_numpy(zero_copy_only=False)
                lengths = np.diff(words.docs)
                counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(known))
                missing = part.column(0).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        _one(hashes),
                        _one(groups.astype(np.int32)),
                        _one(counts.astype(np.int64)),
                        _one(part.column(0).fill_null(0).to_numpy(), missing),
                        _one(held),
                        _one(lengths.astype(np.int64)),
                        pa.array([_packed(codes)], pa.binary()),
                    ],
                    names=[f.split()[0] for f in CHUNK.split(", ")],
                )
                name += 1

    return docs.mapInArrow(run, CHUNK)


class Totals(NamedTuple):
    """What is known of the training tokens as a whole."""

    tokens: int  # N
    distinct: int  # V
    ends: int  # training texts
    once: int  # words that occur once
    twice: int


def _counted(chunks: DataFrame) -> tuple[DataFrame, Totals, np.ndarray]:
    """(chunk, place, n, class) of each dictionary word, totals, and tokens of each class."""
    sums = chunks.select(
        F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"),
        F.size(F.filter("held", lambda h: ~h)).cast("long").alias("ends"),
    ).agg(F.sum("n"), F.sum("ends")).first()
    words, ends = sums[0] or 0, sums[1] or 0
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "groups", "counts"))).select(
        "chunk",
        F.col("pos").alias("place"),
        F.col("col.words").alias("word"),
        F.col("col.groups").alias("group"),
        F.col("col.counts").alias("own"),
    )
    # One row for each word of a chunk, so a word has as many rows as there are chunks at most.
    of_word = Window.partitionBy("word")
    frequent = F.col("n") >= max(2, (words + ends) * FREQUENT_SHARE)
    counted = materialise(
        rows.withColumn("n", F.sum("own").over(of_word))
        .withColumn("first", F.row_number().over(of_word.orderBy("chunk")) == 1)
        .select("chunk", "place", "group", "n", "first", F.when(frequent, F.col("word")).alias("word")),
        "counts",
    )
    seen = counted.filter("first and n > 0")
    top = seen.filter("word is not null").orderBy(F.desc("n"), "word").limit(FREQUENT)
    # One row for each of the FREQUENT words.
    ranks = [(r.word, 2 + i) for i, r in enumerate(top.select("word").collect())]
    own = chunks.sparkSession.createDataFrame(ranks, "word long, own int")
    classed = counted.join(F.broadcast(own), "word", "left").withColumn(
        "class",
        F.coalesce("own", F.when(F.col("n") < 2, F.lit(RARE)), F.lit(2 + FREQUENT) + F.col("group")).cast("int"),
    )
    totals = np.zeros(CLASSES, np.int64)
    distinct = once = twice = 0
    for r in (
        classed.filter("first and n > 0")
        .groupBy("class")
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("words"),
            F.count_if(F.col("n") == 1).alias("once"),
            F.count_if(F.col("n") == 2).alias("twice"),
        )
        .collect()
    ):
        totals[r["class"]] = r["n"]
        distinct, once, twice = distinct + r["words"], once + r["once"], twice + r["twice"]
    totals[END] = ends
    return (
        classed.select("chunk", "place", "n", "class"),
        Totals(words + ends, distinct + (ends > 0), ends, once, twice),
        totals,
    )


def _labelled(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """The chunks with counts and classes of their dictionaries, in the order of the dictionary."""
    entries = counted.groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("place", "n", "class"))).alias("entries")
    )
    return (
        # Features need no more than some bits of a word's hash.
        chunks.withColumn("words", F.transform("words", lambda w: w.bitwiseAND(0x7FFFFFFF).cast("int")))
        .select("chunk", "words", "doc_ids", "held", "lengths", "codes")
        .join(entries, "chunk", "left")
        .select(
            "words",
            "doc_ids",
            "held",
            "lengths",
            "codes",
            F.coalesce(F.transform("entries", lambda e: e["n"]), F.array().cast("array<long>")).alias("counts"),
            F.coalesce(F.transform("entries", lambda e: e["class"]), F.array().cast("array<int>")).alias("classes"),
        )
    )


class Tokens(NamedTuple):
    """Targets and hashed features of all tokens of a chunk, ends included."""

    classes: np.ndarray
    counts: np.ndarray
    features: np.ndarray  # tokens x 4 buckets
    bounds: np.ndarray  # tokens of each text


def _mixed(*parts: np.ndarray, salt: int) -> np.ndarray:
    out = np.full(len(parts[0]), salt, np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out & np.uint64(BUCKETS - 1)).astype(np.int32)


def _tokens(batch: pa.RecordBatch, row: int, totals: Totals, chosen: np.ndarray) -> Tokens:
    """Of the chosen texts of a chunk. Before a text stand blanks, which have a class of their own."""
    array = lambda name: batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    lengths = array("lengths")
    codes = _unpacked(batch.column("codes")[row].as_py(), int(lengths.sum()))
    starts = np.cumsum(lengths) - lengths
    codes = gather_runs(codes, starts[chosen], lengths[chosen])
    lengths = lengths[chosen]
    ends = np.cumsum(lengths + 1) - 1
    size = int(ends[-1]) + 1 if len(ends) else 0
    inside = np.ones(size, bool)
    inside[ends] = False
    words, classes = np.full(size, 1, np.uint64), np.full(size, END, np.int32)
    counts = np.full(size, totals.ends, np.int64)
    words[inside] = array("words")[codes].astype(np.uint64)
    classes[inside] = array("classes")[codes]
    counts[inside] = array("counts")[codes]
    nth = np.arange(size) - np.repeat(ends - lengths, lengths + 1)

    def back(values: np.ndarray, by: int, blank: int) -> np.ndarray:
        out = np.full(size, blank, values.dtype)
        out[by:] = values[:-by] if by < size else values[:0]
        out[nth < by] = blank
        return out

    w1, w2 = back(words, 1, 0), back(words, 2, 0)
    c1, c2, c3 = (back(classes, k, CLASSES) for k in (1, 2, 3))
    features = np.stack(
        [
            _mixed(w1, salt=1),  # word before
            _mixed(w2, salt=2),  # skip: the word before that
            _mixed(c1, c2, salt=3),  # n-gram of classes
            _mixed(c2, c3, salt=4),  # skip n-gram of classes
        ]
    ).T  # the buckets of one feature lie together
    return Tokens(classes, counts, features, np.concatenate([[0], ends + 1]))


class Level(NamedTuple):
    """One softmax of each token: its rows of weights, its bias and what it should give."""

    rows: np.ndarray  # tokens x 4
    bias: np.ndarray
    targets: np.ndarray


class Bias(NamedTuple):
    """Logarithms of the shares of families, and of classes in their family."""

    families: np.ndarray
    classes: np.ndarray


def _bias(of_class: np.ndarray) -> Bias:
    counts = (of_class + 1).astype(float).reshape(FAMILIES, FAMILY)
    sums = counts.sum(axis=1)
    return Bias(
        np.log(sums / sums.sum()).astype(np.float32), np.log(counts / sums[:, None]).astype(np.float32)
    )


def _levels(features: np.ndarray, classes: np.ndarray, bias: Bias) -> tuple[Level, Level]:
    family, own = np.divmod(classes, FAMILY)
    first = features * ROWS
    return (
        Level(first, bias.families, family),
        Level(first + 1 + family[:, None], bias.classes.take(family, axis=0), own),
    )


def _probabilities(weights: np.ndarray, level: Level) -> np.ndarray:
    """FAMILY x tokens: numpy reduces few long rows much faster than many rows of 16 numbers."""
    out = weights.take(level.rows[:, 0], axis=0)
    for k in range(1, level.rows.shape[1]):
        out += weights.take(level.rows[:, k], axis=0)
    out += level.bias
    out = np.ascontiguousarray(out.T)
    out -= out.max(axis=0)
    np.exp(out, out=out)
    sums = out[: FAMILY // 2] + out[FAMILY // 2 :]
    while len(sums) > 1:
        sums = sums[0::2] + sums[1::2]
    out /= sums
    return out


def step(weights: np.ndarray, squares: np.ndarray, level: Level) -> None:
    """One gradient step on a batch, in place; each row of weights has a rate of its own."""
    slope = _probabilities(weights, level)
    slope[level.targets, np.arange(len(level.targets))] -= 1
    slope = np.ascontiguousarray(slope.T)
    whole = weights.view(f"V{weights[0].nbytes}")[:, 0]  # each row as one item, which is stored faster
    for ids, order in zip(*_sorted_ids(level.rows)):
        rows, sums = _row_sums(slope, ids, order)
        seen = squares.take(rows)
        seen += np.einsum("ij,ij->i", sums, sums)
        squares[rows] = seen
        sums *= (RATE / np.sqrt(seen + 1e-6))[:, None]
        whole[rows] = (weights.take(rows, axis=0) - sums).view(whole.dtype)[:, 0]


def _sorted_ids(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each column in order, and their places: one sort of both in one number, 18 + 12 bits."""
    keys = rows.T * np.int32(BATCH) + np.arange(len(rows), dtype=np.int32)
    keys.sort(axis=1)
    return keys // np.int32(BATCH), keys & np.int32(BATCH - 1)


def _row_sums(values: np.ndarray, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids, and the sum of the rows of ``values`` that have each; most have one row only."""
    again = np.zeros(len(ids) + 1, bool)
    np.equal(ids[1:], ids[:-1], out=again[1:-1])
    first = ~again[:-1]
    sums = values.take(order[first], axis=0)
    several = again[:-1] | again[1:]
    if several.any():
        sums[again[1:][first]] = np.add.reduceat(
            values.take(order[several], axis=0), np.flatnonzero(first[several]), axis=0
        )
    return ids[first], sums


def _round(
    labelled: DataFrame, totals: Totals, weights: np.ndarray, bias: Bias, part: int, rounds: int
) -> np.ndarray:
    """Weights after one round over the training texts of ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, squares = weights.copy(), np.zeros(len(weights), np.float32)
        for batch in batches:
            for row in range(len(batch)):
                held = np.array(batch.column("held")[row].as_py(), bool)
                turn = np.arange(len(held)) % rounds == part
                tokens = _tokens(batch, row, totals, np.flatnonzero(~held & turn))
                for at in range(0, len(tokens.classes), BATCH):
                    span = slice(at, at + BATCH)
                    for level in _levels(tokens.features[span], tokens.classes[span], bias):
                        step(own, squares, level)
                del tokens  # before the next chunk is taken apart
        change = np.clip(np.rint((own - weights) * SCALE), -32767, 32767).astype("<i2")
        touched = squares > 0
        for block in range(len(weights) // WEIGHT_BLOCK):
            span = slice(block * WEIGHT_BLOCK, (block + 1) * WEIGHT_BLOCK)
            if touched[span].any():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]),
                        pa.array([change[span].tobytes()], pa.binary()),
                        pa.array([touched[span].tobytes()], pa.binary()),
                    ],
                    names=["block", "change", "touched"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, times = None, None, None

        def mean() -> pa.RecordBatch:
            out = (total / (np.maximum(times, 1)[:, None] * SCALE)).astype("<f4")
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.array([out.tobytes()], pa.binary())], names=["block", "mean"]
            )

        for batch in batches:  # in the order of blocks
            for name, change, touched in zip(*batch.columns):
                if name.as_py() != block:
                    if block is not None:
                        yield mean()
                    block = name.as_py()
                    total = np.zeros((WEIGHT_BLOCK, FAMILY), np.int64)
                    times = np.zeros(WEIGHT_BLOCK, np.int64)
                total += np.frombuffer(change.as_buffer(), "<i2").reshape(WEIGHT_BLOCK, FAMILY)
                times += np.frombuffer(touched.as_buffer(), bool)
        if block is not None:
            yield mean()

    changes = (
        labelled.mapInArrow(run, "block long, change binary, touched binary")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(add, "block long, mean binary")
        .toArrow()
    )
    out = weights.copy()
    for block, mean in zip(changes.column("block").to_pylist(), changes.column("mean").to_pylist()):
        span = slice(block * WEIGHT_BLOCK, (block + 1) * WEIGHT_BLOCK)
        out[span] += np.frombuffer(mean, "<f4").reshape(WEIGHT_BLOCK, FAMILY)
    return out


def _within(counts: np.ndarray, classes: np.ndarray, totals: Totals, of_class: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each word within its class.

    The mass of rare words is dealt to unknown words and to words seen once as their numbers of
    words seen once and twice suggest.
    """
    spread = totals.once + 2 * totals.twice + 2
    unknown = np.log((totals.once + 1) / spread)
    single = np.log((2 * totals.twice + 1) / spread) - np.log(max(totals.once, 1))
    with np.errstate(divide="ignore"):
        common = np.log(counts) - np.log(np.maximum(of_class[classes], 1))
    common[classes == END] = 0.0
    return np.where(classes == RARE, np.where(counts == 0, unknown, single), common)


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 7 is not 2.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (tokens that occur in training
    texts), train_tokens, base_score (log10 probability by smoothed frequencies) and score (by the
    model). A null text is empty and has its end alone; a null doc_id counts as the empty text in
    the choice of the fold; repeated rows are documents of their own; an empty table gives no
    rows; without training texts every token is unknown. Other columns are ignored.
    """
    fold = remainder("doc_id", FOLDS) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold.alias("held"))
    chunks = materialise(_chunks(rows), "chunks")
    counted, totals, of_class = _counted(chunks)
    labelled = materialise(_labelled(chunks, counted), "labelled")
    bias = _bias(of_class)
    weights = np.zeros((BUCKETS * ROWS, FAMILY), np.float32)
    for part in range(rounds):
        weights = _round(labelled, totals, weights, bias, part, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.log10(totals.tokens + totals.distinct + 1)
        for batch in batches:
            for row in range(len(batch)):
                texts = len(batch.column("held")[row])
                tokens = _tokens(batch, row, totals, np.arange(texts))
                logs = _within(tokens.counts, tokens.classes, totals, of_class)
                for at in range(0, len(logs), BATCH):
                    span = slice(at, at + BATCH)
                    for level in _levels(tokens.features[span], tokens.classes[span], bias):
                        shares = _probabilities(weights, level)
                        logs[span] += np.log(
                            np.maximum(shares[level.targets, np.arange(len(level.targets))], 1e-30)
                        )
                first = tokens.bounds[:-1]
                total = lambda x: np.add.reduceat(x, first) if texts else x
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[row].values,
                        batch.column("held")[row].values,
                        pa.array(np.diff(tokens.bounds)),
                        pa.array(total((tokens.counts > 0).astype(np.int64))),
                        pa.array(total(np.log10(tokens.counts + 1) - whole)),
                        pa.array(total(logs) / np.log(10)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )
                del tokens, logs

    scored = labelled.mapInArrow(
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
