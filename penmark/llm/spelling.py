"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

A sorted list is scanned for each query word. The rows of the edit matrix belong to the letters of
the list word, so a row is kept for every letter that the next word shares, and only cells at most
one place off the diagonal are filled. When a row has no cell below two, no word with that prefix
is near: the scan goes on behind the range of words that share it. All queries of a batch take one
step at a time, in numpy.

Two words one edit apart share either the first p = (length - 1) // 2 letters of the query or its
last length - p. So there are two lists, of words and of reversed words, and a query looks only at
the range with its own prefix. Both lists are cut into blocks of consecutive words. A query goes to
the blocks its range meets; if they are many, as with a prefix that a third of all words share, the
same scan runs over the blocks' common prefixes and skips blocks more than one edit away. A pair
whose first p letters agree counts in the first list alone.

Forms point to words at least twice as frequent, so chains end; roots spread from words without a
form, one join a link. A word has no more followers than neighbours, which bounds the join's groups.

Defined results. Null texts have no words; a row without doc_id has its runs unchanged; repeated
rows count again. No word, no row. Other columns are ignored. Building the result writes tables of
words (no texts) to the shared folder.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.ranges import with_positions
from penmark.session import materialise

LEAST_LENGTH = 5
LEAST_COUNT = 3
DELETED_OF = 97
# Words of a block at least; more if that would make more than MOST_BLOCKS of them.
BLOCK = 4096
MOST_BLOCKS = 16_384
# Letters of the first and last word of a block that all tasks get: 2 x 64 x MOST_BLOCKS in all.
BOUND = 64
BATCH_CELLS = 1 << 20

# Letters of a run (after A-Z are lower-cased) and a character behind all letters.
RUN = "[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = "\U0010ffff"


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of lower-cased runs, of which one in DELETED_OF lacks a letter chosen by checksum."""
    # An outer generator: an inner one adds a filter that extracts all runs once more.
    runs = docs.select(
        "doc_id",
        F.explode_outer(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= least_length)
    check = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    place = (F.col("check") % F.length("run")).cast("int")
    shorter = F.concat(
        F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run"))
    )
    words = runs.withColumn("check", check).select(
        F.when(F.col("check") % DELETED_OF == 0, shorter).otherwise(F.col("run")).alias("word")
    )
    # One condition on count and length, which is not pushed below the count.
    frequent = F.when(F.col("n") >= least_count, F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(frequent)


class Words:
    """Words back to back as code points; word i is data[at[i] : at[i + 1]]."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.data = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


class SortedList(Words):
    """A list with the prefix that each word shares with the one before (``shared``) and, for each
    letter, the end of the range of words that share the prefix up to it (``ends``)."""

    def __init__(self, words: list[str]):
        super().__init__(words)
        n = len(words)
        self.shared = np.zeros(n + 1, np.int64)
        same, depth = np.arange(1, n), 0
        while len(same):
            same = same[np.minimum(self.lengths[same], self.lengths[same - 1]) > depth]
            same = same[self.data[self.at[same] + depth] == self.data[self.at[same - 1] + depth]]
            depth += 1
            self.shared[same] = depth
        self.ends = np.zeros(len(self.data), np.int64)
        longer, depth = np.arange(n), 0
        while len(longer := longer[self.lengths[longer] > depth]):
            first = np.ones(len(longer), bool)
            first[1:] = (np.diff(longer) != 1) | (self.shared[longer[1:]] <= depth)
            last = np.append(np.flatnonzero(first)[1:], len(longer)) - 1
            self.ends[self.at[longer] + depth] = (longer[last] + 1)[np.cumsum(first) - 1]
            depth += 1


def scan(
    words: SortedList, queries: Words, low: np.ndarray, high: np.ndarray, prefixes: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) one edit apart, for words low[q] to high[q] - 1 of the list.

    With ``prefixes``, pairs in which the word is at most one edit from a prefix of the query.
    """
    rows = np.full((len(low), int(queries.lengths.max(initial=0)) + 2, 3), 2, np.uint8)
    rows[:, 0] = (2, 0, 1)  # cell b of row d is the column d + b - 1
    query = np.flatnonzero(low < high)
    word, depth = low[query], np.zeros(len(query), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    most = max(len(queries.data) - 1, 0)
    while len(query):
        ended = depth == words.lengths[word]
        if ended.any():
            q, w = query[ended], word[ended]
            if prefixes:
                near = rows[q, depth[ended]].min(axis=1) <= 1
            else:
                cell = queries.lengths[q] - words.lengths[w] + 1
                near = (cell >= 0) & (cell <= 2)
                near &= rows[q, depth[ended], np.clip(cell, 0, 2)] == 1
            found.append((q[near], w[near]))
        on = ~ended
        q, w, d = query[on], word[on], depth[on]
        letter, old = words.data[words.at[w] + d], rows[q, d]
        new, left = np.empty_like(old), 2
        for b in range(3):
            at = np.clip(queries.at[q] + d + b - 1, 0, most)
            cell = old[:, b] + (letter != queries.data[at])
            if b < 2:
                cell = np.minimum(cell, old[:, b + 1] + 1)
            cell = np.minimum(np.minimum(cell, left + 1), 2)
            new[:, b] = left = np.where(d + b > queries.lengths[q], 2, cell)
        alive = new.min(axis=1) < 2
        rows[q[alive], d[alive] + 1] = new[alive]
        step = np.where(alive, w, words.ends[words.at[w] + d])
        word[on], depth[on] = step, np.where(alive, d + 1, np.minimum(words.shared[step], d))
        word[ended] += 1
        depth[ended] = np.minimum(words.shared[word[ended]], depth[ended])
        stay = word < high[query]
        query, word, depth = query[stay], word[stay], depth[stay]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _batches(words: list[str]) -> Iterator[slice]:
    """Slices whose matrices have about BATCH_CELLS rows; a longer word is a slice."""
    start, longest = 0, 0
    for i, word in enumerate(words):
        longest = max(longest, len(word))
        if i > start and (i + 1 - start) * (longest + 2) > BATCH_CELLS:
            yield slice(start, i)
            start, longest = i, len(word)
    if start < len(words):
        yield slice(start, len(words))


def _own_prefix(length: int, side: int) -> int:
    """Letters that a query of a side shares with all words it looks at."""
    front = (length - 1) // 2
    return front if side == 0 else length - front


def _to_blocks(bounds: dict[int, tuple[list[str], list[str]]]):
    """Rows (block, kind, key, n): every word in its block, and as a query in each that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        commons = {s: [commonprefix(x) for x in zip(*b, strict=True)] for s, b in bounds.items()}
        lists: dict[int, SortedList] = {}
        for batch in batches:
            sides, blocks, keys, counts = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple[int, int, str, int]] = []
            many: dict[int, list[tuple[str, int, int, int]]] = {0: [], 1: []}
            for side, block, key, n in zip(sides, blocks, keys, counts, strict=True):
                out.append((2 * block + side, 0, key, n))
                firsts, lasts = bounds[side]
                prefix = key[: _own_prefix(len(key), side)][:BOUND]
                low, high = bisect_left(lasts, prefix), bisect_right(firsts, prefix + LAST)
                if high - low > 2:
                    many[side].append((key, n, low, high))
                else:
                    out += [(2 * b + side, 1, key, n) for b in range(low, high)]
            for side, wide in many.items():
                if wide and side not in lists:
                    lists[side] = SortedList(commons[side])
                for part in _batches([x[0] for x in wide]):
                    some = wide[part]
                    low, high = (np.array([x[i] for x in some]) for i in (2, 3))
                    q, b = scan(lists[side], Words([x[0] for x in some]), low, high, prefixes=True)
                    out += [(2 * j + side, 1, *some[i][:2]) for i, j in zip(q.tolist(), b.tolist(), strict=True)]
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()), strict=True)
                ],
                names=["block", "kind", "key", "n"],
            )

    return run


def _near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, key, n) in order of block, kind 0 (the list) before 1 (queries), key."""
    at, words, counts, index = None, [], [], None
    for batch in batches:
        blocks, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        keys, numbers = batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if start == end:
                continue
            if blocks[start] != at:
                at, words, counts, index = blocks[start], [], [], None
            if kinds[start] == 0:
                words += keys[start:end]
                counts.append(numbers[start:end])
                continue
            if index is None:
                index, counts = SortedList(words), [np.concatenate(counts)]
            for part in _batches(keys[start:end]):
                some = keys[start:end][part]
                yield _nearest(index, words, counts[0], some, numbers[start:end][part], int(at) % 2)


def _nearest(index, words, counts, queries, numbers, side) -> pa.RecordBatch:
    """For each query its number of near words in the list, and the first by count, then word."""
    prefixes = [q[: _own_prefix(len(q), side)] for q in queries]
    low = np.array([bisect_left(words, p) for p in prefixes], np.int64)
    high = np.array([bisect_right(words, p + LAST) for p in prefixes], np.int64)
    n_near, best = [0] * len(queries), [None] * len(queries)
    for q, w in zip(*(x.tolist() for x in scan(index, Words(queries), low, high)), strict=True):
        query, word = queries[q], words[w]
        if side == 1:
            front = _own_prefix(len(query), 0)
            query, word = query[::-1], word[::-1]
            if query[:front] == word[:front]:  # a pair of the first list
                continue
        n_near[q] += 1
        rank = (-int(counts[w]), word)
        if best[q] is None or rank < best[q]:
            best[q] = rank
    return pa.RecordBatch.from_arrays(
        [
            pa.array([q if side == 0 else q[::-1] for q in queries], pa.string()),
            pa.array(numbers, pa.int64()),
            pa.array(n_near, pa.int64()),
            pa.array([None if b is None else b[0] for b in best], pa.int64()),
            pa.array([None if b is None else b[1] for b in best], pa.string()),
        ],
        names=["word", "n", "n_near", "less", "near"],
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n) of distinct words (word, n): the number of words one edit
    apart and the most frequent of them, the first in code-point order if several are."""
    sides, bounds = [], {}
    for side, key in enumerate((F.col("word"), F.reverse("word"))):
        keyed = with_positions(words.select(key.alias("key"), "n"), [F.col("key")], "at")
        if side == 0:
            size = max(BLOCK, -(-words.count() // MOST_BLOCKS))
        blocked = materialise(
            keyed.select(
                F.lit(side).alias("side"), F.floor(F.col("at") / size).alias("block"), "key", "n"
            ),
            "blocks",
        )
        # Two cut words for each block, of which there are at most MOST_BLOCKS.
        ends = blocked.groupBy("block").agg(
            F.min("key").substr(1, BOUND).alias("first"), F.max("key").substr(1, BOUND).alias("last")
        )
        table = ends.orderBy("block").toArrow()
        bounds[side] = table.column("first").to_pylist(), table.column("last").to_pylist()
        sides.append(blocked)
    found = (
        sides[0]
        .union(sides[1])
        .mapInArrow(_to_blocks(bounds), "block long, kind int, key string, n long")
        .repartition("block")
        .sortWithinPartitions("block", "kind", "key")
        .mapInArrow(_near_words, "word string, n long, n_near long, less long, near string")
    )
    best = F.min(F.when(F.col("near").isNotNull(), F.struct("less", "near")))
    return (
        found.groupBy("word")
        .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form) whose chains of forms end."""
    level = materialise(forms.filter("form is null").select("word", F.col("word").alias("root")), "roots")
    done, links = level, forms.filter("form is not null").select("word", "form")
    while True:
        level = materialise(
            links.join(level.select(F.col("word").alias("form"), "root"), "form").select("word", "root"),
            "roots",
        )
        if level.isEmpty():
            return done
        done = done.union(level)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text)."""
    near = near_words(materialise(count_words(docs), "words"))
    enough = F.col("near_n") >= 2 * F.col("n")
    forms = materialise(
        near.select(
            "word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")
        ),
        "forms",
    )
    return forms.join(roots(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")
