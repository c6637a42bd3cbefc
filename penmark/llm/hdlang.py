"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 that depends on its code point and the seed alone.
An n-gram of three letters binds them, each permuted (rotated) by its place, by multiplication; a
text bundles its n-grams by addition. Runs of other characters count as one blank; an n-gram may
begin or end with a blank, but not hold one in the middle. A language prototype bundles the
n-grams of all its training texts. The language of a text is that of the prototype with the
largest cosine.

Bundling is linear, so prototypes come from counts of n-grams per language, summed by Spark before
any vector is built, in whole numbers that do not depend on the order of addition. Languages times
dimensions numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.arrowtext import row_slices
from penmark.llm.columns import apart

DIMENSIONS = 1024
SEED = 42
# Texts taken apart at a time; the arrays of their n-grams take some sixty times as much.
SLICE_BYTES = 1 << 20
UNDETERMINED = "und"
# Texts whose best cosine is below this are not of any known language.
LEAST_SCORE = 0.05

_SHIFT = 21  # bits of a code point


@lru_cache(maxsize=100_000)
def letter_vector(point: int, dimensions: int, seed: int) -> np.ndarray:
    """The random vector of a letter; code point 0 is the blank."""
    bits = np.random.Generator(np.random.PCG64([seed, point])).integers(0, 2, dimensions, np.int8)
    return bits * 2 - 1


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Bound vectors of n-grams, each given as three code points in one long."""
    mask = (1 << _SHIFT) - 1
    out = np.ones((len(grams), dimensions), np.int8)
    for place in range(3):
        points = (grams >> (_SHIFT * (2 - place))) & mask
        known, which = np.unique(points, return_inverse=True)
        if len(known):
            letters = np.stack([letter_vector(int(p), dimensions, seed) for p in known])
            out *= np.roll(letters, 2 - place, axis=1)[which]
    return out


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, count) of all texts, ordered by text."""
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    known = np.flatnonzero(seen)
    lowered = [(chr(p).lower() if chr(p).isalpha() else "\0") for p in known.tolist()]
    # A letter whose lower case has several code points stands for the first of them.
    letters, small = np.unique(np.array([ord(x[0]) for x in lowered], np.int64), return_inverse=True)
    number = np.zeros(0x110000, np.int32)
    blank = int(np.searchsorted(letters, 0)) if len(letters) and letters[0] == 0 else -1
    number[known] = small
    codes = number[points]
    inside = codes != blank
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)  # places of the line feeds after the texts
    place = np.flatnonzero(kept)
    codes, inside = codes[kept].astype(np.int64), inside[kept]
    if not len(codes):
        return (np.zeros(0, np.int64),) * 3
    before = np.concatenate([[max(blank, 0)], codes[:-1]])
    after = np.concatenate([codes[1:], [max(blank, 0)]])
    size = len(letters)
    middle = np.flatnonzero(inside)
    text = np.searchsorted(ends, place[middle])
    keys = ((text * size + before[middle]) * size + codes[middle]) * size + after[middle]
    keys.sort()
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    keys = keys[starts]
    a, b, c = keys // size // size % size, keys // size % size, keys % size
    grams = (letters[a] << (2 * _SHIFT)) | (letters[b] << _SHIFT) | letters[c]
    return keys // size**3, grams, counts


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _gram_counts(rows: DataFrame) -> DataFrame:
    """Number of each n-gram in the texts of each language."""

    def merged(parts: list[tuple]) -> list[tuple]:
        langs, grams, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((grams, langs))
        langs, grams, counts = langs[order], grams[order], counts[order]
        change = np.ones(len(langs), bool)
        change[1:] = (langs[1:] != langs[:-1]) | (grams[1:] != grams[:-1])
        starts = np.flatnonzero(change)
        return [(langs[starts], grams[starts], np.add.reduceat(counts, starts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        parts: list[tuple] = []
        for batch in batches:
            for piece in row_slices(batch, 0, SLICE_BYTES):
                text, grams, counts = grams_of(_texts(piece.column(0)))
                lang = np.array(
                    [names.setdefault(x, len(names)) for x in piece.column(1).to_pylist()], np.int64
                )
                if len(text):
                    parts = merged([*parts, (lang[text], grams, counts)])
        if parts:
            labels = np.array(list(names), object)
            lang, grams, counts = parts[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels[lang], pa.string()), pa.array(grams), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    return (
        rows.select("text", "lang")
        .mapInArrow(run, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def train(
    labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED
) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their prototypes as rows of unit length.

    Reads text and lang; rows without either are left out.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs.tolist()):
                own = langs == lang
                grams, n = batch.column(1).to_numpy()[own], batch.column(2).to_numpy()[own]
                total = totals.setdefault(lang, np.zeros(dimensions, np.int64))
                for at in range(0, len(grams), 4096):
                    vectors = gram_vectors(grams[at : at + 4096], dimensions, seed)
                    total += n[at : at + 4096] @ vectors.astype(np.int64)
        for lang, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions)), pa.array(total)],
                names=["lang", "place", "value"],
            )

    counts = _gram_counts(labelled.filter("text is not null and lang is not null"))
    sums = (
        counts.mapInArrow(bundle, "lang string, place long, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
        .toArrow()
    )
    langs = sorted(set(sums.column("lang").to_pylist()))
    out = np.zeros((len(langs), dimensions))
    which = {lang: i for i, lang in enumerate(langs)}
    rows = np.array([which[x] for x in sums.column("lang").to_pylist()], np.int64)
    out[rows, sums.column("place").to_numpy()] = sums.column("value").to_numpy()
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, out / np.where(norms == 0, 1, norms)


def compare(
    texts: list[str], prototypes: np.ndarray, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest prototype of each text (-1: no letter) and the cosine."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    text, grams, counts = grams_of(texts)
    if not len(text) or not len(prototypes):
        return best, score
    dimensions = prototypes.shape[1]
    known, which = np.unique(grams, return_inverse=True)
    vectors = gram_vectors(known, dimensions, seed).astype(np.float32)
    edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    weights = counts.astype(np.float32)
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        bundle = (weights[a:b] @ vectors[which[a:b]]).astype(np.float64)
        cosines = prototypes @ bundle / (np.linalg.norm(bundle) or 1.0)
        k = int(np.argmax(cosines))
        best[text[a]], score[text[a]] = k, min(1.0, max(0.0, float(cosines[k])))
    return best, score


def identify(
    docs: DataFrame, langs: list[str], prototypes: np.ndarray, seed: int = SEED
) -> DataFrame:
    """``docs`` with lang_pred and score (cosine, 0 to 1) as new columns; only the text is read.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was
    learned. Ties go to the first language in order. Columns of these names are replaced; all
    others, and repeated rows, are kept.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = names.index("text")
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*langs, UNDETERMINED], object)
        for batch in batches:
            for piece in row_slices(batch, place, SLICE_BYTES):
                best, score = compare(_texts(piece.column(place)), prototypes, seed)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(labels[best], pa.string()), pa.array(score)],
                    names=schema.names,
                )

    return docs.select(*names).mapInArrow(run, schema)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def identify_held_out(docs: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the documents of the other folds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    langs, prototypes = train(rows.filter(remainder("doc_id", folds) != 0))
    return identify(rows.select("doc_id", "text"), langs, prototypes).select(
        "doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score"
    )


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents that resemble a language learned from all labelled ones, columns unchanged.

    Texts without a letter go, null texts with them. If no text has both a letter and a language,
    nothing is learned, and all texts with a letter stay. Repeated rows are judged alike; an empty
    table stays empty.
    """
    langs, prototypes = train(docs)
    plain, restored = apart(docs, ("text",))
    if not langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = identify(plain, langs, prototypes, SEED).filter(
        (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)
    )
    return restored(kept)
