"""Punctuation density and the fifteen stylometric measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import NGram, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penmark.constants import (
    BLANK_CLASS,
    DENSITY_PUNCTUATION,
    EPSILON,
    HEDGE_WORDS,
    STYLE_FEATURES,
    STYLE_PUNCTUATION,
    STYLE_STOPWORDS,
)
from penmark.functions.tokens import alpha_tokens, upper_word_count
from penmark.functions.words import sentence_lengths

SLICE_BYTES = 8 << 20  # of joined words that a worker looks at at a time

# A line that opens with a bullet; only a newline ends a line.
BULLET = rf"(?md)^[{BLANK_CLASS}]*[-•*][{BLANK_CLASS}]"


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    if len(chars) == 1:
        return (F.length(text) - F.length(F.replace(text, F.lit(chars), F.lit("")))).cast("bigint")
    listed = "".join(f"\\{c}" if c.isascii() else c for c in chars)
    return F.regexp_count(text, F.lit(f"[{listed}]")).cast("bigint")


def punctuation_density(text: Column) -> Column:
    """Share of characters that are punctuation; 0.0 for an empty text."""
    share = F.try_divide(count_chars(text, DENSITY_PUNCTUATION).cast("double"), F.length(text))
    return F.when(text.isNotNull(), F.coalesce(share, F.lit(0.0)))


def _without(df: DataFrame, column: str, listed: list[str], out: str) -> DataFrame:
    """Append the words of an array that are not listed."""
    remover = StopWordsRemover(inputCol=column, outputCol=out, stopWords=listed, caseSensitive=True)
    return remover.transform(df)


def syllables(column: str) -> Column:
    """(syllables, complex): syllables of the words of a row, and its words of three or more.

    The column holds words of a-z joined by single spaces. Vowel groups count as syllables; a word
    without one counts as one syllable.
    """
    limit = SLICE_BYTES
    kind = T.StructType().add("syllables", "long").add("complex", "long")

    @F.arrow_udf(kind)
    def count(joined: pa.Array) -> pa.Array:
        vowel = np.zeros(256, bool)
        vowel[list(b"aeiouy")] = True
        texts = joined.cast(pa.large_string())
        bounds = np.zeros(1, np.int64)
        if len(texts):
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        found, begin = [np.zeros((2, 0), np.int64)], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, "right")) - 1)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[begin] : bounds[end]]
            rows = bounds[begin : end + 1] - bounds[begin]
            first = np.zeros(len(data) + 1, bool)  # nothing before the first character of a row belongs to it
            first[rows] = True
            before = lambda x: np.concatenate([[False], x[:-1]])[: len(x)] & ~first[:-1]
            letter, sound = data != 0x20, vowel[data]
            words = np.flatnonzero(letter & ~before(letter))
            counts = np.zeros((2, end - begin), np.int64)
            if len(words):
                groups = np.add.reduceat((sound & ~before(sound)).astype(np.int32), words)
                row = np.searchsorted(rows, words, "right") - 1
                counts[0] = np.bincount(row, np.maximum(groups, 1), end - begin)
                counts[1] = np.bincount(row, groups >= 3, end - begin)
            found.append(counts)
            begin = end
        both = np.concatenate(found, axis=1)
        return pa.StructArray.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["syllables", "complex"])

    return count(column)


def stylometric_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the fifteen measures of ``STYLE_FEATURES`` as doubles.

    Tokens, sentence lengths and integer counts are projected in stages, each used several
    times by the next one, so that the optimiser keeps them as shared columns. Pairs of words and
    words outside a list come from ML transformers, which work on a row's array in compiled code.
    """
    text = F.col(text_col)
    original = df.columns
    staged = df.withColumns(
        {
            "_words": alpha_tokens(F.coalesce(text, F.lit(""))),
            "_sents": sentence_lengths(text),
        }
    )
    staged = NGram(n=2, inputCol="_words", outputCol="_runs").transform(staged)
    staged = _without(staged, "_words", STYLE_STOPWORDS, "_content")
    staged = _without(staged, "_words", HEDGE_WORDS, "_plain")
    staged = (
        staged.withColumns(
            {
                "_joined": F.array_join("_words", " "),
                "_n": F.size("_words"),
                "_s": F.size("_sents"),
            }
        )
        .withColumns(
            {
                "_letters": F.length("_joined") - F.greatest(F.col("_n") - 1, F.lit(0)),
                "_types": F.size(F.array_distinct("_words")),
                "_pairs": F.size(F.array_distinct("_runs")),
                "_stops": F.col("_n") - F.size("_content"),
                "_hedges": F.col("_n") - F.size("_plain"),
                "_sw": F.aggregate("_sents", F.lit(0).cast("bigint"), lambda t, x: t + x),
                "_sw2": F.aggregate("_sents", F.lit(0).cast("bigint"), lambda t, x: t + x * x),
            }
        )
    )
    # Only counts and the joined words go past the Python worker; the arrays end here.
    staged = staged.drop("_words", "_sents", "_runs", "_content", "_plain").withColumn("_voiced", syllables("_joined"))
    staged = staged.withColumns({"_syllables": F.col("_voiced")["syllables"], "_complex": F.col("_voiced")["complex"]})
    n, s = F.col("_n"), F.col("_s")
    sw, sw2 = F.col("_sw"), F.col("_sw2")
    per_word = lambda count: count / (n + EPSILON)
    per_sentence = lambda count: count / (s + EPSILON)
    or_zero = lambda ratio: F.coalesce(ratio, F.lit(0.0))
    words_per_sentence = F.try_divide(n.cast("double"), s)
    features = {
        "avg_word_len": or_zero(F.try_divide(F.col("_letters").cast("double"), n)),
        "type_token_ratio": per_word(F.col("_types")),
        "avg_sent_len": or_zero(F.try_divide(sw.cast("double"), s)),
        "punct_rate": count_chars(text, STYLE_PUNCTUATION) / (F.length(text) + EPSILON),
        "flesch": or_zero(
            206.835
            - 1.015 * words_per_sentence
            - 84.6 * F.try_divide(F.col("_syllables").cast("double"), n)
        ),
        "stopword_ratio": per_word(F.col("_stops")),
        "sent_len_std": or_zero(F.try_divide(F.sqrt((s * sw2 - sw * sw).cast("double")), s)),
        "bullet_rate": per_sentence(F.regexp_count(text, F.lit(BULLET))),
        "question_rate": per_sentence(count_chars(text, "?")),
        "paren_rate": per_word(count_chars(text, "(")),
        "upper_ratio": per_word(upper_word_count(text)),
        "bigram_diversity": F.col("_pairs") / (F.greatest(n - 1, F.lit(0)) + EPSILON),
        "syllable_score": per_word(F.col("_syllables")),
        "fog": or_zero(
            0.4 * (words_per_sentence + F.try_divide(100.0 * F.col("_complex"), n))
        ),
        "hedge_ratio": per_word(F.col("_hedges")),
    }
    known = text.isNotNull()
    return staged.select(
        *original,
        *[F.when(known, features[name]).cast("double").alias(name) for name in STYLE_FEATURES],
    )
