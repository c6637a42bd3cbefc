"""Whitespace words: counting, truncating, padding, chunking and cleaning.

A word is what ``str.split()`` yields: every Unicode blank separates. The blanks are first
translated to plain spaces, so that the split itself needs only the cheap pattern `` +``;
a negated class of all blanks costs about six times as much in the JVM regex engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from penmark.constants import (
    BLANK_CLASS,
    MAX_WORDS,
    PAD_WORD,
    TAG_PATTERN,
    URL_PATTERN,
    WHITESPACE,
)


def plain_blanks(text: Column) -> Column:
    """Every whitespace character becomes one space."""
    return F.translate(text, WHITESPACE, " " * len(WHITESPACE))


def words(text: Column) -> Column:
    """Words of a text as an array; empty for a blank text, null for a null one."""
    return F.array_remove(F.split(plain_blanks(text), " +"), "")


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words; the split stops after them."""
    parts = F.split(F.ltrim(plain_blanks(text)), " +", n + 1)
    return F.array_remove(F.slice(parts, 1, n), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def truncate_words(text: Column, n: int = MAX_WORDS) -> Column:
    return F.array_join(first_words(text, n), " ")


def pad_or_truncate_words(text: Column, n: int = MAX_WORDS, pad: str = PAD_WORD) -> Column:
    """Exactly ``n`` words, filled up on the right with ``pad``."""
    filled = F.concat(first_words(text, n), F.array_repeat(F.lit(pad), n))
    return F.array_join(F.slice(filled, 1, n), " ")


def word_chunks(words_col: Column, n: int = MAX_WORDS) -> Column:
    """Cut an array of words into texts of ``n`` words; a blank text has no chunk."""
    starts = F.when(
        F.size(words_col) > 0, F.sequence(F.lit(1), F.size(words_col), F.lit(n))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda start: F.array_join(F.slice(words_col, start, n), " "))


def clean_noise(text: Column) -> Column:
    """Remove tags, then web addresses, then collapse blanks and trim."""
    no_tags = F.regexp_replace(plain_blanks(text), TAG_PATTERN, "")
    no_urls = F.regexp_replace(no_tags, URL_PATTERN, "")
    return F.trim(F.regexp_replace(no_urls, " +", " "))


def lowercase_text(text: Column) -> Column:
    return F.lower(text)


def remove_punctuation(text: Column) -> Column:
    """Delete everything but letters, numbers, underscores and blanks."""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{BLANK_CLASS}]+", "")


def prefix_text(text: Column, prefix: str = "passage: ") -> Column:
    return F.concat(F.lit(prefix), text)


def sentence_lengths(text: Column) -> Column:
    """Words of each non-blank sentence, sentences ending at runs of ``.``, ``!`` or ``?``.

    Every word becomes one letter, so the length of a piece between ends is its number of words.
    """
    marked = F.translate(text, "!?" + WHITESPACE, ".." + " " * len(WHITESPACE))
    letters = F.translate(F.regexp_replace(marked, "[^ .]+", "w"), " ", "")
    lengths = F.transform(F.split(letters, r"\.+"), F.length)
    return F.filter(lengths, lambda n: n > 0)


def sentence_count(text: Column) -> Column:
    """Non-blank sentences, counted without looking into them."""
    dense = F.translate(text, "!?" + WHITESPACE, "..")
    return F.size(F.array_remove(F.split(dense, r"\.+"), "")).cast("bigint")


def sentence_word_count(text: Column) -> Column:
    """Words over all sentences; a sentence end separates words as a blank does."""
    blanks = WHITESPACE + ".!?"
    spaced = F.translate(text, blanks, " " * len(blanks))
    return F.size(F.array_remove(F.split(spaced, " +"), "")).cast("bigint")


def avg_words_per_sentence(text: Column) -> Column:
    """Mean words per sentence, 0.0 when there is none, null for a null text."""
    ratio = F.try_divide(sentence_word_count(text).cast("double"), sentence_count(text))
    return F.when(text.isNotNull(), F.coalesce(ratio, F.lit(0.0)))
