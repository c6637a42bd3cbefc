"""Row-wise cleaning and exact deduplication of arriving texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.constants import MAX_WORDS
from penmark.functions import words as w
from penmark.operators.cleaning import text_key
from penmark.operators.profile import with_lengths
from penmark.plans.recipes import clean_text


def clean_rows(
    texts: DataFrame, noise: Sequence[str] = (), max_words: int = MAX_WORDS
) -> DataFrame:
    """Noise steps and truncation of each arriving text; no state."""
    return clean_text(texts, noise).withColumn("text", w.truncate_words(F.col("text"), max_words))


def clean_stream(
    texts: DataFrame,
    ids: Sequence[str],
    noise: Sequence[str] = (),
    max_words: int = MAX_WORDS,
    within: Sequence[str] = (),
    salts: int = 16,
) -> DataFrame:
    """Clean, truncate, deduplicate and measure each arriving text.

    No text is dropped for being late: the state keeps 32 bytes for every different text of the
    stream, or for every different text and value of ``within`` (a day, a source), so put it into a
    state store on disk. Deduplication runs twice, first per text and salt, then per text: the copies
    of a very frequent text meet in ``salts`` tasks, each of which lets one through. The salt is a
    hash of ``ids``, the identity of the row, so a batch that is tried again deals rows alike. Class
    balancing and quartiles need a finished table and exist as batch operators only.
    """
    unique = (
        clean_rows(texts, noise, max_words).withColumn("_key", F.coalesce(text_key("text"), F.unhex(F.lit(""))))
        .withColumn("_salt", F.pmod(F.xxhash64(*ids), F.lit(salts)))
        .dropDuplicates(["_key", "_salt", *within])
        .dropDuplicates(["_key", *within])
        .drop("_key", "_salt")
    )
    return with_lengths(unique)
