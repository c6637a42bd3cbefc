"""Word-character tokens, n-grams and per-text term counts, all inside one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"

EMPTY_INTS = "array<int>"


def alpha_tokens(text: Column) -> Column:
    """Lower-cased words made only of ASCII letters, bounded by non-word characters."""
    pattern = rf"(?<![{WORD}])[a-z]++(?![{WORD}])"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def upper_word_count(text: Column) -> Column:
    """Words of two or more ASCII capitals."""
    # Places without two capitals are passed over before it is looked back.
    pattern = rf"(?=[A-Z]{{2}})(?<![{WORD}])[A-Z]{{2,}}+(?![{WORD}])"
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def vectoriser_tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased tokens of two or more word characters, without stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0))
    if stop_words:
        tokens = F.filter(tokens, lambda token: ~token.isin(*stop_words))
    return tokens


def positions(n: Column) -> Column:
    """0 .. n-1 as an array; empty when ``n`` is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(EMPTY_INTS))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, each joined by one space."""
    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        return F.transform(
            positions(F.size(tokens) - (n - 1)),
            lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]),
        )

    return F.concat(*[runs(n) for n in range(low, high + 1)])
