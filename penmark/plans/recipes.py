"""The published cleaning recipes: transform, deduplicate, balance, each split on its own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penmark.constants import BALANCED_MAX_WORDS, MAX_WORDS, PAD_WORD, SEED
from penmark.functions import words as w
from penmark.operators.cleaning import first_copies, remove_outliers_iqr, split_words
from penmark.operators.sampling import count_up, downsample, drawn_copies
from penmark.session import materialise

TRANSFORMS = ("truncate", "pad_n_truncate", "remove_outliers", "split")
BALANCES = ("downsample", "upsample")
NOISE_STEPS: dict[str, Callable] = {
    "clean_noise": w.clean_noise,
    "lowercase": w.lowercase_text,
    "punctuation": w.remove_punctuation,
}


def clean_text(df: DataFrame, steps: Sequence[str], text_col: str = "text") -> DataFrame:
    """The optional noise steps, in the given order."""
    for step in steps:
        df = df.withColumn(text_col, NOISE_STEPS[step](F.col(text_col)))
    return df


def transform_texts(
    df: DataFrame,
    transform: str,
    ids: Sequence[str],
    max_words: int = MAX_WORDS,
    within: Sequence[str] = ("split",),
    text_col: str = "text",
) -> tuple[DataFrame, list[str]]:
    """The transformed texts and the columns that identify a row afterwards."""
    text = F.col(text_col)
    if transform == "truncate":
        return df.withColumn(text_col, w.truncate_words(text, max_words)), [*ids]
    if transform == "pad_n_truncate":
        padded = w.pad_or_truncate_words(text, max_words, PAD_WORD)
        return df.withColumn(text_col, padded), [*ids]
    if transform == "remove_outliers":
        return remove_outliers_iqr(df, text_col, within), [*ids]
    if transform == "split":
        return split_words(df, max_words, text_col), [*ids, "chunk_no"]
    raise ValueError(f"unknown transform {transform!r}; known are {TRANSFORMS}")


def clean_recipe(
    df: DataFrame,
    transform: str,
    balance: str,
    noise: Sequence[str] = (),
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    within: Sequence[str] = ("split",),
    max_words: int = MAX_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One of the eight recipes.

    Which rows survive is decided on keys and classes alone. The keys that pass deduplication
    are written once to the shared folder, balancing reads only them, and the texts take part
    in a single join on the row identity at the end.
    """
    texts, row_ids = transform_texts(clean_text(df, noise), transform, ids, max_words, within)
    kept = materialise(
        first_copies(texts, row_ids, within=within, keep=[class_col]), "recipe-keys"
    )
    if balance == "downsample":
        chosen = downsample(kept, class_col, row_ids, within, seed)
        return texts.join(chosen.select(*row_ids), row_ids, "left_semi")
    if balance == "upsample":
        copies = drawn_copies(kept, class_col, row_ids, within, seed)
        drawn = count_up(texts.join(copies, row_ids), "_copies", "draw_no")
        return drawn.select(*texts.columns, "draw_no")
    raise ValueError(f"unknown balance {balance!r}; known are {BALANCES}")


def clean_and_balance(
    df: DataFrame,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    within: Sequence[str] = ("split",),
    max_words: int = BALANCED_MAX_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Truncate, then downsample, without deduplication: one filter over the texts."""
    balanced = downsample(df, class_col, ids, within, seed)
    return balanced.withColumn("text", w.truncate_words(F.col("text"), max_words))
