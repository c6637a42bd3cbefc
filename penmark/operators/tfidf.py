"""TF-IDF as a long table (document, term, weight).

N-grams are summed where the texts are, and weights are made inside each row, so neither the
vocabulary nor the weights need a shuffle per document and term. The vocabulary is bounded by
``max_features`` and is held as a local table, the parameters of the fitted model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import ElementwiseProduct, NGram, StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penmark.bounded import SMALL_TABLE_ROWS, fetch_table
from penmark.constants import ENGLISH_STOP_WORDS, TOP_TERMS
from penmark.functions.tokens import vectoriser_tokens
from penmark.operators.ngramcounts import NgramCounter
from penmark.session import TEXT_ROWS, materialise


@dataclass(frozen=True)
class TfidfConfig:
    max_features: int
    ngram_range: tuple[int, int] = (1, 1)
    min_df: int = 1
    stop_words: Sequence[str] = field(default_factory=tuple)
    sublinear_tf: bool = False


# The published configurations.
TRAIN_CONFIG = TfidfConfig(50_000, (1, 4))
TRIGRAM_CONFIG = TfidfConfig(50_000, (1, 3))
SMALL_TRIGRAM_CONFIG = TfidfConfig(5_000, (1, 3))
UNIGRAM_CONFIG = TfidfConfig(5_000, (1, 1))
PROFILE_CONFIG = TfidfConfig(
    20_000, (1, 2), min_df=5, stop_words=ENGLISH_STOP_WORDS, sublinear_tf=True
)


def with_ngrams(df: DataFrame, low: int, high: int, out: str = "_grams") -> DataFrame:
    """Append all runs of ``low`` to ``high`` neighbouring tokens of the column ``_tokens``."""
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append("_tokens")
            continue
        df = NGram(n=n, inputCol="_tokens", outputCol=f"_runs{n}").transform(df)
        parts.append(f"_runs{n}")
    return df.withColumn(out, F.concat(*parts)).drop(*[p for p in parts if p != "_tokens"])


def _term_stats(
    tokenised: DataFrame,
    config: TfidfConfig,
    lengths: tuple[int, int],
    shorter: DataFrame | None,
) -> DataFrame:
    """(term, tf, df) of the n-grams of some lengths that are in ``min_df`` documents or more.

    Occurrences count towards tf, the distinct n-grams of each text towards df; both are summed
    where the texts are, and only sums are shuffled. ``shorter`` holds the frequent terms of one
    token less; an n-gram can be frequent only if its first and its last n-1 tokens are, and any
    other is dropped before it is counted.
    """
    grams = with_ngrams(tokenised, *lengths).select("_grams")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # Outer generators: inner ones add a filter on the size, which makes all n-grams once more.
    counts = grams.select(F.explode_outer("_grams").alias("term"), one.alias("tf"), none.alias("df")).union(
        grams.select(F.explode_outer(F.array_distinct("_grams")), none, one)
    )
    counts = counts.filter(F.col("term").isNotNull())
    if shorter is not None:
        known = F.broadcast(shorter.select(F.col("term").alias("_part")))
        size = lengths[0] - 1
        for part in (F.substring_index("term", " ", size), F.substring_index("term", " ", -size)):
            counts = counts.join(known, part == F.col("_part"), "left_semi")
    return (
        counts.groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .filter(F.col("df") >= config.min_df)
    )


def _lowest_kept(stats: DataFrame, features: int):
    """The frequency of the ``features``-th most frequent term, from the histogram of frequencies.

    There are far fewer frequencies than terms: with N tokens at most about the root of 2N.
    """
    above = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.desc("tf"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        stats.groupBy("tf")
        .agg(F.count("df").alias("terms"))
        .withColumn("above", F.coalesce(F.sum("terms").over(above), F.lit(0)))
        .filter(F.col("above") < features)
        .agg(F.min("tf"))
        .scalar()
    )


def _fetch_terms(stats: DataFrame, features: int) -> tuple[pa.Table, bool]:
    """The most frequent terms, and whether all with the lowest of their frequencies are there.

    Ties at the lowest frequency come along if they are not too many; otherwise the first terms
    in the alphabet do.
    """
    tied = stats.filter(F.col("tf") >= _lowest_kept(stats, features))
    table = fetch_table(tied, max(2 * features, SMALL_TABLE_ROWS))
    if table is not None:
        return table, True
    return stats.orderBy(F.desc("tf"), "term").limit(features).toArrow(), False


def _tokenised(df: DataFrame, config: TfidfConfig, text_col: str) -> DataFrame:
    """The tokens of every text, written once, as fitting reads them several times."""
    return materialise(_with_tokens(df.select(text_col), config, text_col).select("_tokens"), "tokens", TEXT_ROWS)


def _with_tokens(df: DataFrame, config: TfidfConfig, text_col: str) -> DataFrame:
    """Append ``_tokens``; a null text has none."""
    tokens = vectoriser_tokens(F.coalesce(F.col(text_col), F.lit("")))
    if not config.stop_words:
        return df.withColumn("_tokens", tokens)
    remover = StopWordsRemover(
        inputCol="_all", outputCol="_tokens", stopWords=list(config.stop_words), caseSensitive=True
    )
    return remover.transform(df.withColumn("_all", tokens)).drop("_all")


# Tokens that a worker takes apart at a time; their n-grams take some fifty times as many bytes.
SLICE_TOKENS = 1 << 19


def _gram_stats(
    tokenised: DataFrame, lengths: tuple[int, int], known: np.ndarray | None, wanted: np.ndarray | None = None
) -> DataFrame:
    """(key, length, tf, df) of the n-grams of some lengths by 64-bit keys, summed per slice of texts.

    ``known`` holds the sorted keys of frequent n-grams of one token less than the shortest; others with
    a part that is not among them are left out. With ``wanted``, sorted keys, rows are (term, tf, df) of
    the n-grams that have these keys.
    """
    context = tokenised.sparkSession.sparkContext
    shared = context.broadcast((known, wanted))
    names = ["term", "tf", "df"] if wanted is not None else ["key", "length", "tf", "df"]
    limit = SLICE_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, wanted = shared.value

        def mixed(keys: np.ndarray) -> np.ndarray:
            keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            return keys ^ (keys >> np.uint64(29))

        def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
            if not len(some):
                return np.zeros(len(keys), bool)
            return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys

        def slices(lists: pa.Array) -> Iterator[pa.Array]:
            sizes = np.diff(lists.offsets.to_numpy())
            start, total = 0, 0
            for i, size in enumerate(sizes.tolist()):
                if total and total + size > limit:
                    yield lists.slice(start, i - start)
                    start, total = i, 0
                total += size
            yield lists.slice(start)

        def coded(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
            """Words of a slice and their hashes, and for each token its word and its text."""
            sizes = np.diff(lists.offsets.to_numpy())
            found = lists.flatten().dictionary_encode()
            words = found.dictionary.to_pylist()
            codes = found.indices.to_numpy()
            own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
            return words, own, codes, np.repeat(np.arange(len(sizes)), sizes)

        def words_counted(own: np.ndarray, codes: np.ndarray, doc: np.ndarray) -> list:
            texts = int(doc[-1]) + 1
            pairs = np.sort(codes.astype(np.int64) * texts + doc)
            new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
            tf, df = (np.bincount(x, minlength=len(own)) for x in (codes, pairs[new] // texts))
            return [own.view(np.int64), np.full(len(own), 1, np.int32), tf, df]

        def counted(words: list[str], own: np.ndarray, codes: np.ndarray, doc: np.ndarray, n: int) -> Iterator[list]:
            if n == 1 and wanted is None:
                if len(codes):
                    yield words_counted(own, codes, doc)
                return
            hashes = keys = own[codes]
            shorter = keys
            for k in range(1, n):
                shorter = keys
                keys = mixed(keys[: len(keys) - 1] + np.uint64(k)) + hashes[k:] if len(keys) > 1 else keys[:0]
            rows = np.flatnonzero(doc[: len(keys)] == doc[n - 1 :]) if len(keys) else np.zeros(0, np.int64)
            if known is not None and n == lengths[0]:
                rows = rows[among(shorter[rows], known)]
                rows = rows[among(shorter[rows + 1], known)]
            if wanted is not None:
                rows = rows[among(keys[rows], wanted)]
            if not len(rows):
                return
            keys = keys[rows]
            order = np.argsort(keys, kind="stable")  # rows of a text stay together
            keys, rows = keys[order], rows[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[rows[1:]] != doc[rows[:-1]])])
            tf = np.diff(np.append(first, len(keys)))
            df = np.add.reduceat(new.astype(np.int64), first)
            if wanted is None:
                yield [keys[first].view(np.int64), np.full(len(first), n, np.int32), tf, df]
                return
            # Different n-grams of one key are told apart.
            grams = np.stack([codes[rows + k] for k in range(n)], axis=1)
            if (grams != np.repeat(grams[first], tf, axis=0)).any():
                order = np.lexsort([rows, *grams.T[::-1]])
                grams, rows = grams[order], rows[order]
                other = np.concatenate([[True], (grams[1:] != grams[:-1]).any(axis=1)])
                first = np.flatnonzero(other)
                new = other | np.concatenate([[True], doc[rows[1:]] != doc[rows[:-1]]])
                tf = np.diff(np.append(first, len(rows)))
                df = np.add.reduceat(new.astype(np.int64), first)
            yield [[" ".join([words[c] for c in gram]) for gram in grams[first].tolist()], tf, df]

        for batch in batches:
            if not len(batch):
                continue
            for part in slices(batch.column(0)):
                tokens = coded(part)
                for n in range(lengths[0], lengths[1] + 1):
                    for columns in counted(*tokens, n):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    if wanted is not None:
        rows = tokenised.mapInArrow(run, "term string, tf long, df long").groupBy("term")
    else:
        rows = tokenised.mapInArrow(run, "key long, length int, tf long, df long").groupBy("key", "length")
    return rows.agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _vocabulary_by_keys(tokenised: DataFrame, config: TfidfConfig) -> pa.Table | None:
    """The vocabulary by 64-bit keys of n-grams, then by the n-grams of the keys that can be in it.

    A key counts at least what each of its n-grams does, so a rare key has rare n-grams. None if the
    lowest frequency has too many ties to be fetched, or if keys shared by several n-grams made the
    bound too high, so that another way must be taken.
    """
    low, high = config.ngram_range
    best, lowest, known = None, 1, None
    rounds = [(n, n) for n in range(low, high + 1)]
    while rounds:
        lengths = rounds.pop(0)
        stats = _gram_stats(tokenised, lengths, known)
        stats = stats.filter((F.col("df") >= config.min_df) & (F.col("tf") >= lowest))
        tied = stats.filter(F.col("tf") >= _lowest_kept(stats, config.max_features))
        level = fetch_table(tied, max(2 * config.max_features, SMALL_TABLE_ROWS))
        if level is None and best is None and lengths[0] == lengths[1] < high:
            rounds[0] = (low, low + 1)  # with the next length the lowest frequency is higher
            continue
        if level is None:
            return None
        best = level if best is None else pa.concat_tables([best, level])
        tf = np.sort(best.column("tf").to_numpy())[::-1]
        lowest = int(tf[config.max_features - 1]) if len(tf) >= config.max_features else 1
        found = (level.column("tf").to_numpy() >= lowest) & (level.column("length").to_numpy() == lengths[1])
        known = np.sort(level.column("key").to_numpy()[found].view(np.uint64))
    keys = best.column("key").to_numpy()[best.column("tf").to_numpy() >= lowest]
    wanted = np.unique(keys.view(np.uint64))
    stats = _gram_stats(tokenised, (low, high), None, wanted)
    terms = stats.filter((F.col("df") >= config.min_df) & (F.col("tf") >= lowest)).toArrow()
    if lowest > 1 and terms.num_rows < config.max_features:
        return None
    return terms.sort_by([("tf", "descending"), ("term", "ascending")]).slice(0, config.max_features)


def _vocabulary_table(tokenised: DataFrame, config: TfidfConfig) -> pa.Table:
    found = _vocabulary_by_keys(tokenised, config)
    return _vocabulary_by_terms(tokenised, config) if found is None else found


def _vocabulary_by_terms(tokenised: DataFrame, config: TfidfConfig) -> pa.Table:
    low, high = config.ngram_range
    order = [("tf", "descending"), ("term", "ascending")]
    rounds = [(low, min(low + 1, high)), *[(n, n) for n in range(low + 2, high + 1)]]
    best, lowest, shorter = None, 1, None
    for lengths in rounds:
        stats = _term_stats(tokenised, config, lengths, shorter)
        level, complete = _fetch_terms(stats.filter(F.col("tf") >= lowest), config.max_features)
        merged = level if best is None else pa.concat_tables([best, level])
        best = merged.sort_by(order).slice(0, config.max_features)
        full = best.num_rows == config.max_features
        lowest = best.column("tf")[-1].as_py() if full else 1
        shorter = None
        if complete and lengths != rounds[-1]:
            blanks = F.length("term") - F.length(F.replace("term", F.lit(" "), F.lit("")))
            shorter = tokenised.sparkSession.createDataFrame(level, schema=stats.schema).filter(
                (F.col("tf") >= lowest) & (blanks == lengths[1] - 1)
            )
    return best


def tfidf_vocabulary(
    df: DataFrame, config: TfidfConfig, text_col: str = "text"
) -> DataFrame:
    """(term, tf, df) of the ``max_features`` most frequent terms in ``min_df`` documents or more.

    Ties go to the alphabetically first term. The two shortest lengths are counted together and
    every further one on its own: the terms found so far give a lowest frequency that longer
    terms must reach, and the frequent terms of one length tell which of the next can reach it.
    Rare long n-grams, by far the most of all terms, are thus never shuffled. The result is exact.
    """
    table = _vocabulary_table(_tokenised(df, config, text_col), config)
    return df.sparkSession.createDataFrame(table)


@dataclass
class TfidfModel:
    """A fitted vocabulary: local table (term, term_id, df, idf) and the number of documents."""

    config: TfidfConfig
    vocabulary: DataFrame
    documents: int
    terms: pa.Table

    def transform(
        self,
        df: DataFrame,
        ids: Sequence[str] = ("doc_id",),
        text_col: str = "text",
        keep: Sequence[str] = (),
    ) -> DataFrame:
        """(ids, keep, term, term_id, tfidf), each document scaled to length one.

        Counts, weights and the norm are made inside the row, so nothing is shuffled or sorted.
        Terms follow by a broadcast of the vocabulary, which ``max_features`` bounds. A document
        without a known term has no row.
        """
        names = self.terms.column("term").to_pylist()
        if not names:
            return self.vocabulary.limit(0).join(df.select(*ids, *keep), F.lit(False)).select(
                *ids, *keep, "term", "term_id", F.lit(0.0).alias("tfidf")
            )
        tokens = _with_tokens(df.select(*dict.fromkeys([*ids, *keep, text_col])), self.config, text_col)
        counter = NgramCounter(inputCol="_tokens", outputCol="_n", vocabulary=names)
        weigher = ElementwiseProduct(
            scalingVec=Vectors.dense(self.terms.column("idf").to_pylist()),
            inputCol="_n",
            outputCol="_w",
        )
        vector = lambda c: F.unwrap_udt(F.col(c))
        weights = vector("_w")["values"]
        if self.config.sublinear_tf:
            weights = F.zip_with(
                vector("_n")["values"], weights, lambda n, x: x * (1.0 + F.log(n)) / n
            )
        norm = F.sqrt(F.aggregate("_weights", F.lit(0.0), lambda t, x: t + x * x))
        rows = (
            weigher.transform(counter.transform(tokens))
            .select(*ids, *keep, vector("_n")["indices"].alias("_ids"), weights.alias("_weights"))
            .withColumn("_norm", norm)
            .select(*ids, *keep, "_norm", F.inline_outer(F.arrays_zip("_ids", "_weights")))
            .filter(F.col("_ids").isNotNull())
        )
        names_of = self.vocabulary.select("term", "term_id")
        return rows.join(F.broadcast(names_of), F.col("_ids") == F.col("term_id")).select(
            *ids, *keep, "term", "term_id", (F.col("_weights") / F.col("_norm")).alias("tfidf")
        )


def tfidf_fit(df: DataFrame, config: TfidfConfig, text_col: str = "text") -> TfidfModel:
    """Fit vocabulary and smoothed idf; term ids are alphabetical positions."""
    tokenised = _tokenised(df, config, text_col)
    documents = tokenised.count()
    table = _vocabulary_table(tokenised, config).sort_by("term")
    frequency = table.column("df").to_numpy()
    idf = np.log((1.0 + documents) / (1.0 + frequency)) + 1.0
    columns = {
        "term": table.column("term"),
        "term_id": pa.array(np.arange(table.num_rows, dtype="int32")),
        "tf": table.column("tf"),
        "df": table.column("df"),
        "idf": pa.array(idf),
    }
    schema = "term string, term_id int, tf long, df long, idf double"
    terms = pa.table(columns)
    vocabulary = df.sparkSession.createDataFrame(terms, schema=schema)
    return TfidfModel(config, vocabulary, documents, terms)


def tfidf_fit_transform(
    df: DataFrame,
    config: TfidfConfig,
    ids: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    return tfidf_fit(df, config, text_col).transform(df, ids, text_col, keep)


def top_terms(
    df: DataFrame,
    config: TfidfConfig,
    k: int = TOP_TERMS,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """The ``k`` terms of every class with the highest mean weight over all its documents.

    Means that agree to twelve decimals count as equal and are ordered by term.
    """
    # Usually a sample, which would otherwise be drawn again for each of the passes below.
    df = materialise(df.select(*dict.fromkeys([*ids, class_col, text_col])), "profiled", TEXT_ROWS)
    sizes = df.groupBy(class_col).agg(F.count("*").alias("_docs"))
    weights = tfidf_fit_transform(df, config, ids, text_col, keep=[class_col])
    best = Window.partitionBy(class_col).orderBy(F.desc(F.round("mean_tfidf", 12)), "term")
    return (
        weights.groupBy(class_col, "term")
        .agg(F.sum("tfidf").alias("_sum"))
        .join(sizes, class_col)
        .select(class_col, "term", (F.col("_sum") / F.col("_docs")).alias("mean_tfidf"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )
