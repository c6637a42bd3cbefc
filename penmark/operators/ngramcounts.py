"""Counts of known n-grams as a stage of a pipeline, without making the n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens that a worker looks up at a time.
SLICE_TOKENS = 1 << 19


def _tree(terms: Sequence[str]) -> tuple[dict[str, int], list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Words, the edges of each further token, and the term at each node (-1: none).

    The first nodes are the words themselves; an edge from a node by a word has the key
    ``node * len(words) + word``, and the keys of a level are sorted, with the nodes they lead to.
    """
    grams = [term.split(" ") for term in terms]
    words = {word: i for i, word in enumerate(sorted({word for gram in grams for word in gram}))}
    levels: list[dict[int, int]] = [{} for _ in range(max(map(len, grams), default=1) - 1)]
    term_at = [-1] * len(words)
    for number, gram in enumerate(grams):
        node = words[gram[0]]
        for level, word in zip(levels, gram[1:], strict=False):
            key = node * len(words) + words[word]
            if key not in level:
                level[key] = len(term_at)
                term_at.append(-1)
            node = level[key]
        term_at[node] = number
    edges = []
    for level in levels:
        keys = np.fromiter(level.keys(), np.int64, len(level))
        order = np.argsort(keys)
        edges.append((keys[order], np.fromiter(level.values(), np.int64, len(level))[order]))
    return words, edges, np.array(term_at, np.int64)


class NgramCounter(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """How often each term of ``vocabulary`` stands in an array of tokens, as a sparse vector.

    A term is one token or several joined by one space, found wherever its tokens follow each other.
    Each distinct token of a slice of texts is looked up once; longer terms are followed from token to
    token through sorted edges, so runs of tokens that begin no term cost nothing further. The counts
    are those of ``NGram`` and ``CountVectorizerModel``, exact. Null counts as no tokens.
    """

    vocabulary = Param(
        Params._dummy(), "vocabulary", "the terms, in the order of the vector", TypeConverters.toListString
    )

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, vocabulary=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        terms = self.getOrDefault(self.vocabulary)
        shared = dataset.sparkSession.sparkContext.broadcast(_tree(terms))
        size, limit = len(terms), SLICE_TOKENS
        kind = pa.struct(
            [
                pa.field("type", pa.int8(), False),
                pa.field("size", pa.int32()),
                pa.field("indices", pa.list_(pa.field("element", pa.int32(), False))),
                pa.field("values", pa.list_(pa.field("element", pa.float64(), False))),
            ]
        )

        def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
            start, total = 0, 0
            for i, n in enumerate(sizes.tolist()):
                if total and total + n > limit:
                    yield start, i
                    start, total = i, 0
                total += n
            yield start, len(sizes)

        def counted(lists: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            words, edges, term_at = shared.value
            coded = lists.flatten().dictionary_encode()
            known = np.fromiter((words.get(w, -1) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            word = known[coded.indices.to_numpy()] if len(known) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(word >= 0)
            node = word[at]
            found = [(doc[at] * size + term_at[node])[term_at[node] >= 0]]
            for step, (keys, nodes) in enumerate(edges, 1):
                inside = at + step < len(word)
                at, node = at[inside], node[inside]
                inside = (doc[at + step] == doc[at]) & (word[at + step] >= 0)
                at, node = at[inside], node[inside]
                key = node * len(words) + word[at + step]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                inside = keys[place] == key
                at, node = at[inside], nodes[place[inside]]
                found.append((doc[at] * size + term_at[node])[term_at[node] >= 0])
            pairs, times = np.unique(np.concatenate(found), return_counts=True)
            docs, indices = np.divmod(pairs, max(size, 1))
            return np.bincount(docs, minlength=len(sizes)), indices, times

        @F.arrow_udf(VectorUDT())
        def count(tokens: pa.Array) -> pa.Array:
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            parts = [counted(tokens.slice(a, b - a), sizes[a:b]) for a, b in slices(sizes)]
            filled, indices, times = (np.concatenate(x) for x in zip(*parts, strict=True))
            offsets = pa.array(np.concatenate([[0], np.cumsum(filled)]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(x), type=kind.field(name).type)
                for name, x in (("indices", indices.astype(np.int32)), ("values", times.astype(np.float64)))
            ]
            numbers = [pa.array(np.zeros(len(sizes), np.int8)), pa.array(np.full(len(sizes), size, np.int32))]
            return pa.StructArray.from_arrays([*numbers, *lists], fields=list(kind))

        return dataset.withColumn(self.getOutputCol(), count(self.getInputCol()))
