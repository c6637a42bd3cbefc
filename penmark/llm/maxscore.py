"""Exact top-k inner products by MaxScore over sharded impact postings.

A vector is a document whose terms are its places; the posting of a term holds the documents with a
component that is not zero, and its impacts. Documents are dealt into shards by id, queries go to
every shard. In a shard, the terms of a query are ordered by the most that they can add to a score.
The threshold starts as the k-th score of documents with extreme impacts in the first terms. Terms
whose bounds sum to less than it are non-essential: a document that has no other term cannot
compete. The postings of essential terms are traversed; the documents that still compete are probed
for the others, one term after the other, and leave as soon as their score and the bounds left fall
below the threshold. Equal scores stay, so that ties go to the smaller id. The shards' results of a
query are merged by a window that limits them before the shuffle.

Impacts may be negative: the bound of a term is then the larger product at its two extremes, and 0
if some document lacks the term.

Defined results. Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id. Of rows with one id the largest vector stands (by first, then later components);
repeated rows count once, and a query is never its own candidate. Vectors may differ in length, and
what is missing counts 0; so an empty vector scores 0 with all. Components beyond 64 bits and scores
beyond them stay at the nearest long. Fewer candidates than k all return; no query, no row.
Building the result writes the vectors once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.arrowtext import gather_runs
from penmark.session import materialise

TOP = 20
SCALE = 64.0
QUERY_STEP = 20
# Documents of a shard, about; its postings take some 12 bytes a component.
SHARD = 16_384
# Documents with extreme impacts that a term offers for the first threshold, and terms that offer.
HEAD = 16
LEADERS = 6

_LONG = np.iinfo(np.int64)


class Shard:
    """Postings of documents in ascending order of their ids."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, values: np.ndarray):
        self.ids, self.bounds, self.values = ids, bounds, values
        lengths = np.diff(bounds)
        self.places = np.arange(len(values)) - np.repeat(bounds[:-1], lengths)
        owners = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        held = np.flatnonzero(values)
        held = held[np.argsort(self.places[held], kind="stable")]
        self.n_terms = int(lengths.max(initial=0))
        cuts = np.searchsorted(self.places[held], np.arange(self.n_terms + 1))
        narrow = np.int32 if np.abs(values.astype(float)).max(initial=0) < 2.0**31 else np.int64
        self.postings: list[tuple[np.ndarray | None, np.ndarray]] = []
        self.low, self.high = np.zeros(self.n_terms, np.int64), np.zeros(self.n_terms, np.int64)
        self.heads: list[np.ndarray] = []
        for term in range(self.n_terms):
            part = held[cuts[term] : cuts[term + 1]]
            docs, impacts = owners[part], values[part]
            if len(impacts):
                self.low[term], self.high[term] = impacts.min(), impacts.max()
            if len(docs) < len(ids):  # documents without the term add 0
                self.low[term], self.high[term] = min(self.low[term], 0), max(self.high[term], 0)
            order = np.argsort(impacts, kind="stable")
            self.heads.append(docs[np.r_[order[:HEAD], order[HEAD:][-HEAD:]]])
            impacts = impacts.astype(narrow)
            if 2 * len(docs) >= len(ids):  # a long posting has a place for every document
                docs, column = None, np.zeros(len(ids), narrow)
                column[owners[part]] = impacts
                impacts = column
            self.postings.append((docs, impacts))

    def _whole_scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of some documents from their own components."""
        starts, lengths = self.bounds[docs], self.bounds[docs + 1] - self.bounds[docs]
        places, values = (gather_runs(x, starts, lengths) for x in (self.places, self.values))
        inside = places < len(weights)
        sums = np.zeros(len(places) + 1, weights.dtype)
        sums[1:][inside] = weights[places[inside]] * values[inside].astype(weights.dtype)
        sums, ends = np.cumsum(sums), np.cumsum(lengths)
        return sums[ends] - sums[ends - lengths]

    def _impacts_of(self, term: int, docs: np.ndarray) -> np.ndarray:
        held, impacts = self.postings[term]
        if held is None:
            return impacts[docs]
        at = np.minimum(np.searchsorted(held, docs), max(len(held) - 1, 0))
        return np.where(held[at] == docs, impacts[at], 0) if len(held) else np.zeros(len(docs), np.int64)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents, best first, without the query's own."""
        reach = min(len(query), self.n_terms)
        terms = np.flatnonzero(query[:reach])
        most = np.abs(query[terms].astype(float)) * np.maximum(
            np.abs(self.low[terms].astype(float)), np.abs(self.high[terms].astype(float))
        )
        # The narrowest integers that no sum leaves; beyond 64 bits, integers without bound.
        total = most.sum()
        kind = np.int32 if total < 2.0**29 else np.int64 if total < 2.0**61 else object
        query = query.astype(kind)
        weights = query[terms]
        bound = np.maximum(weights * self.high[terms].astype(kind), weights * self.low[terms].astype(kind))
        order = np.argsort(-bound, kind="stable")
        terms, weights, bound = terms[order], weights[order], bound[order]
        # rest[i]: the most that terms i and later can add.
        rest = np.append(np.cumsum(bound[::-1], dtype=kind)[::-1], 0)
        floor = self._first_floor(own, terms, query, k)
        # Scores beyond 64 bits count as the nearest long, and tie there.
        floor = None if floor is None or floor <= _LONG.min else min(floor, _LONG.max)
        if floor is None:
            floor, essential = -int(2 * most.sum()) - 1, len(terms)
        else:
            below = np.flatnonzero(rest[:-1] < floor)
            essential = int(below[0]) if len(below) else len(terms)
        scores = np.zeros(len(self.ids), kind)
        for i in range(essential):
            held, impacts = self.postings[terms[i]]
            if held is None:
                scores += weights[i] * impacts.astype(kind, copy=False)
            else:
                scores[held] += weights[i] * impacts.astype(kind, copy=False)
        docs = np.flatnonzero(scores + rest[essential] >= floor)
        scores = scores[docs]
        for i in range(essential, len(terms)):
            scores = scores + weights[i] * self._impacts_of(terms[i], docs).astype(kind, copy=False)
            stay = scores + rest[i + 1] >= floor
            docs, scores = docs[stay], scores[stay]
        other = self.ids[docs] != own
        docs = docs[other]
        scores = np.clip(scores[other], _LONG.min, _LONG.max).astype(np.int64)
        # The complement turns the order round and, unlike the negative, has a value for every long;
        # documents are in the order of their ids.
        best = np.argsort(~scores, kind="stable")[:k]
        return self.ids[docs[best]], scores[best]

    def _first_floor(self, own: int, terms: np.ndarray, query: np.ndarray, k: int):
        """The k-th score among the heads of the first terms, None if they are fewer."""
        if not len(terms):
            return None
        docs = np.unique(np.concatenate([self.heads[t] for t in terms[:LEADERS]]))
        docs = docs[self.ids[docs] != own]
        if len(docs) < k:
            return None
        return np.sort(self._whole_scores(docs, query))[-k]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return bounds, column.flatten().to_numpy(zero_copy_only=False)


def _search(k: int):
    """Rows (shard, kind, id, vector) in order of shard, kind 0 (documents) before 1 (queries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, index = None, [], None
        for batch in batches:
            shards, kinds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if start == end:
                    continue
                if shards[start] != at:
                    at, parts, index = shards[start], [], None
                ids = batch.column(2).slice(start, end - start).to_numpy(zero_copy_only=False)
                bounds, values = _lists(batch.column(3).slice(start, end - start))
                if kinds[start] == 0:
                    parts.append((ids, np.diff(bounds), values))
                    continue
                if index is None and parts:
                    ids_of, lengths, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
                    index, parts = Shard(ids_of, np.concatenate([[0], np.cumsum(lengths)]), flat), []
                if index is None:  # no document is in this shard
                    continue
                found = [index.top(q, values[bounds[i] : bounds[i + 1]], k) for i, q in enumerate(ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, [len(x) for x, _ in found])),
                        pa.array(np.concatenate([x for x, _ in found])),
                        pa.array(np.concatenate([x for _, x in found])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) for vectors (vec_id, vector array<long>) without nulls; a row
    for which ``is_query`` holds is a query, every row is a candidate."""
    spark = vectors.sparkSession
    vectors = materialise(vectors.groupBy("vec_id").agg(F.max("vector").alias("vector")), "vectors")
    shards = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // SHARD))
    documents = vectors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
        F.lit(0).alias("kind"),
        "vec_id",
        "vector",
    )
    queries = vectors.filter(is_query).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(1).alias("kind"),
        "vec_id",
        "vector",
    )
    found = (
        documents.union(queries)
        .repartitionById(shards, "shard")
        .sortWithinPartitions("shard", "kind", "vec_id")
        .mapInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector): floor(64 x) of every component of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("vector"),
    )


def search_embeddings(embeddings: DataFrame, k: int = TOP) -> DataFrame:
    """Top k of all rows for those whose vec_id is divisible by QUERY_STEP."""
    return top_inner_products(quantised(embeddings), F.col("vec_id") % QUERY_STEP == 0, k)


SQL = """
WITH vectors AS (
    SELECT vec_id, max(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(
        range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id, score
FROM scored
QUALIFY rank <= 20
"""
