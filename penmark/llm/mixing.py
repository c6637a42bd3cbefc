"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source plays its documents in a shuffled order, pass after pass. A copy finishes at the
virtual time (words of its source up to and with it) / (target of the source); all copies are
range-sorted by that time, and the mix takes them until the total budget is spent. So at every
moment the sources have got words in proportion to their targets.

Running sums come from a range sort: sums inside each range, plus the sum of the ranges before it
(one row for each range). So a source may hold any share of the rows; no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.llm.columns import apart
from penmark.session import materialise

SHARE = 1.5
WEIGHTS = (3, 1, 2)
PASSES = 2
SEED = 42

# Fixed value: words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each new name, the sum of a column over all rows before, in the given order.

    The order must tell all rows apart. A name written with a leading minus sorts nulls last.
    """
    keys = [F.col(o[1:]).asc_nulls_last() if o[0] == "-" else F.col(o).asc() for o in order]
    placed = materialise(
        df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    totals = placed.groupBy("_range").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    # One row for each range, as many as the shuffle has partitions.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.sum(f"_{k}").over(earlier).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (
        placed.withColumns({k: F.coalesce(F.sum(v).over(inside), zero) for k, v in sums.items()})
        .join(F.broadcast(starts), "_range")
        .withColumns({k: F.col(k) + F.coalesce(f"_{k}", zero) for k in sums})
        .drop("_range", *(f"_{k}" for k in sums))
    )


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    share: float = SHARE,
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
) -> DataFrame:
    """source, source_size, before (words of earlier sources) and target, from (source, size).

    Sources in the order of their code points, null last, take the weights in turn. Each gets its
    share by weight; a target stops at ``passes`` times the size of its source, and the excess goes
    to the others. In the order of (limit / weight), a source is at its limit if and only if the
    level that would remain for it and all later ones reaches that limit.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = running(
        sources.withColumn("one", F.lit(1)), ["-source"], {"number": "one", "before": "source_size"}
    ).drop("one")
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int")
    )
    limit = F.col("source_size") * F.lit(float(passes))
    rows = materialise(
        numbered.withColumn("weight", weight)
        .withColumn("limit", limit)
        .withColumn("ratio", limit / weight),
        "sources",
    )
    words, weight_sum = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (words or 0)
    level = (F.lit(budget) - F.col("limits")) / (F.lit(float(weight_sum or 0)) - F.col("lighter"))
    ranked = running(rows, ["ratio", "-source"], {"limits": "limit", "lighter": "weight"})
    marked = materialise(ranked.withColumn("full", F.col("ratio") <= level), "targets")
    spent, rest = marked.agg(
        F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)),
        F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("weight"))),
    ).first()
    per_weight = (budget - spent) / rest if rest else 0.0
    return marked.select(
        "source",
        "source_size",
        "before",
        F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * per_weight).alias("target"),
    )


def mix(
    docs: DataFrame,
    share: float = SHARE,
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
    seed: int = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every row.

    ``taken`` counts all passes; the copy at which the budget ends is taken in part. ``keep`` names
    columns of ``docs`` to carry along. A null text has size 0 and is never taken; documents with a
    null source form a source of their own; repeated rows are documents of their own; an empty
    table gives no rows.
    """
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            *keep,
        )
        # The shuffle of each pass is a keyed hash of the document; equal rows are told apart by
        # where they lie in the table, which the written table fixes.
        .withColumn("turn", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))))
        .withColumn("row", F.monotonically_increasing_id()),
        "documents",
    )
    targets = materialise(source_targets(rows, share, weights, passes), "targets")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    budget = int(budget + 1e-6)
    before = running(rows, ["-source", "turn", "doc_id", "row"], {"words": "size"})
    joined = before.withColumnRenamed("source", "_source").join(
        targets, F.col("_source").eqNullSafe(F.col("source"))
    )
    copies = joined.select(
        "row",
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        "turn",
        *keep,
        F.explode(F.array(*(F.lit(p) for p in range(passes)))).alias("pass"),
        (F.col("words") - F.col("before")).alias("earlier"),
    ).withColumn(
        "finish",
        F.coalesce(
            F.try_divide(
                (F.col("pass") * F.col("source_size") + F.col("earlier") + F.col("size")).cast("double"),
                F.col("target"),
            ),
            F.lit(0.0),
        ),
    )
    queue = running(copies, ["finish", "-source", "pass", "turn", "doc_id", "row"], {"spent": "size"})
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("spent")))
    return (
        queue.groupBy("row")
        .agg(
            *(F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", *keep)),
            F.sum(taken).cast("long").alias("taken"),
        )
        .drop("row")
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each pass that takes any of their words."""
    docs, restored = apart(docs, ("doc_id", "text", "source"))
    numbered = materialise(docs.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, keep=["_place"], **parameters).filter("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    chosen = taken.select("_place", F.explode(F.sequence(F.lit(1), times)).alias("_time"))
    return restored(numbered.join(chosen, "_place"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))) AS turn
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, CAST([3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM s
), r AS (
  SELECT *, 2.0 * source_size AS lim, CAST(2.0 * source_size AS DOUBLE) / weight AS ratio FROM n
), c AS (
  SELECT *,
    coalesce(sum(lim) OVER w, 0) AS limits, coalesce(sum(weight) OVER w, 0) AS lighter,
    1.5 * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weights
  FROM r
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, ratio <= (budget - limits) / (weights - lighter) AS is_full FROM c
), t AS (
  SELECT source, source_size, CAST(CASE WHEN is_full THEN lim ELSE weight *
      (budget - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ()) /
      sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS DOUBLE) AS target
  FROM f
), e AS (
  SELECT d.*, t.source_size, t.target, p.p,
    (p.p * t.source_size + sum(size) OVER (PARTITION BY d.source, p.p ORDER BY turn, doc_id)) / t.target AS finish
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) p(p)
), q AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, p, turn, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM e
)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size,
  round(any_value(target), 6) AS target,
  CAST(sum(greatest(0, least(size, (SELECT CAST(floor(sum(target) + 1e-6) AS BIGINT) FROM t) - spent))) AS BIGINT) AS taken
FROM q GROUP BY doc_id
"""
