"""What each filter of a chain removes, for every order of the filters.

Each document becomes a mask: bit i is set if it fails filter i. Documents with equal mask count in
one cell per part of the corpus, so all that follows works on at most 2^filters cells a part. A
recursive query extends every prefix of filters by each unused letter, joins the cells of its part
and carries the bits applied so far; the rows of a level are the metrics of that step. A whole order
then has, at step i, the row of its prefix of i letters.

Defined results. A null text counts as empty, a null language as the part ''. Filter E compares
texts by SHA-256; a repeated row is not a smaller id, so rows of the least id all pass, and a null
id is never larger than another. A document is good (toxic) if any row of ``labels`` with its id
says so. Empty documents give no part and no row. Other columns are ignored. Building the result
writes one narrow table (ids, hashes and masks, no texts) to the shared folder at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.session import materialise

LETTERS = "ABCDE"
LEAST_WORDS = 200

# Blanks between words, capital letters, characters of filter D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOL = r"[#$%&*|]"


def text_failures(text: Column) -> list[Column]:
    """Failure conditions of filters A to D on a text that is not null."""
    words = F.split(F.btrim(text, F.lit(BLANKS)), BLANK_RUN)  # [''] without a word: fails A alone
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [
        F.size(words) < LEAST_WORDS,
        F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(50),
        capitals * F.lit(100) > F.length(text) * F.lit(3),
        text.rlike(SYMBOL),
    ]


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row; bit i of the mask is the failure of filter LETTERS[i]."""
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(text_failures(text))]
    keys = materialise(
        docs.select(
            "doc_id",
            F.coalesce("lang", F.lit("")).alias("part"),
            sum(bits[1:], bits[0]).alias("mask"),
            F.unhex(F.sha2(text, 256)).alias("hash"),
        ),
        "masks",
    )
    # Copies collapse before the shuffle, and the first of each text is told by (hash, id), so a
    # text that fills a third of all rows meets in no task.
    first = keys.filter("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id"))
    repeated = F.when(F.col("first").isNull(), F.lit(1 << LETTERS.index("E"))).otherwise(0)
    with_id = (
        keys.filter("doc_id is not null")
        .join(first.withColumn("first", F.lit(True)), ["hash", "doc_id"], "left")
        .select("doc_id", "part", F.col("mask").bitwiseOR(repeated).alias("mask"))
    )
    return with_id.union(keys.filter("doc_id is null").select("doc_id", "part", "mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): one row a part; a cell is (mask, n, good, toxic)."""
    marks = (
        labels.filter("doc_id is not null and (quality = 1 or toxic = 1)")
        .groupBy("doc_id")
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    marked = (
        masks.filter("doc_id is not null")
        .join(marks, "doc_id", "left")
        .select("part", "mask", "good", "toxic")
        .union(
            masks.filter("doc_id is null").select(
                "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")
            )
        )
    )
    return (
        marked.groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.coalesce("good", F.lit(False))).alias("good"),
            F.count_if(F.coalesce("toxic", F.lit(False))).alias("toxic"),
        )
        .groupBy("part")
        .agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))
    )


def _total(condition: str, value: str) -> str:
    return f"aggregate(c.cells, 0L, (t, x) -> t + if({condition}, x.{value}, 0L))"


# Metrics of one step. s.applied has the bits of earlier steps, l.bit the bit of this one; a cell x
# is removed here if it fails this filter and none before.
METRICS = {
    "kept": _total("x.mask & (s.applied | l.bit) = 0", "n"),
    "removed": _total("x.mask & l.bit <> 0 and x.mask & s.applied = 0", "n"),
    "redundant": _total("x.mask & l.bit <> 0 and x.mask & s.applied <> 0", "n"),
    "unique_fails": _total("x.mask = l.bit", "n"),
    "good_lost": _total("x.mask & l.bit <> 0 and x.mask & s.applied = 0", "good"),
    "toxic_lost": _total("x.mask & l.bit <> 0 and x.mask & s.applied = 0", "toxic"),
}


def prefix_steps(cells: DataFrame, letters: Sequence[str]) -> DataFrame:
    """(part, prefix, step, letter, metrics): the last step of every prefix of distinct letters.

    One row a part and prefix, 325 prefixes for five letters; no row limit applies.
    """
    filters = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    sql = f"""
        WITH RECURSIVE steps(part, prefix, letter, applied, step, {", ".join(METRICS)}) AS (
            SELECT part, '', '', 0, 0, {", ".join("0L" for _ in METRICS)} FROM {{cells}}
            UNION ALL
            SELECT s.part, concat(s.prefix, l.letter), l.letter, s.applied | l.bit, s.step + 1,
                {", ".join(METRICS.values())}
            FROM steps s JOIN {{cells}} c ON s.part = c.part
            LATERAL VIEW inline(filter(array({filters}), f -> f.bit & s.applied = 0)) l AS letter, bit
        )
        SELECT part, prefix, letter, step, {", ".join(METRICS)} FROM steps WHERE step > 0 LIMIT ALL
    """
    return cells.sparkSession.sql(sql, cells=cells)


def audit_orders(cells: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """One row per part, order of all letters and step, with that step's metrics and ``shapley``:
    what the filter of the step removes, summed over all orders."""
    steps = materialise(prefix_steps(materialise(cells, "cells"), letters), "steps")
    full = steps.filter(F.col("step") == len(letters)).select("part", F.col("prefix").alias("filter_order"))
    placed = full.select(
        "part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step")
    ).withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    rows = placed.join(steps.drop("step"), ["part", "prefix"])
    shares = rows.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "letter", *METRICS, "shapley"
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters on ``docs`` (doc_id, text, lang), in all orders."""
    return audit_orders(mask_cells(failure_masks(docs), labels))


SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
marks AS (
    SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic
    FROM labels GROUP BY doc_id
), cells AS (
    SELECT part,
        CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS INT)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(doc_id > first_id, false) AS INT) AS mask,
        count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM texts JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)
    GROUP BY ALL
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, applied, steps) AS (
    SELECT '', 0, CAST([] AS STRUCT(letter VARCHAR, bit INT, before INT)[])
    UNION ALL
    SELECT filter_order || letter, applied | bit,
        list_append(steps, {'letter': letter, 'bit': bit, 'before': applied})
    FROM orders, letters WHERE applied & bit = 0
), placed AS (
    SELECT filter_order, step, steps[step].letter AS letter, steps[step].bit AS bit,
        steps[step].before AS before
    FROM orders, range(1, 6) AS numbers(step) WHERE applied = 31
), counted AS (
    SELECT part, filter_order, CAST(step AS INT) AS step, letter,
        CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
        CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS removed,
        CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS BIGINT) AS redundant,
        CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
        CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS good_lost,
        CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS BIGINT) AS toxic_lost
    FROM cells, placed GROUP BY part, filter_order, step, letter
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted
"""
