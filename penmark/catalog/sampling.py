"""Balancing, sampling and the cleaning recipes."""

from __future__ import annotations

from penmark.catalog.fixtures import CORPUS, corpus, sql_hash, sql_words
from penmark.catalog.registry import query, register
from penmark.catalog.text import SPLIT_ROWS, sql_padded, sql_truncated
from penmark.operators import sampling
from penmark.plans.recipes import BALANCES, TRANSFORMS, clean_and_balance, clean_recipe

COLUMNS = ["doc_id", "split", "generated_by"]


def sql_downsample(source: str, ids: str = "doc_id", within: str = "split") -> str:
    """Rows of ``source`` up to the size of the smallest class, in hash order."""
    order = f"{sql_hash(*ids.split(', '))}, {ids}"
    return f"""SELECT * EXCLUDE (r, n, smallest) FROM (
      SELECT *, min(n) OVER (PARTITION BY {within}) AS smallest FROM (
        SELECT *, row_number() OVER (PARTITION BY {within}, generated_by ORDER BY {order}) AS r,
               count(*) OVER (PARTITION BY {within}, generated_by) AS n
        FROM {source} WHERE generated_by IS NOT NULL)) WHERE r <= smallest"""


def sql_upsample(source: str, ids: str = "doc_id", within: str = "split") -> str:
    """As many hashed draws from every class of ``source`` as its largest class has rows."""
    order = f"{sql_hash(*ids.split(', '))}, {ids}"
    return f"""SELECT * EXCLUDE (rn, slot) FROM (
      SELECT s.*, slot,
             row_number() OVER (PARTITION BY s.split, s.generated_by, s.rn ORDER BY slot) - 1 AS draw_no
      FROM (SELECT *, row_number() OVER (PARTITION BY {within}, generated_by ORDER BY {order}) - 1 AS rn
            FROM {source} WHERE generated_by IS NOT NULL) s
      JOIN (SELECT split, generated_by, slot, {sql_hash("split", "generated_by", "slot")} % n AS rn
            FROM (SELECT *, unnest(range(0, most)) AS slot FROM (
                    SELECT *, max(n) OVER (PARTITION BY {within}) AS most FROM (
                      SELECT split, generated_by, count(*) AS n FROM {source}
                      WHERE generated_by IS NOT NULL GROUP BY split, generated_by)))) d
      USING (split, generated_by, rn))"""


@query("downsample", f"WITH {CORPUS} SELECT doc_id, split, generated_by FROM ({sql_downsample('corpus')})")
def downsample(spark, sf):
    return sampling.downsample(corpus(spark, sf), within=["split"]).select(*COLUMNS)


@query(
    "upsample",
    f"WITH {CORPUS} SELECT doc_id, split, generated_by, text, draw_no FROM ({sql_upsample('corpus')})",
)
def upsample(spark, sf):
    drawn = sampling.upsample(corpus(spark, sf), within=["split"])
    return drawn.select(*COLUMNS, "text", "draw_no")


def sql_ranked(partition: str) -> str:
    return f"row_number() OVER ({partition} ORDER BY {sql_hash('doc_id')}, doc_id)"


@query(
    "sample_per_class",
    f"""WITH {CORPUS} SELECT doc_id, generated_by, text FROM corpus
        QUALIFY {sql_ranked("PARTITION BY generated_by")} <= 120""",
)
def sample_per_class(spark, sf):
    return sampling.sample_per_class(corpus(spark, sf), 120).select(
        "doc_id", "generated_by", "text"
    )


@query(
    "head_per_class",
    f"""WITH {CORPUS} SELECT doc_id, generated_by, text FROM corpus
        QUALIFY row_number() OVER (PARTITION BY generated_by ORDER BY doc_id) <= 120""",
)
def head_per_class(spark, sf):
    return sampling.head_per_class(corpus(spark, sf), 120).select(
        "doc_id", "generated_by", "text"
    )


@query(
    "sample_rows",
    f"WITH {CORPUS} SELECT doc_id, text FROM corpus QUALIFY {sql_ranked('')} <= 50",
)
def sample_rows(spark, sf):
    return sampling.sample_rows(corpus(spark, sf), 50).select("doc_id", "text")


@query(
    "stratified_split",
    f"""WITH {CORPUS} SELECT doc_id, generated_by,
          CASE WHEN r <= floor(round(n * 0.7, 6)) THEN 'train'
               WHEN r <= floor(round(n * 0.85, 6)) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT doc_id, generated_by, {sql_ranked("PARTITION BY generated_by")} AS r,
                     count(*) OVER (PARTITION BY generated_by) AS n FROM corpus)""",
)
def stratified_split(spark, sf):
    return sampling.stratified_split(corpus(spark, sf)).select("doc_id", "generated_by", "split")


@query(
    "grouped_split",
    f"""WITH {CORPUS}, texts AS (
          SELECT sha256(text) AS g, count(*) AS n, arg_min(generated_by, doc_id) AS class
          FROM corpus WHERE generated_by IS NOT NULL GROUP BY text),
        starts AS (
          SELECT g, sum(n) OVER (PARTITION BY class ORDER BY {sql_hash("g")}, g) - n AS start,
            sum(n) OVER (PARTITION BY class) AS size FROM texts)
        SELECT doc_id, generated_by, CASE WHEN start < floor(round(size * 0.7, 6)) THEN 'train'
            WHEN start < floor(round(size * 0.85, 6)) THEN 'val' ELSE 'test' END AS split
        FROM corpus JOIN starts ON g = sha256(text)""",
)
def grouped_split(spark, sf):
    return sampling.grouped_split(corpus(spark, sf)).select("doc_id", "generated_by", "split")


@query(
    "clean_and_balance",
    f"""WITH {CORPUS} SELECT doc_id, split, generated_by, {sql_truncated(300)} AS text
        FROM ({sql_downsample("corpus")})""",
)
def truncated_and_balanced(spark, sf):
    return clean_and_balance(corpus(spark, sf)).select(*COLUMNS, "text")


TRANSFORMED = {
    "truncate": f"changed AS (SELECT * REPLACE ({sql_truncated(500)} AS text) FROM corpus)",
    "pad_n_truncate": f"changed AS (SELECT * REPLACE ({sql_padded(500)} AS text) FROM corpus)",
    "remove_outliers": f"""counted AS (SELECT *, len({sql_words()}) AS wc FROM corpus),
        q AS (SELECT split, quantile_cont(wc, 0.25) AS q1, quantile_cont(wc, 0.75) AS q3
              FROM counted GROUP BY split),
        changed AS (SELECT counted.* EXCLUDE (wc) FROM counted JOIN q USING (split)
                    WHERE wc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
    "split": f"{SPLIT_ROWS}, changed AS (SELECT * FROM chunks)",
}


def recipe_sql(transform: str, balance: str) -> str:
    ids = "doc_id, chunk_no" if transform == "split" else "doc_id"
    balanced = sql_downsample if balance == "downsample" else sql_upsample
    columns = f"{ids}, split, generated_by, text" + (", draw_no" if balance == "upsample" else "")
    return f"""WITH {CORPUS}, {TRANSFORMED[transform]},
      deduped AS (SELECT * FROM changed
                  QUALIFY row_number() OVER (PARTITION BY split, text ORDER BY {ids}) = 1)
      SELECT {columns} FROM ({balanced("deduped", ids)})"""


def _recipe(transform: str, balance: str):
    def run(spark, sf):
        return clean_recipe(corpus(spark, sf), transform, balance).drop("source")

    return run


for _transform in TRANSFORMS:
    for _balance in BALANCES:
        register(
            f"recipe_{_transform}_{_balance}",
            _recipe(_transform, _balance),
            recipe_sql(_transform, _balance),
        )


@query(
    "recipe_with_noise_steps",
    f"""WITH {CORPUS}, cleaned AS (
          SELECT * REPLACE (lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}_\\x09-\\x0d\\x1c-\\x20]', '', 'g')) AS text)
          FROM corpus),
        changed AS (SELECT * REPLACE ({sql_truncated(500)} AS text) FROM cleaned),
        deduped AS (SELECT * FROM changed
                    QUALIFY row_number() OVER (PARTITION BY split, text ORDER BY doc_id) = 1)
        SELECT doc_id, split, generated_by, text FROM ({sql_downsample("deduped")})""",
)
def recipe_with_noise_steps(spark, sf):
    cleaned = clean_recipe(
        corpus(spark, sf), "truncate", "downsample", noise=["punctuation", "lowercase"]
    )
    return cleaned.drop("source")
