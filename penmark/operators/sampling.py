"""Exact balanced sampling without a per-class sort.

Every row gets a place in a seeded random order from a hash of its identity. "The first n rows
of a class in that order" is decided by one threshold per class, found in two narrow steps:

1. count rows per (class, hash bucket) and locate the bucket that holds the n-th row;
2. rank only the rows of that bucket, 1/65536 of the class, to find the n-th row itself.

The rows are then kept by a filter against a broadcast table of thresholds. Texts are neither
shuffled nor sorted, and no task ever holds a class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penmark.bounded import attach
from penmark.constants import SEED
from penmark.functions.hashing import HASH_BITS, seeded_hash
from penmark.session import materialise

BUCKET_BITS = 16
NUMBER_BITS = 12
SLOT_BLOCK = 8192


def _bucket(bits: int) -> Column:
    return F.shiftright("_h", HASH_BITS - bits).cast("int")


def _keys(df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int) -> DataFrame:
    """Groups, identities and sampling hash: all that sampling needs to read."""
    return df.select(*by, *ids, seeded_hash(seed, ids).alias("_h"))


def bucket_sizes(keys: DataFrame, by: Sequence[str], bits: int = BUCKET_BITS) -> DataFrame:
    """Rows per group and hash bucket, with the number of rows in lower buckets of the group."""
    sizes = (
        keys.select(*by, _bucket(bits).alias("_b"))
        .groupBy(*by, "_b")
        .agg(F.count("*").alias("_n"))
    )
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0)))


def totals(sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group, summed from bucket sizes."""
    return sizes.groupBy(*by).agg(F.sum("_n").alias("_size"))


def extreme_size(sizes: DataFrame, within: Sequence[str], pick) -> DataFrame:
    """``sizes`` with the smallest or largest ``_size`` inside each ``within`` as ``_rank``."""
    if not within:
        return sizes.withColumn("_rank", sizes.agg(pick("_size")).scalar())
    extreme = sizes.groupBy(*within).agg(pick("_size").alias("_rank"))
    return sizes.join(extreme, list(within))


def rank_thresholds(
    keys: DataFrame,
    targets: Callable[[DataFrame], DataFrame],
    by: Sequence[str],
    ids: Sequence[str],
) -> DataFrame:
    """The row at each target rank: ``by``, ``_target``, and that row's place ``_at``.

    ``targets`` turns the group sizes (``by``, ``_size``) into one row per group and target with
    the 1-based ``_rank`` wanted, which must not exceed the size of the group.
    """
    sizes = bucket_sizes(keys, by)
    cuts = (
        sizes.join(targets(totals(sizes, by)), list(by))
        .filter(F.col("_rank").between(F.col("_before") + 1, F.col("_before") + F.col("_n")))
        .select(*by, "_b", "_target", (F.col("_rank") - F.col("_before")).alias("_rest"))
    )
    edge = attach(keys.withColumn("_b", _bucket(BUCKET_BITS)), cuts, [*by, "_b"])
    order = Window.partitionBy(*by, "_target").orderBy("_h", *ids)
    return (
        edge.withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == F.col("_rest"))
        .select(*by, "_target", F.struct("_h", *ids).alias("_at"))
    )


def _place(ids: Sequence[str]) -> Column:
    return F.struct("_h", *ids)


def _keep_first(
    df: DataFrame,
    rank: Callable[[DataFrame], DataFrame],
    by: Sequence[str],
    ids: Sequence[str],
    seed: int,
) -> DataFrame:
    """Keep the rows of every group up to its ``_rank`` in the seeded order."""
    thresholds = rank_thresholds(
        _keys(df, by, ids, seed),
        lambda sizes: rank(sizes).select(*by, "_rank", F.lit(0).alias("_target")),
        by,
        ids,
    ).drop("_target")
    placed = attach(df.withColumn("_h", seeded_hash(seed, ids)), thresholds, by)
    return placed.filter(_place(ids) <= F.col("_at")).select(*df.columns)


def downsample(
    df: DataFrame,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    within: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """Cut every class to the size of the smallest one; rows without a class are dropped.

    With ``within`` the smallest class is taken inside each of those groups, e.g. per split.
    """
    df = df.filter(F.col(class_col).isNotNull())
    return _keep_first(
        df, lambda sizes: extreme_size(sizes, within, F.min), [*within, class_col], ids, seed
    )


def _at_most(k: int) -> Callable[[DataFrame], DataFrame]:
    return lambda sizes: sizes.withColumn("_rank", F.least("_size", F.lit(k).cast("bigint")))


def sample_per_class(
    df: DataFrame,
    k: int,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    within: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """``k`` random rows of every class, all rows of a class that has fewer."""
    df = df.filter(F.col(class_col).isNotNull())
    return _keep_first(df, _at_most(k), [*within, class_col], ids, seed)


def sample_rows(
    df: DataFrame, n: int, ids: Sequence[str] = ("doc_id",), seed: int = SEED
) -> DataFrame:
    """``n`` random rows, or all if there are fewer."""
    whole = df.withColumn("_all", F.lit(0))
    return _keep_first(whole, _at_most(n), ["_all"], ids, seed).drop("_all")


def head_per_class(
    df: DataFrame,
    k: int,
    class_col: str = "generated_by",
    order: Sequence[str] = ("doc_id",),
    salts: int = 256,
) -> DataFrame:
    """The first ``k`` rows of every class in load order.

    The literal bound lets every task, and then every salt, cut its part of a class to ``k``
    keys, so the last step ranks at most ``salts * k`` keys per class.
    """
    keys = (
        df.filter(F.col(class_col).isNotNull())
        .select(class_col, *order)
        .withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    )
    for partition in ([class_col, "_salt"], [class_col]):
        window = Window.partitionBy(*partition).orderBy(*order)
        keys = (
            keys.withColumn("_r", F.row_number().over(window))
            .filter(F.col("_r") <= k)
            .drop("_r")
        )
    return attach(df, keys.select(*order), order, "left_semi")


def stratified_split(
    df: DataFrame,
    train: float = 0.70,
    val: float = 0.15,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    seed: int = SEED,
    split_col: str = "split",
) -> DataFrame:
    """Label rows train / val / test so that every class is divided in the same shares.

    Of a class of n rows the first ``floor(train*n)`` in the seeded order are for training and
    the rows up to ``floor((train+val)*n)`` for validation.
    """
    by = [class_col]
    df = df.filter(F.col(class_col).isNotNull())
    ends = F.array(
        F.floor(F.round(F.col("_size") * train, 6)),
        F.floor(F.round(F.col("_size") * (train + val), 6)),
    )
    thresholds = (
        rank_thresholds(
            _keys(df, by, ids, seed),
            lambda sizes: sizes.select(
                class_col, F.posexplode(ends).alias("_target", "_rank")
            ).filter(F.col("_rank") > 0),
            by,
            ids,
        )
        .groupBy(class_col)
        .agg(
            F.min(F.when(F.col("_target") == 0, F.col("_at"))).alias("_train_end"),
            F.min(F.when(F.col("_target") == 1, F.col("_at"))).alias("_val_end"),
        )
    )
    placed = attach(df.withColumn("_h", seeded_hash(seed, ids)), thresholds, by, "left")
    part = (
        F.when(_place(ids) <= F.col("_train_end"), "train")
        .when(_place(ids) <= F.col("_val_end"), "val")
        .otherwise("test")
    )
    return placed.select(*[c for c in df.columns if c != split_col], part.alias(split_col))


# A group with more than this share of all rows meets the rows in a broadcast; there are at most
# 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001


def grouped_split(
    df: DataFrame,
    group: Column | None = None,
    train: float = 0.70,
    val: float = 0.15,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    seed: int = SEED,
    split_col: str = "split",
) -> DataFrame:
    """Label rows train / val / test so that all rows of a group are in one split.

    ``group`` is a string, by default a hash of the text, so that no text is in two splits; the
    component of a near-duplicate search keeps linked texts together. The class of a group is that
    of its first row by ``ids``. Inside a class, groups follow each other in the seeded order; those
    that start before ``floor(train*n)`` rows are for training, those before
    ``floor((train+val)*n)`` for validation. So the rows of a split differ from its share by less than the
    largest group. Rows without a class are left out, a null group counts as one of its own.

    Groups are summed before the shuffle and placed in hash buckets, so neither a class nor a group
    is in one task. The rows are joined once. Groups are written once.
    """
    group = F.sha2("text", 256) if group is None else group
    df = df.filter(F.col(class_col).isNotNull())
    keyed = df.withColumn("_group", F.coalesce(group, F.lit("")))
    groups = materialise(
        keyed.groupBy("_group")
        .agg(F.count("*").alias("_n"), F.min(F.struct(*ids, class_col))[class_col].alias("_class"))
        .withColumn("_h", seeded_hash(seed, ["_group"])),
        "groups",
    )
    placed = groups.withColumn("_b", _bucket(NUMBER_BITS))
    below = Window.partitionBy("_class").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_class", "_b").agg(F.sum("_n").alias("_rows"))
    offsets = sizes.select(
        "_class",
        "_b",
        F.coalesce(F.sum("_rows").over(below), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy("_class")).alias("_size"),
    )
    inside = Window.partitionBy("_class", "_b").orderBy("_h", "_group").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    end = lambda share: F.floor(F.round(F.col("_size") * share, 6))
    part = F.when(start < end(train), "train").when(start < end(train + val), "val").otherwise("test")
    assigned = materialise(
        placed.join(offsets, ["_class", "_b"]).select("_group", "_n", part.alias("_part")), "group-splits"
    )
    total = assigned.agg(F.sum("_n")).first()[0] or 0
    heavy = F.col("_n") > HEAVY_SHARE * total
    # Rows of a heavy group get a key that no group has, and is different for each row.
    found = keyed.join(
        F.broadcast(assigned.filter(heavy).select("_group", F.col("_part").alias("_heavy"))), "_group", "left"
    ).withColumn("_group", F.when(F.col("_heavy").isNull(), F.col("_group")).otherwise(F.concat(F.lit("/"), F.md5(F.concat_ws("|", *ids)))))
    return found.join(assigned.filter(~heavy).select("_group", "_part"), "_group", "left").select(
        *[c for c in df.columns if c != split_col], F.coalesce("_heavy", "_part").alias(split_col)
    )


def number_rows(
    df: DataFrame, by: Sequence[str], ids: Sequence[str], seed: int = SEED
) -> DataFrame:
    """Number the rows of every group from 0 in the seeded order: ``by``, ``ids``, ``_rn``.

    Rows are numbered inside hash buckets and shifted by the number of rows in lower buckets,
    so a large group spreads over many tasks.
    """
    keys = _keys(df, by, ids, seed).withColumn("_b", _bucket(NUMBER_BITS))
    offsets = bucket_sizes(keys, by, NUMBER_BITS).select(*by, "_b", "_before")
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *ids)
    return (
        keys.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*by, "_b"])
        .select(*by, *ids, (F.col("_before") + F.col("_r") - 1).alias("_rn"))
    )


def count_up(df: DataFrame, count_col: str, out: str) -> DataFrame:
    """Repeat each row ``count_col`` times, numbered from 0 in ``out``.

    A row that is repeated very often is first dealt, in blocks of numbers, over all tasks; other
    rows are repeated where they are.
    """
    often = F.col(count_col) > SLOT_BLOCK
    return _numbered(df.filter(~often), count_col, out, deal=False).unionByName(
        _numbered(df.filter(often), count_col, out, deal=True)
    )


def _numbered(df: DataFrame, count_col: str, out: str, deal: bool) -> DataFrame:
    others = [c for c in df.columns if c != count_col]
    n = F.col(count_col).cast("bigint")
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / SLOT_BLOCK))
    start = F.col("_block") * SLOT_BLOCK
    end = F.least(start + SLOT_BLOCK, F.col(count_col).cast("bigint")) - 1
    placed = df.filter(n > 0).select(*others, count_col, F.explode(blocks).alias("_block"))
    if deal:
        # A fixed number, as these few short rows would otherwise be put together again.
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = placed.repartition(tasks, F.xxhash64(*others, "_block"))
    return placed.select(*others, F.explode(F.sequence(start, end)).alias(out))


def upsample(
    df: DataFrame,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    within: Sequence[str] = (),
    seed: int = SEED,
    draw_col: str = "draw_no",
) -> DataFrame:
    """Draw from every class, with replacement, as many rows as the largest class has.

    Adds ``draw_no``, the running number of a row's copies. Draws are counted per row before
    they meet the texts, so each text is shuffled once however often it is drawn.
    """
    picked = drawn_copies(df, class_col, ids, within, seed)
    return count_up(df.join(picked, list(ids)), "_copies", draw_col)


def drawn_copies(
    df: DataFrame,
    class_col: str = "generated_by",
    ids: Sequence[str] = ("doc_id",),
    within: Sequence[str] = (),
    seed: int = SEED,
) -> DataFrame:
    """(ids, _copies): how often ``upsample`` draws each row; rows never drawn are left out."""
    by = [*within, class_col]
    df = df.filter(F.col(class_col).isNotNull())
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size"))
    sizes = extreme_size(sizes, within, F.max).withColumnRenamed("_rank", "_max")
    blocks = (
        sizes.select(
            *by,
            "_size",
            "_max",
            F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_max") - 1) / SLOT_BLOCK))
            ).alias("_block"),
        )
        # Spread the generation of slots over the cluster; the rows are few and narrow.
        .repartition(*by, "_block")
    )
    start = F.col("_block") * SLOT_BLOCK
    slots = blocks.select(
        *by,
        "_size",
        F.explode(
            F.sequence(start, F.least(start + SLOT_BLOCK, F.col("_max")) - 1)
        ).alias("_slot"),
    )
    drawn = (
        slots.select(*by, (seeded_hash(seed, [*by, "_slot"]) % F.col("_size")).alias("_rn"))
        .groupBy(*by, "_rn")
        .agg(F.count("*").alias("_copies"))
    )
    return number_rows(df, by, ids, seed).join(drawn, [*by, "_rn"]).select(*ids, "_copies")
