"""SimHash fingerprints of documents and search within a Hamming radius, in DataFrame operations.

Terms are the shingles of five words of the whole text (of all words if there are fewer); a term
weighs as often as it occurs. Each term votes with the 64 bits of its hash, and a bit of the
fingerprint is set if most of the weight is for it. Votes are summed two bits to a long, 32 bits
apart, so that one hash aggregate with 32 sums does it before the shuffle.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penmark.llm.mixing import running
from penmark.session import materialise

SHINGLE_WORDS = 5
RADIUS = 3

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def votes(rows: DataFrame, text: str, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """``fp`` of the texts of ``rows``, which ``by`` tells apart; ``carry`` names longs to keep."""
    blanks = " \t\n\u000b\f\r"
    words = F.split(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(blanks)), r"[\x20\x09-\x0D]+", -1)
    # An empty text has one empty word, which makes the only term of all texts without words.
    terms = (
        rows.select(*by, *carry, words.alias("_w"))
        .select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - SHINGLE_WORDS, F.lit(0)))).alias("_i"))
        .select(*by, *carry, F.xxhash64(*(F.get("_w", F.col("_i") + k) for k in range(SHINGLE_WORDS))).alias("_h"))
    )
    sums = [
        F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(_LANES))).alias(f"_s{k}") for k in range(32)
    ]
    counted = terms.groupBy(*by).agg(
        *sums, F.count("*").alias("_n"), *(F.max(c).alias(c) for c in carry)
    )

    def bit(k: int) -> Column:
        lane = F.col(f"_s{k % 32}")
        lane = lane.bitwiseAND(F.lit(_LOW)) if k < 32 else F.shiftrightunsigned(lane, 32)
        return F.when(lane * 2 > F.col("_n"), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0))

    halves = []
    for part in (range(32), range(32, 64)):
        value = F.lit(0).cast("long")
        for k in part:
            value = value.bitwiseOR(bit(k).cast("long"))
        halves.append(value)
    return counted.select(*by, *carry, halves[0].bitwiseOR(halves[1]).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the weighted terms as the differing bits estimate it, not below 0."""
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(math.pi / 64)))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_fingerprints(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All (fp, other, distance) with fp of ``queries``, other of ``prints``, at most radius apart.

    Both sides are made distinct first, so copies cost nothing. The bits are cut into radius + 2
    blocks; two fingerprints within the radius agree in at least two, and a table for each pair of
    blocks, with those bits as its leading key, finds them. A pair is returned by the first table
    that has it.
    """
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    block = lambda fp, k: F.shiftrightunsigned(fp, edges[k]).bitwiseAND(
        F.lit((1 << (edges[k + 1] - edges[k])) - 1)
    )
    pairs = list(combinations(range(radius + 2), 2))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        fp = F.col(name)
        keys = [
            F.struct(F.lit(i).alias("table"), block(fp, a).alias("x"), block(fp, b).alias("y"))
            for i, (a, b) in enumerate(pairs)
        ]
        return df.select(F.col("fp").alias(name)).distinct().select(name, F.inline(F.array(*keys)))

    first = F.lit(None).cast("int")
    for i, (a, b) in reversed(list(enumerate(pairs))):
        same = (block(F.col("fp"), a) == block(F.col("other"), a)) & (
            block(F.col("fp"), b) == block(F.col("other"), b)
        )
        first = F.when(same, F.lit(i)).otherwise(first)
    gap = distance(F.col("fp"), F.col("other"))
    return (
        keyed(queries, "fp")
        .join(keyed(prints, "other"), ["table", "x", "y"])
        .filter((gap <= radius) & (F.col("table") == first))
        .select("fp", "other", gap.alias("distance"))
    )


def _places(docs: DataFrame) -> tuple[DataFrame, int]:
    """Each different row by its key (k1, k2), its place in the order of doc_id, and its neighbours."""
    keys = docs.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.max("doc_id").alias("doc_id"), F.max("n").alias("n")
    )
    ordered = running(keys.withColumn("one", F.lit(1)), ["doc_id", "k1", "k2"], {"place": "one"}).drop("one")
    placed = materialise(ordered, "places")
    total = placed.count()
    before = placed.select(
        F.pmod(F.col("place") + 1, F.lit(max(total, 1))).alias("place"),
        F.col("k1").alias("to1"),
        F.col("k2").alias("to2"),
        F.expr("n div 2").alias("wanted"),
    )
    return materialise(placed.join(before, "place"), "neighbours"), total


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and how like the next document is.

    The edited text has the last half of the code points replaced by as many from the start of the
    next document in the order of doc_id (after the last: the first). Rows equal in doc_id and text
    are one document in that order and get equal results; different texts of one doc_id follow each
    other by a hash; a null doc_id comes first and a null text is empty. An empty table gives no
    rows, and other columns are ignored.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).select(
        F.coalesce("doc_id", F.lit(0)).alias("k1"),
        F.xxhash64(F.col("doc_id").isNull(), "text").alias("k2"),
        "doc_id",
        "text",
    )
    places, total = _places(texts.select("k1", "k2", "doc_id", F.length("text").cast("long").alias("n")))
    # The one shuffle of whole texts; the start of each goes on to the document before it.
    own = texts.select("k1", "k2", "text").dropDuplicates(["k1", "k2"]).join(places, ["k1", "k2"])
    tails = own.select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.expr("substring(text, 1, int(wanted))").alias("tail")
    )
    both = own.join(tails, ["k1", "k2"]).select(
        "place",
        "doc_id",
        "copies",
        "n",
        "text",
        F.concat(F.expr("substring(text, 1, int(n - n div 2))"), "tail").alias("edited"),
    )
    digest = F.sha2("edited", 256)
    quarters = [
        F.conv(F.substring("_sha", 16 * i + 1, 16), 16, -10).cast("long").alias(f"q{i}") for i in range(4)
    ]
    meta = ("doc_id", "copies", "n", "q0", "q1", "q2", "q3")
    lines = (
        both.withColumn("_sha", digest)
        .select("place", "doc_id", "copies", "n", *quarters, "text", "edited")
        .select("place", *meta, F.posexplode(F.array("text", "edited")).alias("kind", "line"))
    )
    prints = materialise(votes(lines, "line", ["place", "kind"], meta), "prints")
    original = prints.filter("kind = 0")
    edited = prints.filter("kind = 1").select("place", F.col("fp").alias("edited_fp"))
    following = original.select(
        F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"), F.col("fp").alias("next_fp")
    )
    return (
        original.join(edited, "place")
        .join(following, "place")
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(
            "doc_id",
            F.col("n").alias("n_chars"),
            F.concat(*(hexadecimal(F.col(f"q{i}")) for i in range(4))).alias("edited_sha256"),
            hexadecimal(F.col("fp")).alias("fingerprint"),
            hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )
