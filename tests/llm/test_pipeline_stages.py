"""Near copies and language stage of the pipeline, on planted rows and against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.llm import hdlang, nearcopies

SF = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(df):
    return sorted(r["doc_id"] for r in nearcopies.keep_one(df).select("doc_id").collect())


def close_pairs(rows, least):
    """Pairs of ids with a likeness of ``least`` or more, by shared shingles."""
    sets = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    shared = Counter()
    for ids in holders.values():
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                shared[a, b] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()
            if n / (len(sets[a]) + len(sets[b]) - n) >= least}


def test_near_copies_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    pairs = close_pairs(rows, 0.8)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted({find(i) for i, _ in rows})
    got = kept_ids(docs)
    assert any(0.8 <= x < 0.95 for x in pairs.values())
    assert got == want  # all pairs found, and nothing else dropped


def test_planted_near_copies(spark):
    """Texts edited to a likeness between 0.8 and 0.95 go, those below 0.75 stay."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(4000)]
    rows, alike, apart = [], [], []
    for n in range(150):
        size = int(rng.integers(40, 400))
        text = list(rng.choice(words, size))
        rows.append((2 * n, " ".join(text)))
        edited = list(text)
        changes = max(1, int(size * rng.uniform(0.002, 0.09)))
        for at in rng.choice(size, changes, replace=False):
            edited[at] = "edited" + str(rng.integers(1 << 30))
        rows.append((2 * n + 1, " ".join(edited)))
        likeness = jaccard(shingles(rows[-2][1]), shingles(rows[-1][1]))
        (alike if likeness >= 0.8 else apart).append(2 * n + 1)
    kept = set(kept_ids(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(alike) > 30 and len(apart) > 30
    assert {2 * n for n in range(150)} <= kept and set(apart) <= kept
    assert len(kept & set(alike)) <= 0.1 * len(alike)


def test_no_link_is_left_out(spark):
    """Families whose members are about 0.8 alike, where links that fail stand beside links that hold."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(60):
        size = int(rng.integers(4, 160))
        base = [f"f{family}w{i}" for i in range(size)]
        for _ in range(20):
            text = list(base)
            for at in rng.choice(size, int(rng.integers(0, max(2, size // 30))), replace=False):
                text[at] = "edited" + str(rng.integers(1 << 30))
            rows.append((len(rows), " ".join(text[: size - int(rng.integers(0, max(1, size // 12)))])))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in close_pairs(rows, 0.8):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted({find(i) for i, _ in rows})
    assert 100 < len(want) < 1000
    assert kept_ids(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_a_large_group_in_tiles(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 200], f"x{i}", *base[i % 200 + 1 :]])) for i in range(300)]
    rows += [(1000 + i, f"other text {i} with words of its own {i * i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    narrow = df.withColumn("hash", F.xxhash64("text"))
    prints = nearcopies.sketches(narrow)
    links = nearcopies.candidate_links(prints.select("words", "fp", "bands"), tile=64)
    assert links.count() < 300 * 40  # never all 44,850 pairs of the group
    assert kept_ids(df) == [0, *range(1000, 1150)]


def test_few_of_the_pairs_that_share_shingles_are_compared(spark):
    """Texts of one template that differ by half are passed over; those that differ in a word are not."""
    random = np.random.default_rng(3)
    template = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*template[:60], *(f"x{k}" for k in random.integers(0, 10**9, 60))])) for i in range(80)]
    rows.append((500, rows[7][1].rpartition(" ")[0] + " last"))
    narrow = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    prints = nearcopies.sketches(narrow)
    members = prints.select("words", "n", "bits", F.col("words").alias("component"))
    pairs = nearcopies.open_pairs(nearcopies.shared_prefixes(prints), members).collect()
    ids = {r["words"]: r["doc_id"] for r in prints.collect()}
    assert [sorted(ids[x] for x in pair) for pair in pairs] == [[7, 500]]


def test_parity_bits_never_differ_more_than_the_sets():
    random = np.random.default_rng(4)
    for n in (0, 1, 5, 300, 5000):
        a = np.unique(random.integers(0, 2**63, n, np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], random.integers(0, 2**63, n // 7, np.uint64)]))
        both = nearcopies.parity_bits(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        assert np.bitwise_count(both[0] ^ both[1]).sum() <= len(np.setxor1d(a, b))


def test_odd_rows_of_the_stages(spark):
    long = "alpha beta gamma delta epsilon " * 9000
    rows = [
        (3, None), (4, ""), (2, " \t "), (5, "One two three"), (6, "one TWO three"), (6, "one TWO three"),
        (7, "one two three four"), (None, "one two three"), (None, "alone here"), (8, long), (9, long + " alpha"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("words", F.lit(1))
    out = nearcopies.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in out.collect()) == [
        (False, 2, " \t "), (False, 5, "One two three"), (False, 7, "one two three four"), (False, 8, long),
        (True, 0, "alone here"),
    ]
    assert nearcopies.keep_one(df.limit(0)).collect() == []


def test_nothing_learned_drops_nothing_with_letters(spark):
    df = spark.createDataFrame(
        [(1, "the cat", None), (2, "日本語", None), (3, "12 34", None), (4, None, "en")],
        "doc_id long, text string, lang string",
    )
    assert sorted(r["doc_id"] for r in hdlang.keep_identified(df).collect()) == [1, 2]


def test_likeness_is_exact():
    import pyarrow as pa

    texts = ["a b c d e f g", "a b c d e f h", "A B C D E F G", "", "x"]
    for left in texts:
        got = nearcopies.likeness(pa.array([left] * len(texts)), pa.array(texts))
        assert got == pytest.approx([jaccard(shingles(left), shingles(t)) for t in texts])


@pytest.mark.parametrize("seed", range(5))
def test_spanning_links(seed):
    """As short as the links of Kruskal's method, and joining the same rows."""
    rng = np.random.default_rng(seed)
    n = 60
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (90, 2)).tolist() if a != b})
    left, right = (np.array(x) for x in zip(*pairs))
    lengths = rng.integers(0, 5, len(pairs))
    i, j = nearcopies.spanning_links(n, left, right, lengths)
    group = list(range(n))

    def joined(links):
        group[:] = range(n)
        total = []
        for length, a, b in sorted(links):
            if group[a] != group[b]:
                total.append(length)
                old = group[b]
                group[:] = [group[a] if g == old else g for g in group]
        return sum(total), len(total), [group.index(g) for g in group]

    of = {p: length for p, length in zip(pairs, lengths.tolist())}
    got = [(of[a, b], a, b) for a, b in zip(i.tolist(), j.tolist())]
    want = joined([(of[p], *p) for p in pairs])
    assert joined(got) == want and len(got) == want[1]
