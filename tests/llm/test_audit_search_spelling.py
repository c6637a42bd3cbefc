"""Filter audits, exact top-k search and spelling variants against brute force and on odd rows."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from penmark.llm import filteraudit, maxscore, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


# --- filter audit -------------------------------------------------------------------------------


def audit_brute(rows, labels):
    """All steps of all orders, document by document."""
    texts = {}
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""] = min(i, texts.get(text or "", i))
    good = {i for i, quality, _ in labels if i is not None and quality == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (i is not None and texts[text] < i)
        docs.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, removed_by, steps = [d for d in docs if d[0] == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before, upto = set(order[: step - 1]), set(order[:step])
                here = [d for d in own if letter in d[1] and not before & set(d[1])]
                removed_by[letter] += len(here)
                steps.append((
                    part, order, step, letter,
                    sum(not upto & set(d[1]) for d in own), len(here),
                    sum(letter in d[1] and bool(before & set(d[1])) for d in own),
                    sum(d[1] == letter for d in own),
                    sum(d[2] for d in here), sum(d[3] for d in here),
                ))
        out += [(*s, removed_by[s[3]]) for s in steps]
    return sorted(out)


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, long, "en"), (1, long, "en"), (2, long, "de"), (None, long, "en"), (9, None, "en"), (3, "", None),
        (4, "THE " * 250, "en"), (5, "a#b " + long, ""), (6, "É" * 40 + "AB", "fr"), (None, "AB", None),
        (7, " \x1f\x85 " * 300, "en"), (8, " \t\x0b\r\n", "fr"), (10, "x " * 20_000, "xx"),
    ]
    labels = [(1, 1, 0), (1, 0, None), (2, None, 1), (3, 1, 1), (None, 1, 1), (4, 0, 0), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    clashing = docs.withColumns({c: F.lit("x") for c in ("mask", "part", "n", "first", "quality", "good")})
    for table in (docs, clashing):
        out = filteraudit.audit_filters(table, marks.withColumn("mask", F.lit(1)))
        assert sorted(tuple(r) for r in out.collect()) == audit_brute(rows, labels)
    assert filteraudit.audit_filters(docs.limit(0), marks).collect() == []
    assert filteraudit.audit_filters(docs, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_many_parts(spark):
    """More steps than the default limit of a recursive query."""
    docs = spark.range(3500).select(
        F.col("id").alias("doc_id"), F.lit("A b").alias("text"), F.col("id").cast("string").alias("lang")
    )
    masks = filteraudit.failure_masks(docs)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    steps = filteraudit.prefix_steps(filteraudit.mask_cells(masks, labels), "ABCDE")
    assert steps.count() == 3500 * 325


# --- exact top-k --------------------------------------------------------------------------------


def top_brute(vectors, queries, k):
    """vectors: id -> list of ints."""
    out = set()
    for q in queries:
        scores = [
            (-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(vectors[q], v, strict=False)))), i)
            for i, v in vectors.items()
            if i != q
        ]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("dims, scale, sparse", [(16, 9, 0.0), (64, 60, 0.0), (40, 5, 0.9), (3, 2, 0.5)])
def test_top_k_equals_brute_force(spark, monkeypatch, dims, scale, sparse):
    monkeypatch.setattr(maxscore, "SHARD", 100)
    rng = np.random.default_rng(dims)
    values = rng.integers(-scale, scale + 1, (700, dims)) * (rng.random((700, dims)) >= sparse)
    values[300:340] = values[7]  # a group of copies, and many ties
    values[500] = 0
    vectors = {int(i) - 60: v.tolist() for i, v in enumerate(values)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, vector array<long>")
    got = maxscore.top_inner_products(df, F.col("vec_id") % 20 == 0, 20)
    assert {tuple(r) for r in got.collect()} == top_brute(vectors, [i for i in vectors if i % 20 == 0], 20)


def test_top_k_prunes(monkeypatch):
    """Documents that share only light terms with the query are never probed."""
    probed = []
    whole = maxscore.Shard._impacts_of
    monkeypatch.setattr(maxscore.Shard, "_impacts_of", lambda s, t, d: probed.append(len(d)) or whole(s, t, d))
    rows = [[100, 0, 1, 0, 0, 0, 0, 0, 0, 0] if i < 40 else [0] * 9 + [i % 3] for i in range(1000)]
    shard = maxscore.Shard(np.arange(1000), np.arange(1001) * 10, np.array(rows).ravel())
    ids, scores = shard.top(2000, np.array([50, 0, 2, 0, 0, 0, 0, 0, 0, 1]), 20)
    assert ids.tolist() == list(range(20)) and set(scores.tolist()) == {5002}
    assert max(probed) <= 40


def test_top_k_of_odd_rows(spark):
    huge = 3.0e17
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (0, [0.5, 9.0]),  # of one id the largest stands
        (20, []), (40, None), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (100, [float("inf")]), (-20, [huge] * 3),
        (1, [-1.0]), (2, [0.0, 0.0]), (3, [1.0, 0.5, 7.0]), (4, [huge] * 3), (None, [1.0]), (5, [-0.001]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    floor = lambda x: int(np.floor(64 * x))
    kept = {0: [1.0, 0.5], 20: [], -20: [huge] * 3, 1: [-1.0], 2: [0.0, 0.0], 3: [1.0, 0.5, 7.0], 4: [huge] * 3, 5: [-0.001]}
    vectors = {i: [min(floor(x), 2**63 - 1) for x in v] for i, v in kept.items()}
    want = top_brute(vectors, [0, 20, -20], 20)
    for table in (df, df.withColumns({c: F.lit("x") for c in ("score", "rank", "vector", "query_id", "shard")})):
        assert {tuple(r) for r in maxscore.search_embeddings(table).collect()} == want
    assert maxscore.search_embeddings(df.limit(0)).collect() == []
    assert maxscore.search_embeddings(df.filter("vec_id % 20 <> 0")).collect() == []


# --- spelling variants --------------------------------------------------------------------------


def words_brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            check = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and check % 97 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 3 and len(w) >= 5}


def near_brute(n):
    keys = {}
    for w in n:
        for i in range(len(w)):
            keys.setdefault((w[:i], w[i + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for (a, b), same in keys.items():
        for w in same:
            near[w] |= same
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    return {w: x - {w} for w, x in near.items()}


def variants_brute(rows):
    n = words_brute(rows)
    near = near_brute(n)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in spelling.spelling_variants(docs).collect()}
    assert got == variants_brute(rows)
    assert any(r[1] and r[1] != r[2] for r in got)  # chains of forms


@pytest.mark.parametrize("most", [4, 10_000])
def test_variants_among_many_blocks(spark, monkeypatch, most):
    """A third of the words share a long prefix, so their range spans many blocks."""
    monkeypatch.setattr(spelling, "BLOCK", 8)
    monkeypatch.setattr(spelling, "MOST_BLOCKS", most)
    rng = np.random.default_rng(5)
    letters = "abÿé"
    make = lambda size: "".join(letters[i] for i in rng.integers(0, 4, size))
    words = {make(rng.integers(5, 9)) for _ in range(500)}
    words |= {"prefixprefixprefix" + make(rng.integers(2, 5)) for _ in range(250)}
    words |= {make(rng.integers(2, 5)) + "suffixsuffix" for _ in range(100)}
    words |= {"x" * 3000, "x" * 2999, "x" * 2998, "x" * 1500 + "y" + "x" * 1499}
    n = {w: int(c) for w, c in zip(sorted(words), rng.integers(3, 50, len(words)), strict=True)}
    near = near_brute(n)
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    first = lambda w: min(near[w], key=lambda x: (-n[x], x), default=None)
    want = {(w, n[w], len(near[w]), first(w), n.get(first(w))) for w in n}
    assert {tuple(r) for r in got} == want


def test_variants_of_odd_rows(spark):
    word = "z" * 20_000
    rows = [
        (1, None), (2, ""), (3, "Hello hello HELLO Hellø1hello hello"), (3, "Hello hello HELLO Hellø1hello hello"),
        (None, "hallo Hallo hallo hullo"), (4, "hallo hulloo ÀÉÎÕÜ àéîõü ÀÉÎÕÜ"), (5, "日本語 hullo hullo ab ab ab ab"),
        (6, f"{word} {word} {word}y {word}"), (7, f"{word}y {word}y"), (8, "ÀÉÎÕÜ × ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷ ÀÉÎÕÜ"),
    ] + [(i, "hello world wörld") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("x") for c in ("word", "n", "run", "check", "form", "block")})
    for table in (docs, clashing):
        assert {tuple(r) for r in spelling.spelling_variants(table).collect()} == variants_brute(rows)
    assert spelling.spelling_variants(docs.limit(0)).collect() == []
    assert spelling.spelling_variants(docs.filter("doc_id < 3")).collect() == []
