"""The language model against the same model in plain Python, and its gain on unseen texts."""

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from penmark.llm import maxent

SF = "/root/testdata/sf0.01"
LOWER = {i: i + 32 for i in range(65, 91)}
MASK = (1 << 64) - 1


def mixed(*parts, salt):
    out = salt
    for p in parts:
        out = (out ^ p) * 0x9E3779B97F4A7C15 & MASK
        out ^= out >> 29
    return out % maxent.BUCKETS


def group(word):
    raw = word.encode() + b" "  # a word is kept with the space behind it
    marked = raw[-2] < 0x30 or 0x39 < raw[-2] < 0x61
    return ((raw[0] * 31 + raw[1]) % (maxent.GROUPS // 2)) * 2 + marked


def plain_scores(rows):
    """doc_id -> log10 probability, with one chunk, token by token."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))) for i, t in rows]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    n = Counter(w for i, ws in texts if not held[i] for w in ws)
    ends = sum(not h for h in held.values())
    name = {w: xxhash.xxh64_intdigest(w.encode() + b" ") for _, ws in texts for w in ws}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    least = max(2, (sum(n.values()) + ends) * maxent.FREQUENT_SHARE)
    top = sorted((w for w in n if n[w] >= least), key=lambda w: (-n[w], signed(name[w])))[: maxent.FREQUENT]
    place = {w: 2 + k for k, w in enumerate(top)}
    klass = lambda w: place.get(w, 0 if n[w] < 2 else 2 + maxent.FREQUENT + group(w))
    of_class = Counter()
    for w, k in n.items():
        of_class[klass(w)] += k
    of_class[1] = ends
    once, twice = (sum(v == k for v in n.values()) for k in (1, 2))
    share = [of_class[c] + 1 for c in range(maxent.CLASSES)]
    size = maxent.FAMILY
    family = [sum(share[f * size : f * size + size]) for f in range(maxent.FAMILIES)]
    bias = {None: [math.log(x / sum(family)) for x in family]}
    for f in range(maxent.FAMILIES):
        bias[f] = [math.log(x / family[f]) for x in share[f * size : f * size + size]]

    def tokens(words):
        ids = [name[w] & 0x7FFFFFFF for w in words] + [1]
        classes = [klass(w) for w in words] + [1]
        back = lambda values, t, by, blank: values[t - by] if t >= by else blank
        for t, c in enumerate(classes):
            c1, c2, c3 = (back(classes, t, by, maxent.CLASSES) for by in (1, 2, 3))
            features = (
                mixed(back(ids, t, 1, 0), salt=1), mixed(back(ids, t, 2, 0), salt=2),
                mixed(c1, c2, salt=3), mixed(c2, c3, salt=4),
            )
            yield features, c

    weights, zero = {}, np.zeros(size)

    def probabilities(own, features, level):
        x = bias[level] + sum(own.get((f, level), zero) for f in features)
        x = np.exp(x - x.max())
        return x / x.sum()

    for part in range(maxent.ROUNDS):
        own, squares = {k: v.copy() for k, v in weights.items()}, Counter()
        some = [x for k, (i, ws) in enumerate(texts) if not held[i] and k % maxent.ROUNDS == part for x in tokens(ws)]
        for at in range(0, len(some), maxent.BATCH):
            batch = some[at : at + maxent.BATCH]
            for deep in (False, True):
                slopes = []
                for features, c in batch:
                    level = c // size if deep else None
                    slope = probabilities(own, features, level)
                    slope[c % size if deep else c // size] -= 1
                    slopes.append((features, level, slope))
                for k in range(4):
                    sums = {}
                    for features, level, slope in slopes:
                        key = features[k], level
                        sums[key] = sums.get(key, 0) + slope
                    for key, s in sums.items():
                        squares[key] += float(s @ s)
                        own[key] = own.get(key, zero) - s * maxent.RATE / math.sqrt(squares[key] + 1e-6)
        for key in squares:
            change = own[key] - weights.get(key, zero)
            weights[key] = weights.get(key, zero) + np.rint(change * maxent.SCALE) / maxent.SCALE
    spread = once + 2 * twice + 2
    out = {}
    for i, ws in texts:
        total = 0.0
        for (features, c), w in zip(tokens(ws), [*ws, None], strict=True):
            total += math.log(probabilities(weights, features, None)[c // size])
            total += math.log(probabilities(weights, features, c // size)[c % size])
            if c == 0:
                total += math.log((once + 1) / spread if n[w] == 0 else (2 * twice + 1) / spread / max(once, 1))
            elif w is not None:
                total += math.log(n[w] / of_class[c])
        out[i] = total / math.log(10)
    return out


def test_scores_equal_the_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 50").select("doc_id", "text")
    rows = [(r[0], r[1]) for r in docs.orderBy("doc_id").collect()]
    one = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = plain_scores(rows)
    got = {r["doc_id"]: r["score"] for r in maxent.score_documents(one).collect()}
    assert got.keys() == want.keys()
    for i, score in want.items():
        assert got[i] == pytest.approx(score, rel=2e-3, abs=0.02), i


def test_gain_on_known_tokens(spark):
    """Unseen texts without unknown words gain over the unigram model that training starts from."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trained = maxent.score_documents(docs).filter("held_out and n_known = n_tokens").collect()
    start = {r["doc_id"]: r["score"] for r in maxent.score_documents(docs, rounds=0).collect()}
    n = sum(r["n_tokens"] for r in trained)
    assert n > 500
    assert sum(r["score"] - start[r["doc_id"]] for r in trained) / n > 0.02


def plain_step(weights, squares, level):
    """A gradient step with numpy's stable order and sums along the rows."""
    x = sum(weights[level.rows[:, k]] for k in range(1, 4)) + weights[level.rows[:, 0]] + level.bias
    x = np.exp(x - x.max(axis=1, keepdims=True))
    slope = x / x.sum(axis=1, keepdims=True)
    slope[np.arange(len(slope)), level.targets] -= 1
    for k in range(4):
        order = np.argsort(level.rows[:, k], kind="stable")
        ids = level.rows[order, k]
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        rows, sums = ids[starts], np.add.reduceat(slope[order], starts, axis=0)
        squares[rows] += (sums * sums).sum(axis=1)
        weights[rows] -= sums * (maxent.RATE / np.sqrt(squares[rows] + 1e-6))[:, None]


def test_steps_are_cheap_and_equal_plain_ones():
    """On features as skewed as words (by 1 / rank), steps cost well below those of plain array operations."""
    rng = np.random.default_rng(7)
    size = 40 * maxent.BATCH + 5
    features = np.asfortranarray(maxent.BUCKETS ** rng.random((size, 4)) - 1, np.int32)
    classes = (maxent.CLASSES ** rng.random(size) - 1).astype(np.int32)
    bias = maxent._bias(np.bincount(classes, minlength=maxent.CLASSES))

    def run(step):
        weights = np.zeros((maxent.BUCKETS * maxent.ROWS, maxent.FAMILY), np.float32)
        squares = np.zeros(len(weights), np.float32)
        start = time.process_time()
        for at in range(0, size, maxent.BATCH):
            span = slice(at, at + maxent.BATCH)
            for level in maxent._levels(features[span], classes[span], bias):
                step(weights, squares, level)
        return time.process_time() - start, weights, squares

    ours, plain = ([run(step) for _ in range(3)] for step in (maxent.step, plain_step))
    assert np.abs(ours[0][1]).max() > 0.1
    for got, want in zip(ours[0][1:], plain[0][1:], strict=True):
        assert np.allclose(got, want, rtol=1e-3, atol=1e-4)
    assert min(r[0] for r in ours) < 0.8 * min(r[0] for r in plain)
