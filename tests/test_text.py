"""Text functions against plain Python on hand-made strings."""

import math
import re

import pytest
from pyspark.sql import functions as F

from penmark.constants import EPSILON, HEDGE_WORDS, STYLE_STOPWORDS
from penmark.functions import style, tokens
from penmark.functions import words as w
from penmark.operators.cleaning import split_words

CASES = [
    None,
    "",
    "   ",
    "...",
    "one",
    "  a b ",
    "nbsp and　wide\x1cfile sep",
    "café café naïve ÀB été 😀 a1 b_c U.S. NASA",
    "First one. Second two three! Third? Four",
    "- item\n• item two\n-item\n  * last",
    "<b>bold</b> see http://x.y/z and www.a.b now",
    "the rhythm of beautiful hippopotamus perhaps (maybe) the the end",
    " ".join(f"w{i}" for i in range(300)),
    " ".join(f"w{i}" for i in range(301)),
    " ".join(f"w{i}" for i in range(500)),
    " ".join(f"w{i}" for i in range(501)),
    "tab\tnew\nline  double",
]


@pytest.fixture
def cases(texts):
    return texts(CASES).cache()


def values(df, column):
    return [r[0] for r in df.orderBy("doc_id").select(column).collect()]


def expect(function):
    return [None if t is None else function(t) for t in CASES]


def test_word_count(cases):
    assert values(cases, F.when(F.col("text").isNotNull(), w.word_count(F.col("text")))) == expect(
        lambda t: len(t.split())
    )


def test_null_text_has_no_count(cases):
    assert values(cases.filter("text is null"), w.truncate_words(F.col("text"))) == [None]


@pytest.mark.parametrize("n", [1, 3, 300, 500])
def test_truncate_and_pad(cases, n):
    text = F.col("text")
    assert values(cases, w.truncate_words(text, n)) == expect(lambda t: " ".join(t.split()[:n]))
    assert values(cases, w.pad_or_truncate_words(text, n)) == expect(
        lambda t: " ".join((t.split() + ["<PAD>"] * n)[:n])
    )


def test_truncate_is_idempotent(cases):
    once = w.truncate_words(F.col("text"), 3)
    assert values(cases, once) == values(cases, w.truncate_words(once, 3))


def test_clean_noise_and_punctuation(cases):
    def noise(t):
        t = re.sub(r"<[^<>]*>", "", t)
        t = re.sub(r"http\S+|www\.\S+", "", t)
        return re.sub(r"\s+", " ", t).strip()

    assert values(cases, w.clean_noise(F.col("text"))) == expect(noise)
    assert values(cases, w.remove_punctuation(F.col("text"))) == expect(
        lambda t: re.sub(r"[^\w\s]", "", t)
    )


def sentences(t):
    return [s for s in (p.strip() for p in re.split(r"[.!?]+", t)) if s]


def test_sentence_lengths(cases):
    mean = lambda v: sum(v) / len(v) if v else 0.0
    lens = lambda t: [len(s.split()) for s in sentences(t)]
    assert values(cases, w.avg_words_per_sentence(F.col("text"))) == expect(lambda t: mean(lens(t)))
    assert values(cases, w.sentence_lengths(F.col("text"))) == expect(lens)


def test_punctuation_density(cases):
    marks = set(".,!?;:\"'-–—()[]{}")
    assert values(cases, style.punctuation_density(F.col("text"))) == expect(
        lambda t: sum(c in marks for c in t) / len(t) if t else 0.0
    )


def test_tokens(cases):
    assert values(cases, tokens.alpha_tokens(F.col("text"))) == expect(
        lambda t: re.findall(r"\b[a-zA-Z]+\b", t.lower())
    )
    assert values(cases, tokens.vectoriser_tokens(F.col("text"))) == expect(
        lambda t: re.findall(r"\b\w\w+\b", t.lower())
    )


def test_ngrams_of_short_and_long(texts):
    df = texts(["", "aa", "aa bb cc"]).withColumn("t", tokens.vectoriser_tokens(F.col("text")))
    assert values(df, tokens.ngrams(F.col("t"), 1, 3)) == [
        [],
        ["aa"],
        ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"],
    ]


def test_split_rejoins_and_numbers(cases):
    rows = split_words(cases, 100).orderBy("doc_id", "chunk_no").collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["chunk_no"], r["text"]))
    assert set(by_doc) == set(range(len(CASES)))
    for doc, parts in by_doc.items():
        assert [n for n, _ in parts] == list(range(len(parts)))
        expected = (CASES[doc] or "").split()
        assert " ".join(t for _, t in parts if t is not None).split() == expected
        if not expected:
            assert parts == [(0, None)]
        else:
            assert len(parts) == math.ceil(len(expected) / 100)


def python_style(t):
    words = re.findall(r"\b[a-zA-Z]+\b", t.lower())
    lens = [len(s.split()) for s in sentences(t)]
    n, s = len(words), len(lens)
    mean = sum(lens) / s if s else 0.0
    groups = [max(1, len(re.findall("[aeiouy]+", x))) for x in words]
    pairs = list(zip(words, words[1:]))
    e = EPSILON
    return {
        "avg_word_len": sum(map(len, words)) / n if n else 0.0,
        "type_token_ratio": len(set(words)) / (n + e),
        "avg_sent_len": mean,
        "punct_rate": sum(c in ".,!?;:" for c in t) / (len(t) + e),
        "flesch": 206.835 - 1.015 * n / s - 84.6 * sum(groups) / n if n and s else 0.0,
        "stopword_ratio": sum(x in STYLE_STOPWORDS for x in words) / (n + e),
        "sent_len_std": (sum((x - mean) ** 2 for x in lens) / s) ** 0.5 if s else 0.0,
        "bullet_rate": len(re.findall(r"^\s*[-•*]\s", t, re.MULTILINE)) / (s + e),
        "question_rate": t.count("?") / (s + e),
        "paren_rate": t.count("(") / (n + e),
        "upper_ratio": len(re.findall(r"\b[A-Z]{2,}\b", t)) / (n + e),
        "bigram_diversity": len(set(pairs)) / (len(pairs) + e),
        "syllable_score": sum(groups) / (n + e),
        "fog": 0.4 * (n / s + 100 * sum(g >= 3 for g in groups) / n) if n and s else 0.0,
        "hedge_ratio": sum(x in HEDGE_WORDS for x in words) / (n + e),
    }


def test_stylometrics(cases):
    for row in style.stylometric_features(cases).collect():
        if row["text"] is None:
            assert row["flesch"] is None
            continue
        for name, value in python_style(row["text"]).items():
            assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9), (row["text"], name)


def test_syllables_equal_those_of_patterns(spark, monkeypatch):
    """Over slices of a few bytes too; rows are not taken together."""
    import random
    import re

    from penmark.functions import style

    draw = random.Random(3)
    rows = ["", "a", "bcd", "bcd fgh", "banana", "y b", ""]
    rows += [" ".join("".join(draw.choices("abeikyrst", k=draw.randint(1, 9))) for _ in range(draw.randint(0, 6))) for _ in range(300)]
    one = re.compile("[aeiouy]+|(?<![a-z])[b-df-hj-np-tv-xz]+(?![a-z])")
    three = re.compile("(?<![a-z])[b-df-hj-np-tv-xz]*(?:[aeiouy]+[b-df-hj-np-tv-xz]+){2}[aeiouy]")
    want = [(len(one.findall(r)), len(three.findall(r))) for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, w string").coalesce(2)
    for size in (8 << 20, 40):
        monkeypatch.setattr(style, "SLICE_BYTES", size)
        got = df.select("i", style.syllables("w").alias("s")).orderBy("i").collect()
        assert [(r["s"]["syllables"], r["s"]["complex"]) for r in got] == want


def test_style_measures_need_no_pattern_for_syllables(spark, texts):
    from conftest import plan_of
    from penmark.functions.style import stylometric_features

    plan = plan_of(stylometric_features(texts(["Banana split.", None, ""])))
    assert "aeiouy" not in plan and "ArrowEvalPython" in plan
