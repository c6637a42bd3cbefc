"""TF-IDF against a direct computation in plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penmark.operators import tfidf, tokenids
from penmark.operators.tfidf import TfidfConfig

DOCS = [
    "the cat sat on the mat",
    "The dog sat; the dog ran!",
    "a cat, a dog and a bird",
    None,
    "",
    "zebra",
    "cat cat cat élan élan",
]


def grams(text, low, high, stop=()):
    toks = [t for t in re.findall(r"\b\w\w+\b", (text or "").lower()) if t not in stop]
    return [
        " ".join(toks[i : i + n]) for n in range(low, high + 1) for i in range(len(toks) - n + 1)
    ]


def brute(docs, config):
    counts = [Counter(grams(d, *config.ngram_range, config.stop_words)) for d in docs]
    tf, df = Counter(), Counter()
    for c in counts:
        tf.update(c)
        df.update(c.keys())
    terms = sorted((t for t in tf if df[t] >= config.min_df), key=lambda t: (-tf[t], t))
    vocabulary = sorted(terms[: config.max_features])
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocabulary}
    weights = {}
    for i, c in enumerate(counts):
        row = {
            t: ((1 + math.log(n)) if config.sublinear_tf else n) * idf[t]
            for t, n in c.items()
            if t in idf
        }
        norm = math.sqrt(sum(v * v for v in row.values()))
        weights.update({(i, t): v / norm for t, v in row.items()})
    return vocabulary, idf, weights


@pytest.mark.parametrize(
    "config",
    [
        TfidfConfig(100, (1, 1)),
        TfidfConfig(6, (1, 2)),
        TfidfConfig(100, (1, 4)),
        TfidfConfig(5, (1, 2), min_df=2, stop_words=("the", "and"), sublinear_tf=True),
        TfidfConfig(3, (1, 1)),
    ],
)
def test_weights_match(texts, config):
    df = texts(DOCS)
    model = tfidf.tfidf_fit(df, config)
    vocabulary, idf, weights = brute(DOCS, config)
    rows = model.vocabulary.orderBy("term_id").collect()
    assert [r["term"] for r in rows] == vocabulary
    assert [r["idf"] for r in rows] == pytest.approx([idf[t] for t in vocabulary])
    got = {(r["doc_id"], r["term"]): r["tfidf"] for r in model.transform(df).collect()}
    assert got.keys() == weights.keys()
    for key, value in weights.items():
        assert got[key] == pytest.approx(value)


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("features, min_df", [(8, 1), (25, 1), (25, 3), (10_000, 1)])
def test_length_by_length_vocabulary_is_exact(texts, monkeypatch, features, min_df, limit):
    """Few words, so that long n-grams compete with short ones and many terms tie."""
    import random

    random.seed(features + min_df)
    docs = [
        " ".join(random.choices(["aa", "bb", "cc", "dd"], [8, 4, 2, 1], k=random.randint(0, 14)))
        for _ in range(40)
    ]
    if limit is not None:
        # Too many ties to fetch: further lengths are then counted without pruning.
        monkeypatch.setattr(tfidf, "fetch_table", lambda df, n: None)
    config = TfidfConfig(features, (1, 4), min_df=min_df)
    got = [r["term"] for r in tfidf.tfidf_vocabulary(texts(docs), config).collect()]
    assert sorted(got) == brute(docs, config)[0]


def test_unknown_text_has_no_rows(texts):
    model = tfidf.tfidf_fit(texts(["alpha beta"]), TfidfConfig(10))
    assert model.transform(texts(["gamma", "alpha"])).count() == 1


def test_top_terms_count_documents_without_the_term(texts):
    df = texts(["aa bb", "aa", "cc cc"]).withColumn(
        "generated_by", F.when(F.col("doc_id") < 2, "x").otherwise("y")
    )
    rows = tfidf.top_terms(df, TfidfConfig(10), k=1).collect()
    _, _, weights = brute(["aa bb", "aa", "cc cc"], TfidfConfig(10))
    best = {r["generated_by"]: (r["term"], r["mean_tfidf"]) for r in rows}
    assert best["y"] == ("cc", pytest.approx(1.0))
    assert best["x"] == ("aa", pytest.approx((weights[(0, "aa")] + 1.0) / 2))


def test_vector_form_equals_long_form(texts):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from penmark.plans.training import tfidf_stages

    config = TfidfConfig(50, (1, 3))
    df = texts(DOCS)
    vectors = PipelineModel(tfidf_stages(df, config)).transform(df)
    dense = {
        r["doc_id"]: r["v"]
        for r in vectors.select("doc_id", vector_to_array("features").alias("v")).collect()
    }
    vocabulary, _, weights = brute(DOCS, config)
    for doc, values in dense.items():
        assert values == pytest.approx([weights.get((doc, t), 0.0) for t in vocabulary])


def test_token_ids(texts):
    df = texts(["bb aa zz bb", "", None, "aa " * 10])
    vocabulary = tfidf.tfidf_fit(texts(["aa bb"]), TfidfConfig(10)).vocabulary
    rows = {
        r["doc_id"]: (r["input_ids"], r["attention_mask"])
        for r in tokenids.encode_token_ids(df, vocabulary, max_len=5).collect()
    }
    assert rows == {
        0: ([3, 2, 1, 3, 0], [1, 1, 1, 1, 0]),
        1: ([0] * 5, [0] * 5),
        2: ([0] * 5, [0] * 5),
        3: ([2] * 5, [1] * 5),
    }


def test_vocabulary_by_keys_equals_that_by_terms(spark, sf, monkeypatch):
    """Also over slices of few texts; too many ties leave it to the terms."""
    from penmark.operators import tfidf

    monkeypatch.setattr(tfidf, "SLICE_TOKENS", 2_000)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for config in (TfidfConfig(300, (1, 4)), TfidfConfig(2_000, (2, 3)), TfidfConfig(400, (1, 2), min_df=5)):
        tokens = tfidf._tokenised(docs, config, "text")
        by_keys = tfidf._vocabulary_by_keys(tokens, config)
        by_terms = tfidf._vocabulary_by_terms(tokens, config)
        assert by_keys.select(["term", "tf", "df"]).to_pylist() == by_terms.select(["term", "tf", "df"]).to_pylist()
    monkeypatch.setattr(tfidf, "SMALL_TABLE_ROWS", 10)
    tied = spark.createDataFrame([(" ".join(f"w{i}" for i in range(500)),)], "text string")
    few = TfidfConfig(20, (1, 2))
    tokens = tfidf._tokenised(tied, few, "text")
    assert tfidf._vocabulary_by_keys(tokens, few) is None
    assert tfidf.tfidf_vocabulary(tied, few).count() == 20


def test_ngram_counter_equals_spark_and_is_saved(spark, tmp_path, monkeypatch):
    """Also over slices of few tokens, and for terms whose parts are no terms."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel

    from penmark.operators import ngramcounts

    monkeypatch.setattr(ngramcounts, "SLICE_TOKENS", 7)
    rows = [["a", "b", "a", "b", "c"], [], None, ["b"], ["c", "a", "b", "c", "d", "a"], ["a"] * 9, ["zz", "é"]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, _tokens array<string>").coalesce(1)
    terms = ["a b c", "a", "c d a", "é", "b a", "a a a a", "never seen"]
    counter = ngramcounts.NgramCounter(inputCol="_tokens", outputCol="n", vocabulary=terms)
    PipelineModel([counter]).save(str(tmp_path / "counter"))
    grams = tfidf.with_ngrams(df.filter("_tokens is not null"), 1, 4)
    want = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="n").transform(grams)
    want = {r["doc_id"]: r["n"] for r in want.collect()}
    for model in (counter, PipelineModel.load(str(tmp_path / "counter"))):
        got = {r["doc_id"]: r["n"] for r in model.transform(df).collect()}
        assert not got.pop(2).toArray().any()
        assert got == want and sum(v.numNonzeros() for v in got.values()) == 9
    assert ngramcounts.NgramCounter(inputCol="_tokens", outputCol="n", vocabulary=[]).transform(df).count() == 7


def test_a_classifier_makes_its_features_once(spark, texts, monkeypatch):
    from penmark.plans import training

    labels = []
    monkeypatch.setattr(training, "materialise", lambda df, label: labels.append(label) or df)
    df = texts(["aa bb", "aa cc", "dd ee"] * 4).withColumn("generated_by", F.when(F.col("doc_id") % 3 == 2, "x").otherwise("y"))
    training.train_tfidf_classifier(df, TfidfConfig(10, (1, 2)), max_iter=2)
    assert labels == ["features"]


def test_longer_ngrams_are_counted_of_frequent_shorter_ones_only(spark, texts, monkeypatch):
    calls, plain = [], tfidf._gram_stats

    def noted(tokenised, lengths, known, wanted=None):
        if wanted is None:
            calls.append((lengths, known is None))
        return plain(tokenised, lengths, known, wanted)

    monkeypatch.setattr(tfidf, "_gram_stats", noted)
    df = texts(["aa bb aa bb cc", "aa bb dd", "aa aa bb", None, "ee"])
    config = tfidf.TfidfConfig(4, (1, 3))
    found = [(r["term"], r["tf"], r["df"]) for r in tfidf.tfidf_vocabulary(df, config).collect()]
    assert found == [("aa", 5, 3), ("aa bb", 4, 3), ("bb", 4, 3), ("aa aa", 1, 1)]
    assert calls == [((1, 1), True), ((2, 2), False), ((3, 3), False)]
