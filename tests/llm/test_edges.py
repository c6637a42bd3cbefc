"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for each operator."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from penmark.llm import (
    bitsliced,
    egojoin,
    hdlang,
    licenses,
    maxent,
    mixing,
    packing,
    simhash,
    surrogates,
    tokenfile,
)
from penmark.session import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 12_000
ROWS = [
    (1, "the cat and the dog went to the house", "en", "a", 37),
    (1, "the cat and the dog went to the house", "en", "a", 37),  # repeated row
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", None, "b", 4),
    (5, LONG, "en", "b", len(LONG)),
    (None, "der Hund und die Katze", "de", None, None),
    (6, "12345 !!! ???", "de", "a", 13),
    (7, "ein Haus und ein Baum im Wald 　 日本語", "de", "c", 30),
]
CLASHING = (
    "score", "fp", "size", "target", "words", "label", "rank", "n", "place", "kind", "lang_pred",
    "_fp", "taken", "before", "held", "n_entities", "_found", "hit", "component",
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def crowded(rows):
    return rows.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


def through_file(df):
    path = new_path(df.sparkSession, "edge-file")
    tokenfile.write_token_file(df, path, tokenizer("word_bpe_49k.json"))
    return tokenfile.read_token_file(df.sparkSession, path)


OPERATORS = {
    "surrogates": surrogates.replace_entities,
    "language": hdlang.identify_held_out,
    "token file": through_file,
    "mix": mixing.mix,
    "simhash": simhash.edited_fingerprints,
    "near duplicates": bitsliced.near_duplicates,
    "maxent": maxent.score_documents,
    "licenses": licenses.scan_licenses,
    "packing": lambda df: packing.best_fit_pack(df, tokenizer("byte_bpe_50k.json"), with_ids=True),
}


def plain(df):
    cells = lambda r: tuple(
        round(x, 9) if isinstance(x, float) else bytes(x) if isinstance(x, bytearray) else x for x in r
    )
    return sorted((cells(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(rows, name):
    out = OPERATORS[name](rows)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    if name == "packing":
        ids = [r["doc_id"] for r in out.filter("piece = 0").collect()]
    assert sorted(map(str, ids)) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_do_not_matter(rows, crowded, name):
    want = OPERATORS[name](rows)
    got = OPERATORS[name](crowded)
    if name == "packing":  # names of sequences follow the partition
        want, got = want.drop("sequence_id", "offset"), got.drop("sequence_id", "offset")
    shared = [c for c in want.columns if c not in ("lang", "source", "n_chars") or name == "simhash"]
    assert plain(got.select(*shared)) == plain(want.select(*shared))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_take_any_rows(spark, rows, crowded, nothing, stage):
    last = stage is corpus_pipeline.STAGES[-1][1]
    for docs in (rows, crowded, nothing):
        out = stage(spark, docs, "")
        if not last:
            assert out.columns == docs.columns
        count = out.count()
        assert count == 0 if docs is nothing else count > 0


def test_vectors(spark):
    unit = [1.0, 0.0, 0.0]
    table = [
        (1, unit, 0),
        (2, unit, 0),
        (2, unit, 0),  # repeated row
        (3, [2.0, 0.01, 0.0], 0),  # another length, nearly the same direction
        (4, unit, 1),  # another label
        (5, unit, None),
        (6, None, 0),
        (7, [0.0, 0.0, 0.0], 0),
        (8, [float("nan"), 0.0, 0.0], 0),
        (9, [None, 1.0, 0.0], 0),
        (10, [float("inf"), 0.0, 0.0], 0),
        (11, [], 0),
        (12, [1.0, 0.0], 0),  # another number of dimensions
        (13, [1e-300, 0.0, 0.0], 0),
        (14, [-1.0, 0.0, 0.0], 0),
        (None, [0.0, 1.0, 0.0], 0),
    ]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    out = egojoin.near_vectors(df.withColumn("node", F.lit("x")).withColumn("n", F.lit(1)))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    linked = {1, 2, 3, 13}
    want = [
        (i, 4 if i in linked else 0, 1 if i in linked else i, i not in linked - {1})
        for i in [r[0] for r in table]
    ]
    assert got == sorted(want, key=repr)
    assert egojoin.near_vectors(df.limit(0)).collect() == []


def test_empty_and_blank_texts(rows):
    scores = {r["doc_id"]: r for r in maxent.score_documents(rows).collect()}
    assert scores[2]["n_tokens"] == scores[3]["n_tokens"] == scores[4]["n_tokens"] == 1
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in scores.values())
    languages = {r["doc_id"]: r for r in hdlang.identify_held_out(rows).collect()}
    assert {languages[i]["lang_pred"] for i in (2, 3, 4, 6)} == {"und"}
    assert all(languages[i]["score"] == 0 for i in (2, 3, 4, 6))
    prints = {r["doc_id"]: r for r in bitsliced.near_duplicates(rows).collect()}
    assert {prints[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16}
    assert {prints[i]["component_id"] for i in (2, 3, 4)} == {2}
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(rows).collect()}
    assert sizes[2] == sizes[3] == sizes[4] == (0, 0)


def test_without_training_documents(spark):
    held = [i for i in range(200) if __import__("zlib").crc32(str(i).encode()) % 7 == 2]
    df = spark.createDataFrame([(i, "one two") for i in held], "doc_id long, text string")
    rows = maxent.score_documents(df).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)
    assert all(r["held_out"] and math.isfinite(r["score"]) for r in rows)
