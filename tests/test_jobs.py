"""Sources, models, streams and the registered queries."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from penmark.catalog import ORACLES, QUERIES
from penmark.catalog.fixtures import corpus, predictions, vectors_learnable
from penmark.catalog.models import distinct_texts
from penmark.operators.evaluation import accuracy
from penmark.operators.tfidf import TfidfConfig
from penmark.plans import training
from penmark.session import new_path
from penmark.sources import corpus as corpora
from penmark.sources import embeddings, models, runs
from penmark.streaming.cleaning import clean_stream
from penmark.streaming.scoring import score_stream, write_available

SMALL = "/root/testdata/sf0.01"


def test_written_corpus_is_pruned_by_split(spark, sf):
    path = new_path(spark, "corpus")
    corpora.write_corpus(corpus(spark, sf), path)
    part = corpora.load_corpus(spark, path).filter("split = 'val'").select("doc_id")
    plan = plan_of(part)
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<doc_id:bigint>" in plan
    assert part.count() == corpus(spark, sf).filter("split = 'val'").count()


def test_harmonise_is_a_no_op_on_the_canonical_layout(spark, sf):
    rows = corpus(spark, sf).select("text", "generated_by")
    assert corpora.harmonise_schema(rows).columns == ["text", "generated_by"]


def test_run_results_in_the_published_form(spark):
    import json
    import os

    path = new_path(spark, "runs")
    os.makedirs(f"{path}/small_x")
    scores = {"precision": 0.5, "recall": 0.25, "f1-score": 0.3333, "support": 4.0}
    document = {
        "best_val_acc": 0.5,
        "test_stats": {"test_accuracy": 0.4, "per_class": {"gpt-x": scores}, "report_text": "r"},
        "training_history": [
            {"epoch": 1, "loss": 2.0, "train_acc": 0.3, "val_acc": 0.5},
            {"epoch": 2, "loss": 1.0, "train_acc": 0.6, "val_acc": 0.4},
        ],
        "label2id": {"gpt-x": 0},
    }
    with open(f"{path}/small_x/stats.json", "w") as f:
        json.dump(document, f, indent=2)
    results = runs.read_run_results(spark, f"{path}/*/stats.json")
    assert tuple(runs.run_scores(results).first()) == ("small_x", 0.5, 0.4, 1, 2)
    assert tuple(runs.run_class_metrics(results).first())[:5] == ("small_x", "gpt-x", 0.5, 0.25, 0.3333)
    assert runs.run_history(results).count() == 2
    assert runs.run_leaderboard(results).first()["gap"] == pytest.approx(0.2)


def test_embedding_store_prunes(spark, sf):
    path = new_path(spark, "store")
    rows = vectors_learnable(spark, sf)
    embeddings.write_embeddings(rows, path, "one")
    embeddings.write_embeddings(rows, path, "two")
    part = embeddings.read_embeddings(spark, path, "two", "train")
    assert "encoder" in plan_of(part).split("PartitionFilters: ")[1].split("\n")[0]
    assert part.count() == rows.filter("split = 'train'").count()


def test_text_classifier_beats_the_majority_and_survives_saving(spark):
    docs = distinct_texts(spark, SMALL).cache()
    train, test = docs.filter("split = 'train'"), docs.filter("split = 'test'")
    trained = training.train_tfidf_classifier(train, TfidfConfig(500, (1, 1)), max_iter=15)
    scored = training.predict_batch(trained.pipeline, test, ["doc_id", "generated_by"])
    score = accuracy(scored, "generated_by", "predicted_label").first()["accuracy"]
    majority = train.groupBy("generated_by").count().agg(F.max("count")).first()[0] / train.count()
    assert score > majority + 0.2
    path = new_path(spark, "model")
    models.save_pipeline(trained.pipeline, path)
    again = training.predict_batch(models.load_pipeline(path), test, ["doc_id", "generated_by"])
    pick = lambda df: sorted(tuple(r) for r in df.select("doc_id", "predicted_label").collect())
    assert pick(again) == pick(scored)

    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet")
    arriving = score_stream(source.parquet(SMALL), trained.pipeline, ["doc_id"])
    out = new_path(spark, "scored")
    write_available(arriving, out, new_path(spark, "state")).awaitTermination()
    streamed = spark.read.parquet(out).join(test.select("doc_id"), "doc_id")
    assert pick(streamed) == pick(scored)


def test_network_and_selection_learn(spark):
    from pyspark.ml.classification import LogisticRegression

    rows = vectors_learnable(spark, SMALL)
    train, test = rows.filter("split = 'train'"), rows.filter("split <> 'train'")
    # Labels whose order as strings is not that of their numbers come back decoded.
    renamed = lambda df: df.withColumn("label", (F.col("label") * 5).cast("string"))
    trained = training.train_embedding_classifier(renamed(train), hidden=(16,), max_iter=60)
    scored = trained.pipeline.transform(training.with_vectors(renamed(test)))
    assert accuracy(scored, "label", "predicted_label").first()["accuracy"] > 0.5

    estimator = LogisticRegression(labelCol="label_id", family="multinomial", maxIter=20)
    indexed = lambda df: training.with_vectors(df).withColumnRenamed("label", "label_id")
    val = rows.filter("split = 'val'")
    found = training.grid_search(
        estimator,
        [{estimator.regParam: 10.0}, {estimator.regParam: 0.001}],
        indexed(train),
        indexed(val),
        indexed(test),
    )
    assert found.chosen == 1 and found.model.getOrDefault("regParam") == 0.001
    assert found.tried[1]["val_loss"] < found.tried[0]["val_loss"]
    assert found.test.count() == test.count()


def test_stream_recognises_copies_and_keeps_late_texts(spark):
    source = new_path(spark, "arriving")
    schema = "doc_id long, text string, arrived timestamp"
    days = ("2024-01-01", "2024-03-01", "2023-01-01")
    for n, (day, texts) in enumerate(zip(days, (["one  two", "three"], ["three", "one two", None, None], ["late"]))):
        rows = spark.createDataFrame([(10 * n + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        rows.withColumn("arrived", F.lit(day).cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = new_path(spark, "cleaned")
    write_available(clean_stream(stream, ["doc_id"]), out, new_path(spark, "state")).awaitTermination()
    got = sorted(str(r["text"]) for r in spark.read.parquet(out).collect())
    assert got == ["None", "late", "one two", "three"]


def test_predictions_fixture_covers_hits_and_misses(spark, sf):
    score = accuracy(predictions(spark, sf)).first()["accuracy"]
    assert 0.5 < score < 0.9


# Queries that train models take long and are covered above.
TRAINING = {
    "train_tfidf_classifier",
    "predict_batch",
    "saved_model_predictions",
    "train_embedding_classifier",
    "train_weighted_classifier",
    "grid_search",
    "score_stream",
}


@pytest.fixture(scope="module")
def con(sf):
    from check import duck

    return duck(sf)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in TRAINING])
def test_query_agrees_with_its_sql(spark, sf, con, name):
    from check import compare

    got = QUERIES[name](spark, sf).toArrow()
    assert got.num_rows > 0
    if name in ORACLES:
        verdict = compare(got, con.execute(ORACLES[name]).to_arrow_table())
        assert verdict.startswith("ok"), verdict


def test_only_the_encoder_and_similarity_use_python(spark, sf):
    for name in ("stylometric_features", "tfidf_transform", "recipe_split_upsample", "top_terms"):
        plan = plan_of(QUERIES[name](spark, sf))
        for node in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "NestedLoop"):
            assert node not in plan, (name, node)


def in_parts(spark, sf, folder):
    """The documents of ``sf`` as a folder of several files."""
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_clean_stream_reads_documents_in_parts(spark, sf):
    folder = in_parts(spark, sf, new_path(spark, "parts"))
    rows = lambda at: sorted(QUERIES["clean_stream"](spark, at).collect(), key=str)
    assert rows(folder) == rows(sf) != []


def test_documents_arrive_from_a_file_or_a_folder(spark, sf):
    from penmark.catalog.streams import _arriving, _run

    folder = in_parts(spark, sf, new_path(spark, "parts"))
    ids = lambda at: sorted(r[0] for r in _run(spark, _arriving(spark, at).select("doc_id"), "ids").collect())
    assert ids(folder) == ids(sf) != []


def test_equal_runs_share_a_rank(spark, sf):
    """Copies of a supplier's lines are runs of equal scores, whatever the order of rows."""
    folder = new_path(spark, "copies")
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    copies = spark.range(40).select(F.col("id").alias("copy"))
    shifted = F.col("l_suppkey") + F.col("copy") * 1_000_000
    lines.crossJoin(copies).withColumn("l_suppkey", shifted).drop("copy").write.parquet(f"{folder}/lineitem.parquet")
    board = QUERIES["run_leaderboard"](spark, folder)
    ranks = board.groupBy((F.col("run").cast("long") % 1_000_000).alias("supplier")).agg(F.countDistinct("rank").alias("n"))
    assert ranks.agg(F.max("n")).first()[0] == 1


def test_scores_of_a_stream_meet_those_of_the_table_once(spark):
    from penmark.catalog.streams import same_rows

    columns = "doc_id long, predicted_label string, confidence double"
    rows = [(1, "a", 0.5), (1, "a", 0.7), (1, "b", 0.6), (None, "a", 0.9), (None, "b", 0.4), (2, "a", 0.8)]
    table = spark.createDataFrame(rows, columns)
    found = same_rows(spark.createDataFrame(rows[::-1], columns), table)
    assert sorted(found.collect(), key=str) == sorted([(r[0], True) for r in rows], key=str)
    other = spark.createDataFrame([*rows[:5], (3, "a", 0.8)], columns)
    found = {(r["doc_id"], r["same"]) for r in same_rows(other, table).collect()}
    assert found == {(1, True), (None, True), (2, False), (3, False)}
