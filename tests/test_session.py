"""The shared folder: configured, or temporary on a local master only."""

import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from penmark.session import CLEANUP_CONF, materialise, path_exists, scratch, shared_dir


def stub(master, configured=None):
    context = SimpleNamespace(
        master=master,
        applicationId=f"app-{master}",
        getConf=lambda: SimpleNamespace(get=lambda key: configured),
    )
    conf = SimpleNamespace(get=lambda key, default: default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_configured_folder_is_used():
    assert shared_dir(stub("spark://host", "hdfs:///shared/")) == "hdfs:///shared"


def test_local_master_gets_one_temporary_folder():
    session = stub("local[2]")
    assert shared_dir(session) == shared_dir(session)


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(stub("yarn"))


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP_CONF)
    rows = spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    written = materialise(rows)
    # Files are removed in the background.
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before
    assert written.count() == 7
    assert spark.conf.get(CLEANUP_CONF) == setting


def test_a_scratch_table_goes_with_its_block(spark):
    with scratch(spark.range(5), "gone") as rows:
        assert rows.count() == 5
        path = rows.inputFiles()[0].rpartition("/")[0]
        assert path_exists(spark, path)
    assert not path_exists(spark, path)
