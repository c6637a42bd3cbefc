"""Session construction, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Temporary folders of local sessions without a configured one, by application.
_local_dirs: dict[str, str] = {}


def build_session(app: str = "penmark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` is left to the launcher unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Lets adaptive execution use a hash join, which does not sort the wide text side,
        # wherever every partition of the narrow side is known to be small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only on a local master."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not configured:
        # All executors of master local[n] are threads of the driver; local-cluster has processes.
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _local_dirs:
            _local_dirs[application] = tempfile.mkdtemp(prefix="penmark-")
            atexit.register(shutil.rmtree, _local_dirs[application], ignore_errors=True)
        configured = _local_dirs[application]
    return configured.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/penmark/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target) and files.getFileStatus(target).isDirectory()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; nothing happens if it does not exist."""
    target, files = _file_system(spark, path)
    files.delete(target, True)


# Bytes of a row group of a written table with texts. Small ones let tasks share a file.
TEXT_ROWS = 4 << 20

# Shuffle files go at the end of the query that made them; without it they stay until the driver
# happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP_CONF, "false")
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP_CONF, before)


def materialise(df: DataFrame, label: str = "table", row_group: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Used for what several later stages read: mostly narrow tables of keys and classes, texts or
    tokens where a fit reads them repeatedly. The written table survives the loss of executors, and
    the shuffle files behind it, which nothing reads again, are removed.
    """
    return _written(df, new_path(df.sparkSession, label), row_group)


@contextmanager
def scratch(df: DataFrame, label: str = "table", row_group: int | None = None) -> Iterator[DataFrame]:
    """``materialise`` for a table that no lazy result needs: its folder goes at the end of the block."""
    path = new_path(df.sparkSession, label)
    try:
        yield _written(df, path, row_group)
    finally:
        remove_path(df.sparkSession, path)


def _written(df: DataFrame, path: str, row_group: int | None) -> DataFrame:
    writer = df.write if row_group is None else df.write.option("parquet.block.size", row_group)
    with _shuffles_freed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
