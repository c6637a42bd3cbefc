import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from penmark.session import CHECKPOINT_CONF, build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "4g",
            "spark.ui.enabled": "false",
            CHECKPOINT_CONF: str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def texts(spark):
    """A frame of (doc_id, text) from a list of strings."""

    def make(values, **columns):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for name, column in columns.items():
            df = df.withColumn(name, column)
        return df

    return make


def plan_of(df, mode="formatted"):
    """The physical plan as text, through the public explain output."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
