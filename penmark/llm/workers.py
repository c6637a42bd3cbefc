"""Python workers import this package by name; a cluster has it installed, a checkout may not."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def make_importable(spark: SparkSession) -> None:
    """Put the folder that holds the package on the path of Python workers started from now on."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, known] if known else [ROOT])
