"""weftline: a Spark-first analytics engine for skill graphs and text corpora."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ensure_importable(spark: SparkSession) -> None:
    """Let the Python workers import this package from the place where the driver found it.

    In local mode and on a shared file system nothing else is needed; on other
    clusters ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        env["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
