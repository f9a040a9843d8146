"""Python workers that can import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

import latticework

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(latticework.__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the path of the session's Python workers."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark
