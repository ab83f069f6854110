"""Python workers import this package wherever the session was started from."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> SparkSession:
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark
