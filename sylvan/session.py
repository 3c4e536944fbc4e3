"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Puts this package's folder on the Python path of workers that start from now on."""
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in held:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, held)])
    return spark
