"""Where HTML comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, html): one document a file; ids are hashes of paths."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "html")


def inline(spark: SparkSession, docs: dict[int, str]) -> DataFrame:
    return spark.createDataFrame(list(docs.items()), "doc_id long, html string")
