"""Parquet table source: one folder or file per table under a root path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`. Only Spark's reader opens the path, so any file system Spark knows will do."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
