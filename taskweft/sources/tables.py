"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``, through Spark's reader only (any file system it knows)."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
