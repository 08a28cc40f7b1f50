"""All named queries over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskweft.operators import drilldown
from taskweft.plans import queries_durations, queries_sources, queries_stats, queries_text, queries_vectors  # noqa: F401  they register
from taskweft.plans.registry import QUERIES, SQL, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster the statistics of planned and actual days, with the half point of its reference-class curve."""
    tasks = queries_durations.tasks(Tables(spark, sf_dir))
    half = drilldown.reference_class_curve(tasks.where("planned_days > 0 and actual_days > 0")).where("cumulative >= 50").groupBy("cluster").agg(F.min("ratio").alias("half_ratio"))
    return drilldown.statistics(tasks).join(half, "cluster", "left").orderBy("cluster", "measure")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
