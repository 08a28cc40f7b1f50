"""Planned and actual durations of tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions.dates import blank_to_null, overrun, parse_date, percent_overrun, ratio, whole_days


def durations(tasks: DataFrame, start: str, end: str, name: str, id_col: str = "id") -> DataFrame:
    """(id, <name>): whole days; rows with a blank or unreadable date are left out."""
    t = tasks.select(F.col(id_col).alias("id"), parse_date(blank_to_null(F.col(start))).alias("s"), parse_date(blank_to_null(F.col(end))).alias("e"))
    return t.dropna(subset=["s", "e"]).select("id", whole_days(F.col("s"), F.col("e")).alias(name))


def overruns(planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Inner join on id with ratio and overruns. planned: (id, planned_days), actual: (id, actual_days)."""
    p, a = F.col("planned_days"), F.col("actual_days")
    return planned.join(actual, "id").select("id", "planned_days", "actual_days", ratio(a, p).alias("ratio"), overrun(a, p).alias("overrun"), percent_overrun(a, p).alias("percent_overrun"))


def product_table(results: DataFrame, metadata: DataFrame, planned: DataFrame, actual: DataFrame) -> DataFrame:
    """Clustered tasks with their metadata, and durations where both exist."""
    both = planned.join(actual, "id")
    return results.join(metadata, "id").join(both, "id", "left")


def composite_id(id_col: str = "id", file_col: str = "file"):
    return F.concat_ws("_", id_col, file_col)


def without_last_suffix(column):
    return F.regexp_replace(column, "_[^_]*$", "")


def duration_spread(assignments: DataFrame, planned: DataFrame) -> DataFrame:
    """(label, duration_std): population deviation of planned days; tasks without them are ignored."""
    return assignments.join(planned, "id", "left").groupBy("label").agg(F.stddev_pop("planned_days").alias("duration_std"))


def validation(both: DataFrame) -> DataFrame:
    """Pairs with both durations above 0, with the ratio."""
    return both.where((F.col("planned_days") > 0) & (F.col("actual_days") > 0)).withColumn("ratio", F.col("actual_days") / F.col("planned_days"))
