"""Drill-down into one clustering: annotated clusters, statistics, the reference-class curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions.dates import overrun, percent_overrun, ratio
from taskweft.operators.stats import running_total, summary_table


def annotate(tasks: DataFrame) -> DataFrame:
    """(cluster, tasks, files, title). tasks: (cluster, id, file)."""
    n = tasks.groupBy("cluster").agg(F.count(F.lit(1)).alias("tasks"), F.countDistinct("file").alias("files"))
    return n.withColumn("title", F.format_string("%s (%d tasks, %d files)", F.col("cluster").cast("string"), "tasks", "files"))


def orphans(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count_if(F.col("size") == 1).alias("orphans"))


def mean_overrun(tasks: DataFrame) -> DataFrame:
    """(cluster, overrun): mean percent overrun cut to a whole number; planned 0 is skipped, 0 without any."""
    return tasks.groupBy("cluster").agg(F.coalesce(F.avg(percent_overrun(F.col("actual_days"), F.col("planned_days"))), F.lit(0.0)).cast("int").alias("overrun"))


def sorted_clusters(clusters: DataFrame, by: str) -> DataFrame:
    """``alphabetical``, ``size`` or ``overrun`` (falling), equal ones by cluster."""
    order = {"alphabetical": ["cluster"], "size": [F.desc("tasks"), "cluster"], "overrun": [F.desc("overrun"), "cluster"]}[by]
    return clusters.orderBy(*order)


def statistics(tasks: DataFrame) -> DataFrame:
    """(cluster, measure, mean, median, std): days over all tasks that have them, ratios where both are and planned is not 0."""
    p, a = F.col("planned_days"), F.col("actual_days")
    full = tasks.select("cluster", p.alias("planned"), a.alias("actual"), F.when(p != 0, overrun(a, p)).alias("overrun"), percent_overrun(a, p).alias("percent_overrun"))
    return summary_table(full, ["planned", "actual", "overrun", "percent_overrun"], "cluster")


def reference_class_curve(tasks: DataFrame) -> DataFrame:
    """(cluster, id, ratio, cumulative): ratios to 2 digits, rising, with their running share of the sum in percent."""
    r = tasks.select("cluster", "id", F.round(ratio(F.col("actual_days"), F.col("planned_days")), 2).alias("ratio")).where("ratio is not null")
    return running_share(r, "cluster", ["ratio", "id"], "ratio", "cumulative")


def running_share(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """With ``name``: the running sum of ``value`` within the group, in percent of the group's sum (null for 0)."""
    sums = running_total(df, [group], order, value)
    return sums.select(*df.columns, F.when(F.col("total") != 0, 100 * (F.col("before") + F.col(value)) / F.col("total")).alias(name))
