"""Queries over durations: orders stand for tasks, the first and last shipping dates for planned and actual ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions import dates
from taskweft.operators import drilldown, durations as du, stats, tables as tb
from taskweft.plans.registry import Tables, query
from taskweft.plans.scratch import Scratch


def once(df: DataFrame) -> DataFrame:
    """A table written once, as the plan reads it more than once."""
    return Scratch(df.sparkSession, "durations").cut(df)


def both(t: Tables) -> DataFrame:
    """(id, planned_days, actual_days): one aggregate of line items, one join."""
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return o.join(ends, "id").select("id", dates.whole_days(F.col("o_orderdate"), F.col("first")).alias("planned_days"), dates.whole_days(F.col("o_orderdate"), F.col("last")).alias("actual_days"))


def tasks(t: Tables) -> DataFrame:
    """(id, cluster, file, planned_days, actual_days)."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cluster"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("file")).join(c, "o_custkey")
    return o.join(both(t), "id").select("id", "cluster", "file", "planned_days", "actual_days")


BOTH = """both_ AS (SELECT o_orderkey AS id, CAST(floor((epoch(f) - epoch(o_orderdate)) / 86400) AS INTEGER) AS planned_days,
    CAST(floor((epoch(l) - epoch(o_orderdate)) / 86400) AS INTEGER) AS actual_days
    FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
TASKS = BOTH + """, tasks AS (SELECT b.id, c_mktsegment AS cluster, o_orderpriority AS file, planned_days, actual_days
    FROM both_ b JOIN orders ON o_orderkey = b.id JOIN customer ON c_custkey = o_custkey)"""
RATIO = "CASE WHEN planned_days <> 0 THEN CAST(actual_days AS DOUBLE) / planned_days END"


@query(f"WITH {BOTH} SELECT id, planned_days, actual_days, round({RATIO}, 6) + 0.0 AS ratio, actual_days - planned_days AS overrun, round(100 * ({RATIO} - 1), 6) + 0.0 AS percent_overrun FROM both_")
def durations_overrun(t):
    b = once(both(t))
    out = du.overruns(b.select("id", "planned_days"), b.select("id", "actual_days"))
    return out.withColumns({"ratio": F.round("ratio", 6) + 0.0, "percent_overrun": F.round("percent_overrun", 6) + 0.0})


@query(f"""WITH {TASKS} SELECT cluster, measure, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_pop(v), 4) AS std FROM (
    SELECT cluster, 'planned' AS measure, CAST(planned_days AS DOUBLE) AS v FROM tasks UNION ALL SELECT cluster, 'actual', actual_days FROM tasks
    UNION ALL SELECT cluster, 'overrun', actual_days - planned_days FROM tasks WHERE planned_days <> 0
    UNION ALL SELECT cluster, 'percent_overrun', 100 * ({RATIO} - 1) FROM tasks WHERE planned_days <> 0) GROUP BY ALL""")
def overrun_statistics(t):
    return drilldown.statistics(tasks(t)).select("cluster", "measure", *(F.round(c, 4).alias(c) for c in ("mean", "median", "std")))


@query(f"""WITH {TASKS} SELECT cluster, CAST(trunc(coalesce(avg(CASE WHEN planned_days <> 0 THEN 100 * ({RATIO} - 1) END), 0)) AS INTEGER) AS overrun FROM tasks GROUP BY cluster""")
def overrun_by_cluster(t):
    return drilldown.mean_overrun(tasks(t))


@query(f"""WITH {TASKS}, r AS (SELECT cluster, id, ((200 * actual_days + planned_days) // (2 * planned_days)) / 100.0 AS ratio FROM tasks WHERE planned_days > 0 AND actual_days > 0)
    SELECT cluster, id, ratio, round(100 * sum(ratio) OVER (PARTITION BY cluster ORDER BY ratio, id ROWS UNBOUNDED PRECEDING) / sum(ratio) OVER (PARTITION BY cluster), 4) AS cumulative FROM r""")
def rcf_curve(t):
    """Ratios half up to two digits, on both sides: in whole numbers there."""
    positive = tasks(t).where("planned_days > 0 and actual_days > 0")
    return drilldown.reference_class_curve(positive).withColumn("cumulative", F.round("cumulative", 4))


@query(f"""WITH {TASKS} SELECT cluster, count(*) AS tasks, count(DISTINCT file) AS files, cluster || ' (' || count(*) || ' tasks, ' || count(DISTINCT file) || ' files)' AS title FROM tasks GROUP BY cluster""")
def cluster_annotations(t):
    return drilldown.annotate(tasks(t))


@query(f"WITH {TASKS} SELECT cluster, round(stddev_pop(planned_days), 6) AS duration_std FROM tasks GROUP BY cluster")
def duration_spread(t):
    x = once(tasks(t))
    out = du.duration_spread(x.select("id", F.col("cluster").alias("label")), x.select("id", "planned_days"))
    return out.select(F.col("label").alias("cluster"), F.round("duration_std", 6).alias("duration_std"))


@query(f"""WITH {BOTH} SELECT count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS min, round(quantile_cont(r, 0.25), 6) AS p25,
    round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.75), 6) AS p75, round(max(r), 6) AS max
    FROM (SELECT {RATIO} AS r FROM both_ WHERE planned_days > 0 AND actual_days > 0)""")
def duration_validation(t):
    d = stats.describe(du.validation(both(t)), "ratio")
    return d.select("n", *(F.round(c, 6).alias(c) for c in d.columns if c != "n"))


@query(f"""WITH {BOTH} SELECT o_orderkey || '_' || o_orderstatus AS id, o_orderkey || '' AS task, o_orderpriority AS file, planned_days, actual_days
    FROM orders LEFT JOIN both_ ON id = o_orderkey WHERE o_orderstatus IN ('P', 'F')""")
def product_table(t):
    res = t.orders.where(F.col("o_orderstatus").isin("P", "F")).select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    meta = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("file"))
    b = once(both(t))
    out = du.product_table(res, meta, b.select("id", "planned_days"), b.select("id", "actual_days"))
    full = du.composite_id("id", "o_orderstatus")
    return out.select(full.alias("id"), du.without_last_suffix(full).alias("task"), "file", "planned_days", "actual_days")


@query("""SELECT id, CASE WHEN k = 0 THEN 'dd/MM/yyyy' ELSE 'yyyy-MM-dd' END AS form, CAST(o_orderdate AS TIMESTAMP) AS parsed FROM (SELECT o_orderkey AS id, o_orderkey % 2 AS k, o_orderdate FROM orders)""")
def date_forms(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = t.orders.select(F.col("o_orderkey").alias("id"), text.alias("d"))
    return o.select("id", dates.date_format(F.col("d")).alias("form"), dates.parse_date(F.col("d")).alias("parsed"))


@query(f"""WITH {TASKS}, s AS (SELECT cluster, count(*) AS tasks, CAST(trunc(avg(100 * ({RATIO} - 1))) AS INTEGER) AS overrun FROM tasks GROUP BY cluster)
    SELECT cluster, tasks, overrun, CAST(row_number() OVER (ORDER BY overrun DESC, cluster) AS INTEGER) AS place FROM s""")
def clusters_by_overrun(t):
    x = once(tasks(t))
    c = drilldown.annotate(x).select("cluster", "tasks").join(drilldown.mean_overrun(x), "cluster")
    ranked = stats.global_row_id(c.select((-F.col("overrun")).alias("fall"), "cluster", "tasks", "overrun"), ["fall", "cluster"])
    return ranked.select("cluster", "tasks", "overrun", F.col("row_id").cast("int").alias("place"))


@query("""SELECT s.label AS label, CAST(count(*) AS BIGINT) AS size FROM (SELECT o_custkey AS label FROM orders) s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5""")
def size_band(t):
    sizes = t.orders.groupBy(F.col("o_custkey").alias("label")).agg(F.count(F.lit(1)).alias("size"))
    return tb.size_band(sizes, 2, 5)


@query("""SELECT count(*) FILTER (WHERE n = 1) AS orphans FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def orphans(t):
    return drilldown.orphans(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("size")))


@query(f"""WITH {BOTH} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM both_)""")
def tasks_without_dates(t):
    return tb.excluding(t.orders.select(F.col("o_orderkey").alias("id")), both(t), "id")


@query(f"""WITH {BOTH} SELECT id, planned_days FROM both_ WHERE id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def planned_of_members(t):
    members = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return tb.within(both(t).select("id", "planned_days"), members, "id")


@query("SELECT CAST(count(*) AS BIGINT) AS missing FROM (SELECT o_orderkey FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL)")
def missing_durations(t):
    joined = t.orders.select(F.col("o_orderkey").alias("id")).join(both(t), "id", "left")
    return tb.any_missing(joined, ["planned_days", "actual_days"]).agg(F.count(F.lit(1)).alias("missing"))
