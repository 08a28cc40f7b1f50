"""Counts, profiles, outliers, summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskweft.plans.scratch import Scratch


def dedupe_counts(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows, rows dropped. One pass, one shuffle."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).withColumn("dropped", F.col("rows_before") - F.col("rows_after"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def repeated(df: DataFrame, column: str) -> DataFrame:
    """(value, n, singletons): values seen more than once, with how many were seen once."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    once = n.agg(F.count_if(F.col("n") == 1).alias("singletons"))
    return n.where("n > 1").crossJoin(F.broadcast(once))  # one row by construction


def join_by(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null."""
    other = right.withColumnsRenamed({k: f"_{k}_other" for k in keys})
    return left.join(other, reduce(and_, (left[k].eqNullSafe(other[f"_{k}_other"]) for k in keys))).drop(*(f"_{k}_other" for k in keys))


def running_total(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """With ``before`` and ``total``: the sum of ``value`` in the group before a row in ``order``, and over the group.

    Rows are range-partitioned on group and order and written once, so that a group that holds most rows is
    spread over tasks and the numbers of the pieces stay what they are; a small table (a row for each piece)
    holds what comes before it.
    """
    pieces = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    pieces = Scratch(df.sparkSession, "running").cut(pieces)
    earlier = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("_run", F.coalesce(F.sum(value).over(earlier), F.lit(0)))
    sums = pieces.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    by_part = Window.partitionBy(*group)
    first = by_part.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("_offset"), F.sum("_sum").over(by_part).alias("total"))
    return join_by(local, offsets, ["_part", *group]).select(*df.columns, (F.col("_run") + F.col("_offset")).alias("before"), "total")


def exact_quantiles(df: DataFrame, column: str, shares: dict[str, float], key: list[str] | None = None) -> DataFrame:
    """(key..., <names of shares>): exact quantiles of the non-null values by linear interpolation; groups without any are absent.

    Values are counted where they lie, and the counts summed in order over ranges of values, so neither a
    group's rows nor its distinct values are ever gathered in one task.
    """
    key = key or []
    values = df.where(F.col(column).isNotNull()).groupBy(*key, F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    group = key or ["_all"]
    placed = running_total(values if key else values.withColumn("_all", F.lit(0)), group, ["v"], "c")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("c")), F.col("v")))

    ends = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("total") - 1)
        ends += [at(F.floor(place)).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi"), F.max(place - F.floor(place)).alias(f"_{name}_part")]
    found = placed.groupBy(*group).agg(*ends)
    return found.select(*key, *((F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in shares))


def size_stats(assignments: DataFrame, label: str = "label") -> DataFrame:
    sizes = assignments.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))  # far fewer rows: distinct sizes
    whole = counts.agg(F.sum("n").alias("num_clusters"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size"), F.percentile("size", F.lit(0.5), F.col("n")).alias("median_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"))
    return whole.select(F.coalesce("num_clusters", F.lit(0)).alias("num_clusters"), "mean_size", "median_size", "min_size", "max_size", (F.col("max_size") - F.col("min_size")).alias("size_range"))


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(name, coverage, uniques, percent_unique, type) of columns with any value; a null counts as one unique value.

    Exact unique counts shuffle every column's values; ``approximate`` counts by sketches in one pass.
    """
    columns = columns or df.columns
    n = F.count(F.lit(1))
    once = df.agg(n.alias("_n"), *(F.count(c).alias(f"c_{i}") for i, c in enumerate(columns)), *(((F.approx_count_distinct(c) if approximate else F.countDistinct(c)) + F.max(F.col(c).isNull().cast("int"))).alias(f"u_{i}") for i, c in enumerate(columns)))
    kinds = dict(df.dtypes)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), (F.col(f"c_{i}") / F.col("_n") * 100).alias("coverage"), F.col(f"u_{i}").alias("uniques"), (F.col(f"u_{i}") / F.col("_n") * 100).alias("percent_unique"), F.lit(kinds[c]).alias("type")) for i, c in enumerate(columns))))
    return once.where("_n > 0").select(rows.alias("r")).select("r.*").where("coverage > 0").orderBy(F.desc("coverage"), "name")


def without_empty_columns(df: DataFrame) -> DataFrame:
    """Columns with any value; one aggregate tells."""
    counts = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select([c for c in df.columns if counts[c]])


def summary_table(df: DataFrame, measures: list[str], key: str | None = None) -> DataFrame:
    """(measure, mean, median, std) per key: population deviation."""
    keys = [key] if key else []
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in measures))).alias("x")).select(*keys, "x.*").where("v is not null")
    moments = long.groupBy(*keys, "measure").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    medians = exact_quantiles(long, "v", {"median": 0.5}, [*keys, "measure"])
    return join_by(moments, medians, [*keys, "measure"]).select(*keys, "measure", "mean", "median", "std")


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row side by side; the second may be empty."""
    return one.withColumn("_one", F.lit(1)).join(other.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles, max."""
    moments = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    quartiles = exact_quantiles(df, column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return _beside(moments, quartiles).select("n", "mean", "std", "min", "p25", "p50", "p75", "max")


def _fences(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    q = exact_quantiles(df, column, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, key)
    return q.withColumns({"lower": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "upper": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})


def iqr_outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows strictly outside 1.5 interquartile ranges."""
    f = F.broadcast(_fences(df, column, []).select("lower", "upper"))  # one row
    return df.crossJoin(f).where((F.col(column) < F.col("lower")) | (F.col(column) > F.col("upper"))).select(df.columns)


def without_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are no outlier in any column; nulls are none."""
    joined = df
    for c in columns:
        one = _fences(df, c, []).select(F.col("lower").alias(f"_{c}_lo"), F.col("upper").alias(f"_{c}_hi"))
        joined = _beside(joined, F.broadcast(one))  # one row
    for c in columns:
        joined = joined.where(F.coalesce(F.col(c).between(F.col(f"_{c}_lo"), F.col(f"_{c}_hi")), F.lit(True)))
    return joined.select(df.columns)


def box_plot(df: DataFrame, key: str, column: str) -> DataFrame:
    """Per group: quartiles and whiskers, kept within the group's values."""
    edges = df.groupBy(key).agg(F.min(column).alias("least"), F.max(column).alias("most"))
    return join_by(_fences(df, column, [key]), edges, [key]).select(key, "q1", "q2", "q3", F.greatest("lower", "least").alias("lower"), F.least("upper", "most").alias("upper"))


def box_outliers(df: DataFrame, key: str, column: str) -> DataFrame:
    f = _fences(df, column, [key]).select(key, F.col("lower").alias("_lo"), F.col("upper").alias("_hi"))
    return df.join(f, key).where((F.col(column) > F.col("_hi")) | (F.col(column) < F.col("_lo"))).select(key, column)


def z_scores(df: DataFrame, column: str) -> DataFrame:
    """With ``z``: deviations from the mean in population deviations; null where that is 0."""
    m = F.broadcast(df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std")))  # one row
    return df.crossJoin(m).withColumn("z", F.when(F.col("_std") != 0, (F.col(column) - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


def max_within_z(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    return z_scores(df, column).where(F.col("z") <= limit).agg(F.max(column).alias("max_within"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, lo, hi, n) of equal widths; the last bin is closed."""
    edge = F.broadcast(df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1)))
    return df.where(F.col(column).isNotNull()).crossJoin(edge).groupBy(at.cast("int").alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def token_counts(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    return tokens.select(F.explode(column).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def typical_positions(tokens: DataFrame, column: str = "tokens", key: list[str] | None = None) -> DataFrame:
    """(key..., token, pos): the commonest position of each token; the smallest among equals."""
    key = key or []
    n = tokens.select(*key, F.posexplode(column).alias("pos", "token")).groupBy(*key, "token", "pos").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key, "token").agg(F.max_by("pos", F.struct(F.col("n"), -F.col("pos"))).alias("pos"))


def next_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def share_without(df: DataFrame, column: str) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(F.when(n > 0, F.round(100 * F.count_if(F.col(column).isNull()) / n, 1)).alias("percent_without"))


def threshold_sweep(pairs: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, mean, median) of the pairs that reach each threshold."""
    at = pairs.select(column, F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")).where(F.col(column) >= F.col("threshold"))
    means = at.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"))
    return means.join(exact_quantiles(at, column, {"median": 0.5}, ["threshold"]), "threshold").select("threshold", "n", "mean", "median")


def sequence_in_group(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """With ``code``: S<group>_<n>, counted from 0; a group that holds most rows is spread over tasks."""
    numbered = running_total(df.withColumn("_one", F.lit(1)), [group], order, "_one")
    return numbered.select(*df.columns, F.concat(F.lit("S"), F.col(group).cast("string"), F.lit("_"), F.col("before").cast("string")).alias("code"))


def global_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """With ``row_id`` from 1 in ``order``, without gathering the rows in one task (``running_total`` over nothing but order).

    Ties in ``order`` are broken by all columns.
    """
    keys = [*order, *(c for c in df.columns if c not in order)]
    ranged = Scratch(df.sparkSession, "numbers").cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return local.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_n") + F.col("_before")).alias("row_id"))  # a row a partition


def min_max_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns on 0 .. 1; a constant column becomes 0."""
    edges = F.broadcast(df.agg(*(F.min(c).alias(f"_{c}_lo") for c in columns), *(F.max(c).alias(f"_{c}_hi") for c in columns)))
    joined = df.crossJoin(edges)
    scaled = {c: F.when(F.col(f"_{c}_hi") == F.col(f"_{c}_lo"), 0.0).otherwise((F.col(c) - F.col(f"_{c}_lo")) / (F.col(f"_{c}_hi") - F.col(f"_{c}_lo"))) for c in columns}
    return joined.withColumns(scaled).select(df.columns)


def rescale(df: DataFrame, column: str, top: float = 2000.0, invert: bool = False) -> DataFrame:
    """Linear to 0 .. top, or top .. 0."""
    scaled = min_max_scale(df, [column])
    return scaled.withColumn(column, F.lit(top) * (1 - F.col(column)) if invert else F.lit(top) * F.col(column))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x, y, r) for each unordered pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("p")).select("p.*")
