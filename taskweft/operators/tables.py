"""Projections, filters, set operations and frame comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from taskweft.functions.text import safe_name


def project(df: DataFrame, headers: list[str]) -> DataFrame:
    """The headers in their order; a missing one is a null column."""
    return df.select(*((F.col(f"`{h}`") if h in df.columns else F.lit(None).cast("string").alias(h)) for h in headers))


def safe_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: safe_name(c) for c in df.columns})


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value other than blank in each of the columns."""
    for c in columns:
        df = df.withColumn(c, F.nullif(F.col(c), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c))
    return df.dropna(how="any", subset=columns)


def any_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns)))


def excluding(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column).distinct(), column, "left_anti")


def within(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(column), column, "left_semi")


def size_band(sizes: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    """Clusters of ``lo`` .. ``hi`` members, both included."""
    kept = sizes.where(F.col("size") >= lo)
    return kept if hi is None else kept.where(F.col("size") <= hi)


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_last_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """One row a key, from the last frame that has it."""
    tagged = stack_frames([f.withColumn("_turn", F.lit(i)) for i, f in enumerate(frames)])
    others = [c for c in tagged.columns if c not in (key, "_turn")]
    last = tagged.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("_turn", *others)).alias("_v"))
    return last.select(key, "_v.*")


def updated(df: DataFrame, where, values: dict) -> DataFrame:
    """Columns set to new values in the rows where the predicate is true; other rows as they are."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(f"`{c}`")).cast(df.schema[c].dataType) for c, v in values.items()})


def frame_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one frame only, as often as it has more of them: side ``left`` or ``right``."""
    b = b.select(a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def column_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    return {"left": sorted(set(a.columns) - set(b.columns)), "right": sorted(set(b.columns) - set(a.columns))}


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the smaller end first, each once."""
    return df.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *(c for c in df.columns if c not in (a, b))).dropDuplicates([a, b])


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", n).where(F.col("rank") <= k)
