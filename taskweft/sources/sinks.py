"""Writers: tables, database, documents, reports, and a notice once all is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskweft.operators.tables import safe_columns
from taskweft.functions.text import safe_name


def create_table(spark: SparkSession, name: str, columns: dict[str, str], database: str | None = None) -> str:
    """A Parquet table with safe names, unless it exists; returns its name."""
    full = ".".join(safe_name(p) for p in ([database] if database else []) + [name])
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{safe_name(database)}`")
    cols = ", ".join(f"`{safe_name(c)}` {t}" for c, t in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({cols}) USING parquet")
    return full


def append(df: DataFrame, table: str) -> None:
    """Rows by column name; values are data, never statement text."""
    target = df.sparkSession.table(table).columns
    safe_columns(df).select(target).write.mode("append").insertInto(table)


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict | None = None, mode: str = "append") -> None:
    df.write.jdbc(url, table, mode=mode, properties=properties or {})


def write_files(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True, escape='"') if kind == "csv" else writer.format(kind).save(path)


def result_document(clusters: DataFrame, planned: DataFrame, actual: DataFrame, files: DataFrame) -> DataFrame:
    """One JSON document (result) a cluster: key, members, durations and files. By its form a document gathers its cluster in one row.

    clusters: (cluster, key, id, name); planned, actual: (id, days); files: (id, file).
    """
    rows = clusters.join(planned, "id", "left").join(actual, "id", "left").join(files, "id", "left")
    member = F.struct("name", "id", "planned_days", "actual_days", "file")
    return rows.groupBy("cluster", "key").agg(F.array_sort(F.collect_list(member)).alias("members")).select("cluster", F.to_json(F.struct("key", "members")).alias("result"))


def parse_document(documents: DataFrame) -> DataFrame:
    """(cluster, key, name, id, planned_days, actual_days, file) again."""
    schema = "key string, members array<struct<name:string,id:string,planned_days:int,actual_days:int,file:string>>"
    d = documents.select("cluster", F.from_json("result", schema).alias("d"))
    return d.select("cluster", "d.key", F.explode("d.members").alias("m")).select("cluster", "key", "m.*")


def cluster_report(clusters: DataFrame, path: str) -> None:
    """A text file: each key with its names."""
    lines = clusters.groupBy("cluster", "key").agg(F.array_sort(F.collect_list("name")).alias("n"))
    lines.select(F.concat_ws("\n", F.concat(F.lit("# "), "key"), F.array_join("n", "\n")).alias("value")).write.mode("append").text(path)


def commit(write: Callable[[], None], notify: Callable[[str], None], experiment_id: str) -> None:
    """Write, then tell: no notice without a result."""
    write()
    notify(experiment_id)
