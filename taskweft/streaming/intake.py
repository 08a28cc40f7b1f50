"""New node files of a folder become cleaned tasks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from taskweft.sources.schedules import clean_tasks, decode, parse_nodes

FILES = "path string, modificationTime timestamp, length long, content binary"


def node_stream(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(FILES).load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), decode(F.col("content")).alias("text"))


def run_intake(spark: SparkSession, folder: str, target: str, state: str, notify: Callable[[int], None] | None = None) -> StreamingQuery:
    """Process what is there, then stop. A batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        clean_tasks(parse_nodes(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")
        if notify:
            notify(number)

    return node_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
