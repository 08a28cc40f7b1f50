"""Completion messages as a stream: a log of numbered messages with offsets, and the results they announce.

A message is a small file ``<number>.json`` in a folder, on any file system that Arrow knows.  The reader
hands out ranges of numbers, so Spark's checkpoint knows what was processed: a failed batch is read again as
the same range, and a finished one is not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

#: Messages that one task reads at most.
PART = 1_000


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def numbers(folder: str) -> list[int]:
    """The numbers in the log, ascending; names that are no numbers are left alone."""
    from pyarrow import fs

    system, path = _files(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())


def publish(folder: str, experiment_id: str, body: str = "completed") -> int:
    """Append a message; its number. The file is written aside and then named, so no reader sees half of it. One publisher at a time."""
    system, path = _files(folder)
    system.create_dir(path, recursive=True)
    number = max(numbers(folder), default=0) + 1
    aside = f"{path}/{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(aside) as out:
        out.write(json.dumps({"experiment_id": experiment_id, "body": body}).encode())
    system.move(aside, f"{path}/{number:012d}.json")
    return number


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, drop: bool):
        self.folder, self.drop = folder, drop

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        return {"number": max(numbers(self.folder), default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        first, last = start["number"] + 1, end["number"]
        return [_Range(at, min(at + PART - 1, last)) for at in range(first, last + 1, PART)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        system, path = _files(self.folder)
        for number in range(partition.first, partition.last + 1):
            try:
                with system.open_input_stream(f"{path}/{number:012d}.json") as file:
                    message = json.loads(file.read())
            except FileNotFoundError:  # a number that was never used
                continue
            yield number, message.get("experiment_id"), message.get("body")

    def commit(self, end: dict) -> None:
        """Messages that a finished batch has read are not asked for again; with ``drop`` their files go."""
        if self.drop:
            system, path = _files(self.folder)
            for number in numbers(self.folder):
                if number < end["number"]:  # the last one stays: numbers go on from it
                    system.delete_file(f"{path}/{number:012d}.json")


class MessageSource(DataSource):
    """``spark.readStream.format("messages").option("path", folder)``: (number, experiment_id, body)."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "number long, experiment_id string, body string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("drop", "false") == "true")


def message_stream(spark: SparkSession, folder: str, drop: bool = False) -> DataFrame:
    spark.dataSource.register(MessageSource)
    return spark.readStream.format("messages").option("path", folder).option("drop", str(drop).lower()).load()


def run_results(spark: SparkSession, folder: str, results: DataFrame, target: str, state: str, drop: bool = False) -> StreamingQuery:
    """The results of all experiments announced since the last run: one folder for each batch below ``target``.

    results: (experiment_id, ...).  A batch that is run again overwrites its own folder, so a failure neither
    loses nor repeats a message.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.join(results, "experiment_id", "left").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return message_stream(spark, folder, drop).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
