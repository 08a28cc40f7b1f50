"""Updates of stored Parquet tables by copy on write.

Only partitions that hold a row of the predicate are written anew.  Their new files are staged beside the
table; a manifest then says that they are complete, and each partition is swapped by renaming.  Before the
manifest an interrupted update leaves the old rows; after it the next call carries the swap on.  Readers
skip the staging folder, as its name begins with an underscore.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taskweft.operators.tables import updated

_STAGE, _DONE = "_update-", "_complete"


class _Folder:
    """A folder on the file system of Spark's paths."""

    def __init__(self, spark: SparkSession, path: str):
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self._new(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        at = self._new(f"{self.root}/{below}")
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def exists(self, below: str) -> bool:
        return self.fs.exists(self._new(f"{self.root}/{below}"))

    def delete(self, below: str) -> None:
        self.fs.delete(self._new(f"{self.root}/{below}"), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self._new(f"{self.root}/{old}"), self._new(f"{self.root}/{new}")):
            raise OSError(f"cannot rename {old} to {new} in {self.root}")

    def touch(self, below: str) -> None:
        self.fs.create(self._new(f"{self.root}/{below}")).close()


def recover(spark: SparkSession, path: str) -> None:
    """Carry a complete update on, drop an incomplete one."""
    folder = _Folder(spark, path)
    for stage in [n for n in folder.names() if n.startswith(_STAGE)]:
        if folder.exists(f"{stage}/{_DONE}"):
            for part in folder.names(f"{stage}/new"):
                if "=" in part:
                    if folder.exists(part):
                        folder.delete(part)
                    folder.rename(f"{stage}/new/{part}", part)
        folder.delete(stage)


def update(spark: SparkSession, path: str, partition: str, where: Column, values: dict[str, Column]) -> int:
    """Set columns in the rows where the predicate is true; the number of partitions written anew.

    The table is partitioned by one column, which is not among ``values``.  A null predicate changes nothing;
    rows with a null partition value are a partition of their own.
    """
    if partition in values:
        raise ValueError("a row cannot move to another partition")
    recover(spark, path)
    table = spark.read.parquet(path)
    touched = table.where(where).select(partition).distinct()
    rows = table.join(touched.withColumnRenamed(partition, "_touched"), F.col(f"`{partition}`").eqNullSafe(F.col("_touched")), "left_semi")
    stage = f"{_STAGE}{uuid.uuid4().hex[:12]}"
    updated(rows, F.coalesce(where, F.lit(False)), values).write.partitionBy(partition).parquet(f"{path.rstrip('/')}/{stage}/new")
    folder = _Folder(spark, path)
    count = sum("=" in n for n in folder.names(f"{stage}/new"))
    folder.touch(f"{stage}/{_DONE}")
    recover(spark, path)
    return count


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table, after carrying on an update that was interrupted."""
    recover(spark, path)
    return spark.read.parquet(path)
