"""Written tables that cut a plan's lineage.

An iterative operator writes each step as Parquet below the folder that the cluster names in
``spark.checkpoint.dir`` and reads it back.  Every executor sees that folder, so a lost executor costs a
re-read and not a re-run, and the re-read table has a known size, so Catalyst's own size check decides on
broadcasts.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders by application, for ``release``.
_ROOTS: dict[str, list[str]] = {}
_ASKED: dict[int, tuple[int, str]] = {}
_LOCK = Lock()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 1000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only on a local master (tests), ``ValueError`` on a cluster without one."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", "") or ""
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="taskweft-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def release(spark: SparkSession) -> int:
    """Delete all scratch tables of this session; how many folders went.

    For long sessions: call it once the frames that queries returned have been read, as they read those tables.
    """
    paths = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for root in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Small Arrow batches until the last of the threads that ask for them is done; then the session's own size."""
    with _LOCK:
        count, own = _ASKED.get(id(spark), (0, spark.conf.get(_BATCH)))
        _ASKED[id(spark)] = count + 1, own
        spark.conf.set(_BATCH, str(min(int(spark.conf.get(_BATCH)), rows)))
    try:
        yield
    finally:
        with _LOCK:
            count, own = _ASKED.pop(id(spark))
            if count > 1:
                _ASKED[id(spark)] = count - 1, own
            else:
                spark.conf.set(_BATCH, own)


class Scratch:
    """Tables of one operator run. ``cut`` writes and re-reads, ``drop`` removes what is no longer read.

    Tables that still feed the returned (lazy) DataFrame are removed by ``release`` or when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/taskweft-{name}-{uuid.uuid4().hex[:12]}"
        #: Each written table's frame, held so that its identity stays its own, and its folder.
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)
        path = self._path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def cut(self, df: DataFrame, *partition_by: str, rows: int | None = None, per_file: int = 200_000, per_file_rows: int = 0, batch: int = BATCH_ROWS) -> DataFrame:
        """Write and re-read. Rows pass to Python workers in small batches meanwhile: texts and sets can be wide.

        With ``rows``, a bound of the table's rows, the last stage has a task and a file for ``per_file`` of
        them (never more than the plan's partitions), so small steps do not write hundreds of tiny files.
        ``per_file_rows`` is the most that any file gets, for tables of wide rows; ``batch`` the rows of a batch.
        """
        self._n += 1
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_file)))
        path = f"{self.root}/{self._n:04d}"
        writer = df.write.option("compression", "zstd")
        if per_file_rows:
            writer = writer.option("maxRecordsPerFile", per_file_rows)
        with small_batches(self.spark, batch):
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete the tables behind frames that ``cut`` gave; other frames are left alone."""
        for df in frames:
            if id(df) in self.paths:
                p = self._path(self.paths.pop(id(df))[1])
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
