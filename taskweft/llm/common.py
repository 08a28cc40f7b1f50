"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_rows(df: DataFrame, schema: str, fn: Callable, slice_rows: int = 512) -> DataFrame:
    """``mapInArrow`` where ``fn`` gets one list per column and returns one list (or Arrow array) per result column.

    Batches are cut into slices of ``slice_rows`` rows, so a worker holds a bounded number of texts.
    ``fn`` may be a factory marked ``per_task``: it is then called once a task, and its result per slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn() if getattr(fn, "per_task", False) else fn
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = work(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], types[n]) for n in names], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fields
    names = [f.name for f in fields]
    types = {f.name: to_arrow_type(f.dataType) for f in fields}
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, run: Callable, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` for frames whose columns may bear any name: columns go by their place meanwhile, as Spark's own takes dots apart."""
    names = [f.name for f in schema.fields]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])

    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    out = plain.mapInArrow(placed, T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)]))
    return out.toDF(*names)


def per_task(fn: Callable) -> Callable:
    fn.per_task = True
    return fn


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    name = stem
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def connect(hits: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column is connected to through hits; ``same``: both are the same ids."""
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        a2 = np.minimum(a, np.where(hits, b[None, :], big).min(axis=1, initial=big))
        if same:
            b2 = a2
        else:
            b2 = np.minimum(b, np.where(hits, a2[:, None], big).min(axis=0, initial=big))
        if (a2 == a).all() and (b2 == b).all():
            return a2, b2
        a, b = a2, b2
