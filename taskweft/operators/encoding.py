"""Models of the caller's choice, run on distinct texts in Arrow batches: one load a task, one call a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts of one call.
BATCH = 256


def _apply(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list]], name: str, kind: str) -> DataFrame:
    def run(batches):
        model = load()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                texts = batch.column(0).slice(at, BATCH)
                yield pa.RecordBatch.from_arrays([texts, pa.array(model(texts.to_pylist()), types[kind])], names=[column, name])

    types = {"array<double>": pa.list_(pa.float64()), "string": pa.string()}
    return df.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct().mapInArrow(run, f"`{column}` string, `{name}` {kind}")


def encode_texts(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(column, vec) of each distinct text. ``load`` is called once a task and returns texts -> matrix."""
    return _apply(df, column, lambda: lambda texts, model=load(): [np.asarray(v, float).tolist() for v in model(texts)], "vec", "array<double>")


def lemmas_of(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(column, lemma) of each distinct token. ``load`` is called once a task and returns tokens -> lemmas."""
    return _apply(df, column, load, "lemma", "string")
