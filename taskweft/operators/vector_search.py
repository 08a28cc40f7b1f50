"""Exact nearest vectors of a query set against all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskweft.operators.tables import top_per_group

#: Queries and rows in a block.
QUERIES, ROWS = 512, 4096


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    count = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).alias(name)).agg(F.collect_list(F.struct("id", "vec")).alias(f"{name}_rows"))


def nearest(queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, digits: int = 9) -> DataFrame:
    """(query, id, score, rank): the k rows of largest cosine for each query, itself left out. Both (id, vec).

    Each block of queries meets each block of rows in one matrix product, which returns k rows a query at
    most, above ``floor`` if there is one.  Equal scores, to ``digits``, rank by id.  Null and zero vectors have no cosine and are left out.
    """
    there = lambda df: df.where("vec is not null").where(F.exists("vec", lambda x: x != 0))
    kind = dict(rows.dtypes)["id"]
    pairs = _blocks(there(queries), QUERIES, "q").crossJoin(_blocks(there(rows), ROWS, "r"))  # of blocks, not of rows

    def unit(block):
        m = block.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1)
        return block.field("id").to_numpy(zero_copy_only=False), m / np.linalg.norm(m, axis=1, keepdims=True)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (qid, q), (rid, r) = unit(batch.column(0)[i].values), unit(batch.column(1)[i].values)
                score = np.round(q @ r.T, digits)
                score[qid[:, None] == rid[None, :]] = -np.inf
                if floor is not None:
                    score[score <= floor] = -np.inf
                order = np.argsort(rid, kind="stable")  # equal scores by id
                best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
                at = np.arange(len(qid))[:, None]
                found = np.isfinite(score[at, best])
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qid[:, None], best.shape)[found]), pa.array(rid[best][found]), pa.array(score[at, best][found])], names=["query", "id", "score"])

    met = pairs.select("q_rows", "r_rows").mapInArrow(run, f"query {kind}, id {kind}, score double")
    return top_per_group(met, ["query"], [F.desc("score"), "id"], k)
