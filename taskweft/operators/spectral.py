"""Spectral clustering of a similarity graph that is a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskweft.plans.scratch import Scratch

#: Directions smaller than this, beside the first of their block, add nothing to the basis.
NOTHING = 1e-10


def _gram(rows: DataFrame, column: str, width: int) -> np.ndarray:
    """The products of all pairs of coordinates, summed over rows; each task returns one matrix of width x width."""

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select(column).mapInArrow(run, "i int, row array<double>")
    summed = parts.groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(width))).alias("row")).collect()  # width rows
    return np.array([r.row for r in sorted(summed, key=lambda r: r.i)])


def _turned(rows: DataFrame, column: str, by: np.ndarray) -> DataFrame:
    """Each row's coordinates times a small matrix."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(by)) @ by
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", column])

    return rows.select("id", column).mapInArrow(run, f"id long, {column} array<double>")


def leading_vectors(pairs: DataFrame, k: int, steps: int = 8, tolerance: float = 1e-6, seed: int = 5) -> tuple[DataFrame, np.ndarray]:
    """((id, v), values): the k leading eigenvectors of the graph's normalised adjacency, by block Lanczos.

    pairs: (src long, dst long, weight), each pair once or more (weights add), in any order.  The basis is a
    table with a row for each node; a step multiplies its last block by the edges (a join and a sum by node),
    makes it orthogonal to the basis, and appends what is new.  Only matrices of the basis's width come to
    the driver.  It stops after ``steps``, when a block adds nothing, or when the leading values stand still.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "spectral")
    one = pairs.where("src <> dst and weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    edges = scratch.cut(edges)
    degree = scratch.cut(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")))
    side = lambda c: degree.select(F.col("id").alias(c), F.sqrt("degree").alias(f"root_{c}"))
    even = scratch.cut(edges.join(side("src"), "src").join(side("dst"), "dst").select("src", "dst", (F.col("weight") / (F.col("root_src") * F.col("root_dst"))).alias("weight")))
    n = degree.count()
    block = min(n, k + 2)
    start = [F.sqrt("degree"), *(F.xxhash64("id", F.lit(seed + j)) / F.lit(2.0**63) for j in range(1, block))]
    basis = scratch.cut(_orthonormal(degree.select("id", F.array(*start).alias("v")), "v", block))
    width, fresh, last = len(basis.first()["v"]), None, None
    images = scratch.cut(_image(even, basis, "v", range(width)))  # the adjacency times each basis vector
    values = np.zeros(0)
    for _ in range(steps):
        whole = basis.join(images, "id").select("id", F.concat("v", "w").alias("x"))
        g = _gram(whole, "x", 2 * width)
        inner = (g[:width, width:] + g[width:, :width].T) / 2
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:k]
        values, turn = values[order], turn[:, order]
        if last is not None and len(last) == len(values) and np.abs(values - last).max() < tolerance:
            break
        last = values
        # what the images hold beyond the basis, orthogonal among themselves
        beyond = g[width:, width:] - inner.T @ inner
        size, ways = np.linalg.eigh((beyond + beyond.T) / 2)
        keep = np.argsort(-size)[:block]
        keep = keep[size[keep] > NOTHING * max(1.0, size.max())]
        if not len(keep) or width + len(keep) > n:
            break
        scale = ways[:, keep] / np.sqrt(size[keep])
        new = _turned(whole, "x", np.vstack([-inner @ scale, scale])).withColumnRenamed("x", "new")
        grown = scratch.cut(_orthonormal(basis.join(new, "id").select("id", F.concat("v", "new").alias("v")), "v", width + len(keep)))
        fresh = len(grown.first()["v"])
        scratch.drop(basis, images)
        basis, width = grown, fresh
        images = scratch.cut(_image(even, basis, "v", range(width)))
        turn = None
    if turn is None:  # the last step grew the basis
        g = _gram(basis.join(images, "id").select(F.concat("v", "w").alias("x")), "x", 2 * width)
        inner = (g[:width, width:] + g[width:, :width]) / 2
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:k]
        values, turn = values[order], turn[:, order]
    return _turned(basis, "v", turn), values


def _orthonormal(rows: DataFrame, column: str, width: int) -> DataFrame:
    """Coordinates turned so that their products are the identity; directions that depend on others go."""
    g = _gram(rows, column, width)
    size, ways = np.linalg.eigh(g)
    keep = size > NOTHING * size.max()
    return _turned(rows, column, ways[:, keep] / np.sqrt(size[keep]))


def _image(edges: DataFrame, basis: DataFrame, column: str, places) -> DataFrame:
    """(id, w): the edges times the basis."""
    met = edges.join(basis.withColumnRenamed("id", "dst"), "dst")
    return met.groupBy(F.col("src").alias("id")).agg(F.array(*(F.sum(F.col("weight") * F.col(column)[j]) for j in places)).alias("w"))


def spectral_labels(pairs: DataFrame, k: int, steps: int = 8, seed: int = 5) -> DataFrame:
    """(id, label): k-means on the rows of the leading eigenvectors, each row scaled to length 1.

    pairs: (src long, dst long, weight).  Nodes without an edge of positive weight are absent.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors, _ = leading_vectors(pairs, k, steps, seed=seed)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = Scratch(pairs.sparkSession, "spectral-rows").cut(vectors.select("id", F.transform("v", lambda x: F.when(length > 0, x / length).otherwise(0.0)).alias("v")))
    points = rows.withColumn("features", array_to_vector("v"))
    return KMeans(k=k, seed=seed, initSteps=5, maxIter=30).fit(points).transform(points).select("id", F.col("prediction").alias("label"))
