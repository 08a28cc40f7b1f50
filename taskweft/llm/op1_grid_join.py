"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other, also after projection onto
principal dimensions.  Equal vectors form one class.  The classes are sorted by their grid cells (edge eps)
on the leading principal dimensions and the sequence is cut into blocks; above the blocks stands a tree of
sequence intervals, each with its bounding box.  The join starts from the whole sequence against itself and
goes down the tree level by level, keeping the pairs of child intervals whose boxes are within eps; what is
farther apart is skipped with everything below it.  The pairs of blocks that remain are compared in double
precision, one matrix product a pair.  A task holds a few neighbouring blocks while the blocks that they are
paired with pass by, so pairs carry no content.

A pair of blocks returns one row for each vector that has a link: how many vectors it links with there, and
the smallest vector it is connected to within the two blocks.  So a group of n near copies gives rows in
proportion to n and its blocks, not to its n * n links, and no link is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from taskweft.llm.common import connect
from taskweft.plans.components import connected_components
from taskweft.plans.scratch import Scratch

#: Vectors in a block, and bytes of their components as doubles, at most.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: Blocks that a task holds while others pass by, and chunks of passing blocks.
HOLD, CHUNK = 8, 64
#: Principal dimensions whose cells order the sequence, and that the boxes span.
SORT_DIMS, BOX_DIMS = 4, 16
#: Children of an interval.
FANOUT = 8


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _groups(column: pa.Array):
    """Row numbers and matrix for each vector length."""
    sizes = np.diff(column.offsets.to_numpy()) if hasattr(column, "offsets") else np.array([], int)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, _matrix(column.take(pa.array(rows)))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame, width: int, rounds: int = 2) -> np.ndarray:
    """Leading principal axes of the unit vectors (shorter vectors padded); a (width, dims) matrix.

    Orthogonal iteration from a fixed start: each round multiplies the covariance with ``dims`` columns, so
    Spark sums ``width`` rows of ``dims`` numbers and the driver never holds more.  Any orthonormal columns
    give true lower bounds of distances, so rounds only sharpen the order.
    """
    dims = min(width, BOX_DIMS)
    axes = np.linalg.qr(np.random.default_rng(7).normal(size=(width, dims)))[0]
    for _ in range(rounds):

        def sums(batches, axes=axes):
            total, mean, n = np.zeros((width, dims)), np.zeros(width), 0
            for batch in batches:
                for k, _, m in _groups(batch.column(0)):
                    u = _unit(m)
                    total[:k] += u.T @ (u @ axes[:k])
                    mean[:k] += u.sum(axis=0)
                    n += len(u)
            columns = [pa.array(range(width), pa.int32()), pa.array(np.full(width, n)), pa.array(mean), *(pa.array(total[:, j]) for j in range(dims))]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "mean", *(f"x{j}" for j in range(dims))])

        parts = classes.select("vec").mapInArrow(sums, "i int, n long, mean double, " + ", ".join(f"x{j} double" for j in range(dims)))
        got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("mean").alias("mean"), *(F.sum(f"x{j}").alias(f"x{j}") for j in range(dims))).toPandas().sort_values("i")
        n, mean = float(got["n"].iloc[0]), got["mean"].to_numpy()
        moved = got[[f"x{j}" for j in range(dims)]].to_numpy() / n - np.outer(mean, mean @ axes) / n**2
        axes, scale, _ = np.linalg.svd(moved + 1e-12 * axes, full_matrices=False)  # by falling variance
    return axes


def _blocks(classes: DataFrame, axes: np.ndarray, eps: float, block: int, count: int) -> DataFrame:
    dims = axes.shape[1]
    sort_by = [f"c{k}" for k in range(min(SORT_DIMS, dims))]

    def project(batches):
        for batch in batches:
            vec = batch.column(2)
            p = np.zeros((len(vec), dims))
            size = np.zeros(len(vec), np.int32)
            for k, rows, m in _groups(vec):
                p[rows] = _unit(m) @ axes[:k]
                size[rows] = k
            cells = [pa.array(np.floor(p[:, k] / eps).astype(np.int32)) for k in range(len(sort_by))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), *cells, pa.array(p[:, 0]), pa.array(list(p), pa.list_(pa.float64()))], names=["rep", "copies", "vec", "size", *sort_by, "first", "p"])

    schema = T.StructType([classes.schema["rep"], classes.schema["copies"], classes.schema["vec"], T.StructField("size", T.IntegerType()), *(T.StructField(c, T.IntegerType()) for c in sort_by), T.StructField("first", T.DoubleType()), T.StructField("p", T.ArrayType(T.DoubleType()))])
    order = ["size", *sort_by, "first", "rep"]
    parts = max(1, math.ceil(count / (4 * block)))
    ordered = classes.select("rep", "copies", "vec").mapInArrow(project, schema).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches):
        part, number, held = TaskContext.get().partitionId(), 0, []

        def emit(rows: pa.Table):
            p = np.stack(rows.column("p").to_numpy(zero_copy_only=False))
            m = np.stack(rows.column("vec").combine_chunks().to_numpy(zero_copy_only=False))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()),
                    pa.array([number], pa.int64()),
                    pa.array([rows.column("size")[0].as_py()], pa.int32()),
                    pa.array([rows.column("rep").to_numpy().tobytes()], pa.binary()),
                    pa.array([rows.column("copies").to_numpy().tobytes()], pa.binary()),
                    pa.array([m.tobytes()], pa.binary()),
                    pa.array([p.min(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([p.max(axis=0).tolist()], pa.list_(pa.float64())),
                ],
                names=["part", "number", "size", "ids", "copies", "vecs", "lo", "hi"],
            )

        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held)
            while rows.num_rows:  # a block ends when it is full or the vector length changes
                sizes = rows.column("size").to_numpy()
                end = int(np.searchsorted(sizes, sizes[0], side="right"))
                if end < block and end == len(sizes):
                    break
                end = min(end, block)
                yield emit(rows.slice(0, end))
                number += 1
                rows = rows.slice(end)
            held = rows.to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield emit(rows)

    return ordered.select("rep", "copies", "vec", "size", "p").mapInArrow(pack, "part long, number long, size int, ids binary, copies binary, vecs binary, lo array<double>, hi array<double>")


def _near(eps: float, dims: int):
    gaps = [F.greatest(F.lit(0.0), F.col(f"xlo{k}") - F.col(f"yhi{k}"), F.col(f"ylo{k}") - F.col(f"xhi{k}")) for k in range(dims)]
    squares = sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])
    return squares <= eps * eps * (1 + 1e-9) + 1e-12


def _interval_pairs(leaves: DataFrame, eps: float, dims: int, top: int, scratch: Scratch) -> DataFrame:
    """(x, y) numbers of the blocks, x <= y, that may hold a link. leaves: (node, size, lo<k>, hi<k>)."""
    boxes = [*(f"lo{k}" for k in range(dims)), *(f"hi{k}" for k in range(dims))]
    levels = [leaves]
    while top > 0:
        below, top = levels[-1], top // FANOUT
        levels.append(
            scratch.cut(
                below.groupBy(F.expr(f"node div {FANOUT}").alias("node"))
                .agg(*(F.min(f"lo{k}").alias(f"lo{k}") for k in range(dims)), *(F.max(f"hi{k}").alias(f"hi{k}") for k in range(dims)), F.min("size_lo").alias("size_lo"), F.max("size_hi").alias("size_hi"))
            )
        )
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda s: level.select(F.expr(f"node div {FANOUT}").alias(f"{s}up"), F.col("node").alias(s), *(F.col(c).alias(s + c) for c in (*boxes, "size_lo", "size_hi")))  # noqa: B023, E731
        x, y = side("x"), side("y")
        pairs = scratch.cut(
            pairs.join(x, pairs["a"] == x["xup"])
            .join(y, F.col("b") == y["yup"])
            .where((F.col("x") <= F.col("y")) & (F.col("xsize_lo") <= F.col("ysize_hi")) & (F.col("ysize_lo") <= F.col("xsize_hi")) & _near(eps, dims))
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
    return pairs


def meetings(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """The content of each block, once for each group of blocks that it meets: (g, c, turn, node, partners, size, ids, copies, vecs).

    A group is a run of HOLD blocks.  Its own blocks come first (turn 0) and stay in the task's memory; the
    blocks that they are paired with follow one by one (turn 1).  So a block travels once for HOLD pairs, and
    no row holds more than one.  Many partners are cut into chunks of CHUNK blocks, each with the group's blocks.
    """
    met = pairs.withColumns({"g": F.expr(f"a div {HOLD}"), "c": F.expr(f"b div {CHUNK}")})
    held = met.select("g", "c", F.lit(0).alias("turn"), F.col("a").alias("node"), F.array().cast("array<bigint>").alias("partners")).distinct()
    passing = met.groupBy("g", "c", F.col("b").alias("node")).agg(F.array_sort(F.collect_list("a")).alias("partners")).select("g", "c", F.lit(1).alias("turn"), "node", "partners")
    rows = held.unionByName(passing).join(blocks, "node")
    return rows.repartition("g", "c").sortWithinPartitions("g", "c", "turn", "node").select("g", "c", "turn", "node", "partners", "size", "ids", "copies", "vecs")


def compare_blocks(met: DataFrame, floor: float, kind) -> DataFrame:
    """(rep, n, root): links of each vector found in a pair of blocks. met: rows of ``meetings`` in their order."""

    def run(batches):
        group, held = None, {}
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for r in range(batch.num_rows):
                if (of := (column["g"][r].as_py(), column["c"][r].as_py())) != group:
                    group, held = of, {}
                raw = lambda k, t: np.frombuffer(column[k][r].as_buffer(), t)  # noqa: B023, E731
                node = column["node"][r].as_py()
                block = raw("ids", np.int64).copy(), raw("copies", np.int64).copy(), raw("vecs", kind).reshape(-1, column["size"][r].as_py()).copy()
                if column["turn"][r].as_py() == 0:
                    held[node] = block
                    continue
                ids_b, copies_b, v = block
                v = _unit(v.astype(np.float64))
                for at in column["partners"][r].as_py():
                    same, (ids_a, copies_a, u) = at == node, held[at]
                    if u.shape[1] != v.shape[1]:
                        continue
                    hits = (v if same else _unit(u.astype(np.float64))) @ v.T >= floor
                    if same:
                        np.fill_diagonal(hits, False)
                    at_a, at_b = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
                    if not len(at_a):
                        continue
                    hits = hits[np.ix_(at_a, at_b)]
                    root_a, root_b = connect(hits, ids_a[at_a], ids_b[at_b], same)
                    weigh = hits.astype(np.float64)
                    out = [(ids_a[at_a], weigh @ copies_b[at_b], root_a)]
                    if not same:
                        out.append((ids_b[at_b], copies_a[at_a] @ weigh, root_b))
                    for ids, n, root in out:
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.rint(n).astype(np.int64)), pa.array(root)], names=["rep", "n", "root"])

    return met.mapInArrow(run, "rep long, n long, root long")


def linked_vectors(df: DataFrame, min_cosine: float = 0.95, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``df``.

    Two vectors link when their cosine, in double precision, is at least ``min_cosine`` (above 0).
    ``n_links`` counts the other vectors linked directly, equal ones included; ``component_id`` is the
    smallest vec_id reachable by links, itself included; ``kept`` is ``vec_id = component_id``.  Vectors
    that are null, empty, zero, or hold null or non-finite components link with nothing, as do vectors of
    different lengths with each other; lengths are not bounded, and a block of long vectors holds fewer.  Rows that repeat a vec_id with the same vector count as
    copies; with another vector they share their links.  A row without vec_id links with nothing: 0 links, null component, not kept.  An empty table
    gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "grid")
    eps = math.sqrt(2 - 2 * min_cosine)
    single = df.schema[vec_col].dataType == T.ArrayType(T.FloatType(), df.schema[vec_col].dataType.containsNull) if isinstance(df.schema[vec_col].dataType, T.ArrayType) else False
    kind = np.float32 if single else np.float64  # singles are moved as they are and compared as doubles
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vec"))
    usable = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = rows.withColumn("vec", F.when(F.col("vec_id").isNotNull() & usable, F.transform("vec", lambda x: x + F.lit(0.0).cast("float" if single else "double"))))
    classes = scratch.cut(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not facts["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    axes = principal_axes(classes, facts["width"])
    block = min(block, max(16, BLOCK_BYTES // (8 * facts["width"])))
    blocks = scratch.cut(_blocks(classes, axes, eps, block, facts["n"]))
    last = blocks.agg(F.max("part").alias("part"), F.max("number").alias("number")).first()
    per = last["number"] + 1
    node = (F.col("part") * per + F.col("number")).alias("node")
    dims = axes.shape[1]
    leaves = scratch.cut(blocks.select(node, F.col("size").alias("size_lo"), F.col("size").alias("size_hi"), *(F.col("lo")[k].alias(f"lo{k}") for k in range(dims)), *(F.col("hi")[k].alias(f"hi{k}") for k in range(dims))))
    pairs = _interval_pairs(leaves, eps, dims, last["part"] * per + last["number"], scratch)
    content = blocks.select(node, "size", "ids", "copies", "vecs")
    found = scratch.cut(compare_blocks(meetings(pairs, content), min_cosine, kind))

    to = connected_components(found.select("rep", "root"), scratch, "rep", "root", rows=found.count())
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    judged = scratch.cut(
        classes.join(counts, "rep", "left")
        .join(to.withColumnRenamed("id", "rep"), "rep", "left")
        .select("vec", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    scratch.drop(classes, blocks, found)
    component = F.coalesce("component", "vec_id")
    return rows.join(judged, "vec", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def oracle(min_cosine: float = 0.95, table: str = "embeddings") -> str:
    """DuckDB twin by comparing all with all."""
    return f"""
    WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {table}),
    ok AS (SELECT vec_id, v FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {min_cosine}),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    reach(a, b) AS (SELECT vec_id, vec_id FROM e WHERE vec_id IS NOT NULL UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept
    FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
    """
