import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from taskweft.llm.op1_grid_join import linked_vectors

NAN, INF = float("nan"), float("inf")


def brute(rows, floor):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in good}
    n = {i: 0 for i, _ in good}
    for a, (i, u) in enumerate(good):
        for b, (j, v) in enumerate(good):
            if a != b and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= floor:
                links[i].add(j)
                n[i] += 1
    out = []
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((i, n.get(i, 0), None if i is None else min(seen), i is not None and min(seen) == i))
    return sorted(out, key=repr)


def run(spark, rows, floor, block=4, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return sorted((tuple(r) for r in linked_vectors(df, floor, block=block).collect()), key=repr)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, -0.0]), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 1.0, 0.0]), (13, [1e-30, 0.0]), (14, [-1.0, -0.0])]
    assert run(spark, rows, 0.95) == brute(rows, 0.95)
    assert run(spark, [], 0.95) == []
    assert run(spark, [(4, None), (None, None)], 0.95) == brute([(4, None), (None, None)], 0.95)


def test_repeated_rows(spark):
    got = run(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], 0.95)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("block", [3, 16, 1000])
def test_random(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 12))
    rows = [(int(i), (centres[i % 6] * rng.uniform(0.5, 2) + rng.normal(0, 0.25, 12)).tolist()) for i in range(150)]
    assert run(spark, rows, 0.9, block, "double") == brute(rows, 0.9)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-3, 3).map(float), min_size=3, max_size=3), max_size=14))
def test_ties(spark, vectors):
    rows = list(enumerate(vectors))
    assert run(spark, rows, 0.8, 3, "double") == brute(rows, 0.8)


def test_clashing_columns_and_long_vectors(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 3000))
    rows = [(i, (base[i % 5] * (1 + i) + rng.normal(0, 0.05, 3000)).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.withColumns({c: F.lit("extra") for c in ("vec", "rep", "copies", "n", "component", "part", "number", "size", "node", "kept", "n_links")})
    want = brute(rows, 0.95)
    for frame in (df, clash):
        assert sorted((tuple(r) for r in linked_vectors(frame, 0.95, block=8).collect()), key=repr) == want


def test_held_blocks_meet_all_partners(spark, monkeypatch):
    """Many groups and chunks: every pair of blocks within reach is compared once."""
    from taskweft.llm import op1_grid_join as o

    monkeypatch.setattr(o, "HOLD", 2)
    monkeypatch.setattr(o, "CHUNK", 3)
    rng = np.random.default_rng(4)
    rows = [(int(i), (np.ones(6) + rng.normal(0, 0.3, 6)).tolist()) for i in range(200)]
    assert run(spark, rows, 0.97, 8, "double") == brute(rows, 0.97)
