"""Every task query against its DuckDB twin."""

import math
import os
import re
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest

from taskweft.plans import catalog


def plain(v):
    if isinstance(v, list | np.ndarray):
        return tuple(plain(x) for x in v)
    if v is None or (not isinstance(v, str) and pd.isna(v)):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | float | np.integer | np.floating):
        return float(f"{v:.9g}")
    return str(v)


def rows(df, cols):
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sf, duck, name):
    got, want = catalog.queries()[name](spark, sf).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got, sorted(got.columns)), rows(want, sorted(want.columns))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6)) for p, q in zip(x, y, strict=True)), (x, y)


WITHOUT_SQL = {"best_clustering", "cluster_keys", "dendrogram_leaves", "leader_clusters", "merged_cluster_keys", "similar_names", "ward_clusters"}


def test_queries_without_sql():
    """Each of them has a plain version below; the naming itself has one in test_operators."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == WITHOUT_SQL


@pytest.fixture(scope="module")
def part_names(duck):
    return [r[0] for r in duck.sql("SELECT DISTINCT p_name FROM part ORDER BY 1").fetchall()]


def answer(spark, sf, name):
    return catalog.queries()[name](spark, sf).collect()


def test_leader_clusters(spark, sf, part_names):
    want, leaders = {}, []
    for n in part_names:
        lead = next((x for x in leaders if 0.7 < SequenceMatcher(None, x, n).ratio() < 1), None)
        leaders += [] if lead else [n]
        want[n] = lead or n
    assert {r.name: r.leader for r in answer(spark, sf, "leader_clusters")} == want


def test_similar_names(spark, sf, part_names):
    ratio = {n: SequenceMatcher(None, n, "small ring").ratio() for n in part_names}
    assert {r.name: r.score for r in answer(spark, sf, "similar_names")} == pytest.approx({n: x for n, x in ratio.items() if x >= 0.6})


def ward_steps(x):
    """(groups, height) after each merge, by the definition."""
    groups, out = [[i] for i in range(len(x))], []
    while len(groups) > 1:
        means, sizes = np.array([x[g].mean(0) for g in groups]), np.array([len(g) for g in groups])
        cost = 2 * np.outer(sizes, sizes) / np.add.outer(sizes, sizes) * ((means[:, None] - means[None, :]) ** 2).sum(-1)
        cost[np.tril_indices(len(groups))] = np.inf
        a, b = divmod(int(cost.argmin()), len(groups))
        groups = [*(g for i, g in enumerate(groups) if i not in (a, b)), groups[a] + groups[b]]
        out.append((groups, float(cost[a, b])))
    return out


def test_ward_queries(spark, sf, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    ids, steps = [r[0] for r in rows], ward_steps(np.array([r[1] for r in rows], float))
    got = pd.DataFrame([r.asDict() for r in answer(spark, sf, "ward_clusters")])
    for k in (5, 10, 20):
        want = {frozenset(ids[i] for i in g) for g in steps[len(ids) - k - 1][0]}
        assert {frozenset(g) for g in got[got.k == k].groupby("label").id.apply(list)} == want
    leaves = sorted(answer(spark, sf, "dendrogram_leaves"), key=lambda r: r.step)
    assert [r.height for r in leaves] == pytest.approx(sorted(h for _, h in steps)) and leaves[-1].leaves == len(ids)


def similar_groups(keys, least):
    """Clusters joined by keys whose edit ratio reaches ``least``, by the definition."""
    from tests.test_operators import lcs

    groups = [{c} for c in keys]
    for a in keys:
        for b in keys:
            if a < b and (keys[a] == keys[b] or 2 * lcs(keys[a], keys[b]) / (len(keys[a]) + len(keys[b])) >= least):
                x, y = (next(g for g in groups if c in g) for c in (a, b))
                if x is not y:
                    groups.remove(y)
                    x |= y
    return groups


def test_keys_against_plain_naming(spark, sf, duck):
    """Every key of the two queries from the step-by-step naming; a part with one name or no match gives the name."""
    from tests.test_operators import brute_key

    names = {}
    for c, n in duck.sql("SELECT p_type, p_name || ' - ' || p_type || ' ' || p_brand || '/' || p_size FROM part").fetchall():
        names.setdefault(c, []).append(n)
    got = {r.cluster: r.key for r in answer(spark, sf, "cluster_keys")}
    several = {c: brute_key(of) for c, of in names.items() if len({re.sub(r"\S*\d\S*", "<>", n) for n in of}) > 1}
    assert len(several) > 3 and {c: got[c] for c in several} == several
    names = {}
    for c, n in duck.sql("SELECT p_brand, p_name FROM part").fetchall():
        names.setdefault(c, []).append(n)
    first = {c: brute_key(of) for c, of in names.items()}
    assert all(first.values())
    want = {min(g): brute_key([n for c in g for n in names[c]]) for g in similar_groups(first, 0.9)}
    assert {r.cluster: r.key for r in answer(spark, sf, "merged_cluster_keys")} == want


def test_keys_cover_all_clusters(spark, sf, duck):
    kinds, brands = ({r[0] for r in duck.sql(f"SELECT DISTINCT {c} FROM part").fetchall()} for c in ("p_type", "p_brand"))
    keys = answer(spark, sf, "cluster_keys")
    assert {r.cluster for r in keys} == kinds and len(keys) == len(kinds) and all(r.key for r in keys)
    merged = answer(spark, sf, "merged_cluster_keys")
    assert sorted(c for r in merged for c in r.merged_from) == sorted(brands) and all(r.cluster == min(r.merged_from) for r in merged)
    best = answer(spark, sf, "best_clustering")
    n = duck.sql("SELECT count(*) FROM embeddings JOIN part ON vec_id = p_partkey").fetchall()[0][0]
    assert len({r.run_id for r in best}) == 1 and best[0].run_id in {int(n * p / 100) for p in (1, 2, 4)} and all(r.key for r in best)


def test_entry(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark).toPandas()
    assert len(got) and set(got.measure) == {"planned", "actual", "overrun", "percent_overrun"}
