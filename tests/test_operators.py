import re
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from taskweft.functions import dates, similarity, text as tx
from taskweft.operators import cluster_metrics as cm
from taskweft.operators import features, naming, similarity_join as sj, spectral, stats, tables, ward, words_pairs
from taskweft.plans.components import connected_components
from taskweft.plans.run import run
from taskweft.plans.scratch import Scratch
from taskweft.sources.config import Config


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def normal(text):
    text = text.replace("&amp", "")
    for token in text.split(" "):
        tag = ("<name>" if re.search("[A-Za-z]", token) else "<number>") if re.search(r"\d", token) else "<name>" if re.search(tx.PUNCTUATION, token) else None
        if tag:
            text = text.replace(token, tag)
    return text.replace("<name> <name>", "<name>").replace("<number> <number>", "<number>")


NAMES = ["Install pump HP2 #026", "Ch 1 - Ch 10", "Site-Works, Ch.1", "a  b", "", "é à 3 x/y_z", "A1 A1 &amp B", "1 2 3", "Test (old) [new]/more"]


def test_normalize_and_tokens(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    got = {r.n: r for r in df.select("n", tx.normalize(F.col("n")).alias("x"), tx.tokenize(F.col("n")).alias("t")).collect()}
    for n in NAMES:
        assert got[n].x == normal(n)
        raw = [t.lower() for t in re.findall(tx.TOKEN, normal(n))]
        for mark in "/-+_":
            raw = [t for t in raw if mark not in t] + [p for t in raw if mark in t for p in t.split(mark)]
        assert got[n].t == [t for t in raw if len(t) > 1]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, tx.name_parts(lit("Dig - Lay (deep)/28"))) == ["Dig", "Lay", "deep", "28"]
    assert one(spark, tx.clean_key(lit("<name> - Pump, Test"))) == "Pump- Test"
    assert one(spark, tx.upper_map(F.array(lit("HVAC"), lit("Pump"), lit("DC")))) == {"Hvac": "HVAC", "Dc": "DC"}
    assert one(spark, tx.restore_upper(F.array(lit("Hvac"), lit("Pump")), tx.upper_map(F.array(lit("HVAC"))))) == ["HVAC", "Pump"]
    assert one(spark, tx.tokenize(lit("the pump and 12 pumps"), stop_words=tx.STOP_WORDS, unique=True)) == ["pump", "<number>", "pumps"]
    assert [one(spark, tx.is_float(lit(t))) for t in ("1.5", "1_0", "1d", "inf", ".")] == [True, True, False, True, False]
    assert [one(spark, tx.token_class(lit(t))) for t in ("5mm", "5m", "11kV", "Ab", "a.1", "a-")] == ["metric", "meters", "volts", "letters", "dotted", "other"]
    assert one(spark, tx.all_upper(lit(""))) and tx.safe_name("Best % ") == "best_perc"


def test_dates(spark):
    forms = ["23/02/2019", "2019-02-23", "2019/02/23", "23-02-2019", "Sat Feb 23 00:00:00 UTC 2019", "nonsense", ""]
    df = spark.createDataFrame([(f,) for f in forms], "d string").select("d", dates.parse_date(F.col("d")).alias("p"))
    got = {r.d: r.p for r in df.collect()}
    assert all(got[f] is not None and str(got[f])[:10] == "2019-02-23" for f in forms[:5]) and got["nonsense"] is None and got[""] is None
    half = one(spark, dates.whole_days(F.lit("2020-01-02 12:00:00").cast("timestamp"), F.lit("2020-01-02 00:00:00").cast("timestamp")))
    assert half == -1


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc ", max_size=6), min_size=2, max_size=6))
def test_edit_ratio(spark, words):
    pairs = list(combinations(words, 2))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity.edit_ratio(F.col("a"), F.col("b")).alias("x"), similarity.edit_ratio(F.col("b"), F.col("a")).alias("y")).collect():
        want = 2 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 1.0
        assert r.x == pytest.approx(want) and r.x == r.y and (r.x == 1) == (r.a == r.b)


def test_pairs_meet_by_length(spark):
    rng = np.random.default_rng(1)
    texts = sorted({"".join(rng.choice(list("ab"), n)) for n in rng.integers(1, 14, 60)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least in (0.5, 0.8, 1.0):
        want = {(a, b) for a, b in combinations(texts, 2) if 2 * lcs(a, b) / (len(a) + len(b)) >= least}
        assert {(r.t1, r.t2) for r in sj.edit_pairs(df, "t", least, skip_tags=False).collect()} == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 11), (5, 6), (6, 7), (7, 7), (9, 8), (None, 4), *((i, i + 1) for i in range(100, 160)), *((500, i) for i in range(501, 540))]
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark, "t")).collect()
    got = {r.id: r.component for r in rows}
    assert len(rows) == len(got)
    assert got == {2: 1, 3: 1, 11: 1, 6: 5, 7: 5, 9: 8} | {i: 100 for i in range(101, 161)} | {i: 500 for i in range(501, 540)}
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(*[st.text(st.sampled_from("abcé漢😀 "), max_size=150)] * 2), min_size=1, max_size=12))
def test_common_length(spark, pairs):
    """The expression equals the usual table, within one limb and beyond."""
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    for r in df.select("a", "b", similarity.lcs_length(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == (None if r.a is None or r.b is None else lcs(r.a, r.b))


@pytest.mark.parametrize("limbs", [61, 62, 63, 124, 125, 300])
def test_common_length_at_limbs(spark, limbs):
    rng = np.random.default_rng(limbs)
    rows = [("".join(rng.choice(list("ab漢"), limbs)), "".join(rng.choice(list("ab漢"), 90))) for _ in range(4)] + [("a" * limbs, "a" * limbs)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", similarity.lcs_length(F.col("a"), F.col("b")).alias("x"), similarity.lcs_length(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.y == lcs(r.a, r.b)


@pytest.mark.parametrize("least", [0.5, 0.7, 0.8, 0.9, 0.97])
def test_segment_join(spark, least):
    """All pairs at the ratio, texts too short to cut included, from few that meet."""
    rng = np.random.default_rng(21)
    texts = sorted({"".join(rng.choice(list("abc"), rng.integers(0, 13))) for _ in range(150)} | {f"install pump number {i}{'x' * (i % 3)}" for i in range(0, 300, 9)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = {(a, b): 2 * lcs(a, b) / (len(a) + len(b)) for a, b in combinations(texts, 2)}
    got = {(r.t1, r.t2): r.score for r in sj.edit_pairs(df, "t", least).collect()}
    assert got == pytest.approx({p: x for p, x in want.items() if x >= least})
    met = sj.segment_pairs(df, least).count()
    assert len(got) <= met <= len(want) and (least < 0.9 or met < len(want) / 8)


def test_text_components(spark):
    df = spark.createDataFrame([("eeaa",), ("aaaa",), ("aaab",), ("aaac",), (None,)], "t string")
    assert {r.text: r.component for r in sj.text_components(df, "t", 0.75).collect()} == {"eeaa": "eeaa", "aaaa": "aaaa", "aaab": "aaaa", "aaac": "aaaa"}


def test_leaders(spark):
    rng = np.random.default_rng(8)
    names = ["pump a", "pump b", "valve", "pump a", *("pump " + "".join(rng.choice(list("abc"), 3)) for _ in range(12))]
    want, leaders = {}, []
    for n in sorted(set(names)):
        lead = next((x for x in leaders if 0.7 < SequenceMatcher(None, x, n).ratio() < 1), None)
        leaders += [] if lead else [n]
        want[n] = lead or n
    rounds = []
    got = sj.leader_clusters(spark.createDataFrame([(n,) for n in names], "n string"), "n", 0.7, 1.0, rounds).collect()
    assert len(got) == len(want) and {r.name: r.leader for r in got} == want
    assert rounds[0] == len(want) and all(p > q for p, q in zip(rounds, rounds[1:], strict=False)) and len(rounds) < len(want)
    assert sj.leader_clusters(spark.createDataFrame([(None,)], "n string"), "n").count() == 0


def brute_ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        cost = {(a, b): len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum() for (a, p), (b, q) in combinations(enumerate(groups), 2)}
        a, b = min(cost, key=cost.get)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_ward(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = ward.ward_labels(df, [2, 5, 9]).toPandas()
    for k in (2, 5, 9):
        part = got[got.k == k]
        assert {frozenset(g) for g in part.groupby("label").id.apply(list)} == brute_ward(x, k)
    assert sorted(ward.leaf_counts(df).toPandas().leaves)[-1] == 40
    with pytest.raises(ward.TooManyClusters):
        ward.candidate_ks(10, [], 6)
    assert ward.candidate_ks(40, [2.5, 5, 20]) == [2, 8] and ward.result_name("ward", {"n": 3, "seed": 1}) == "ward_n_3"


def test_ward_in_rounds(spark):
    """Rounds of mutual nearest clusters give the merges, labels and heights of one task; equal vectors and ties included."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 3)) * 3
    x = [(centres[i % 6] + rng.normal(0, 0.4, 3)).tolist() for i in range(150)] + [[1.0, 2.0, 3.0]] * 30
    df = spark.createDataFrame([(3 * i + 1, v) for i, v in enumerate(x)], "id int, vec array<double>")
    rounds = []
    merges = ward.ward_merges(df, in_one_task=10, block=64, rounds=rounds).toPandas()
    assert len(merges) == len(x) - 1 and merges.b.is_unique and (merges.a < merges.b).all()
    assert rounds[0] == 151 and all(p > q for p, q in zip(rounds, rounds[1:], strict=False)) and len(rounds) < 40
    one = ward.merge_list(np.array(x))
    assert sorted(merges.height) == pytest.approx(sorted(h for _, _, h, _ in one), abs=1e-9) and merges["size"].max() == len(x)
    got = ward.ward_labels(df, [4, 30], in_one_task=60, block=64).toPandas()
    for k in (4, 30):
        part = got[got.k == k].sort_values("id")
        assert part.id.tolist() == [3 * i + 1 for i in range(len(x))] and part.label.tolist() == ward.cut(len(x), one, k).tolist()
    leaves = ward.leaf_counts(df, in_one_task=90, block=64).toPandas().sort_values("step")
    assert leaves.step.tolist() == list(range(len(x) - 1)) and leaves.height.is_monotonic_increasing and leaves.leaves.iloc[-1] == len(x)


def test_ward_rounds_with_ties(spark):
    """On a grid most costs are equal: a round still merges many pairs, and the heights add up to twice the sum of squares."""
    x = np.array([[i, j] for i in range(9) for j in range(9)], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    rounds = []
    merges = ward.ward_merges(df, in_one_task=8, block=32, rounds=rounds).toPandas()
    assert len(merges) == 80 and merges.b.is_unique and len(rounds) < 20
    assert merges.height.sum() == pytest.approx(2 * ((x - x.mean(axis=0)) ** 2).sum())
    alone = sorted(ward.merge_rounds(x, np.ones(81), 8))
    assert [m[:2] for m in alone] == sorted(zip(merges.a, merges.b, strict=True)) and sorted(h for _, _, h, _ in alone) == pytest.approx(sorted(merges.height))


@pytest.mark.parametrize("kind", ["even", "weighted", "far", "large", "ties"])
def test_nearest_rows(kind):
    """The screening by matrix products loses no nearest row, ties included."""
    rng = np.random.default_rng(8)
    x = {"far": rng.normal(size=(90, 4)) + 1e6, "large": rng.normal(size=(90, 4)) * 1e25, "ties": rng.integers(0, 3, (90, 3)).astype(float)}.get(kind, rng.normal(size=(90, 5)))
    w = rng.integers(1, 9, 90).astype(float) if kind == "weighted" else np.ones(90)
    ids = 2 * np.arange(90) + 5
    cost, tie, nn = ward.nearest_rows(ids[::3], x[::3], w[::3], ids, x, w)
    for i in range(30):
        each = np.array([ward._costs(x[[3 * i]], w[[3 * i]], x[[j]], w[[j]])[0] if j != 3 * i else np.inf for j in range(90)])
        ties = ward._tie(np.full(90, ids[3 * i]), ids)
        j = min(np.flatnonzero(each == each.min()), key=lambda j: ties[j])
        assert (cost[i], tie[i], nn[i]) == (each[j], ties[j], ids[j])


def test_leaves_of_many_rows(spark):
    """6,000 rows make no rounds of written tables and no matrix of all pairs, and the merges are those of the matrix."""
    x = np.random.default_rng(9).normal(size=(6000, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "vec": x.tolist()}), "id long, vec array<double>")
    rounds, one = [], ward.merge_list(x)
    merges = ward.ward_merges(df, rounds=rounds).toPandas().sort_values(["height", "a", "b"])
    assert rounds == [] and [(m[0], m[1], m[3]) for m in one] == list(zip(merges.a, merges.b, merges["size"], strict=True))
    leaves = ward.leaf_counts(df).toPandas().sort_values("step")
    assert leaves.height.tolist() == pytest.approx([m[2] for m in one]) and leaves.leaves.tolist() == [m[3] for m in one]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(g, v) for g, n in (("a", 1), ("b", 10), ("c", 57), (None, 8)) for v in rng.integers(0, 9, n).tolist()] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v int")
    shares = {"lo": 0.0, "q": 0.25, "m": 0.5, "x": 0.93, "hi": 1.0}
    got = {r.g: r for r in stats.exact_quantiles(df, "v", shares, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        v = [v for k, v in rows if k == g and v is not None]
        assert [got[g][n] for n in shares] == pytest.approx([np.quantile(v, s) for s in shares.values()])
    assert "d" not in got
    whole = stats.exact_quantiles(df, "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [np.median([v for _, v in rows if v is not None])]
    assert stats.exact_quantiles(df.limit(0), "v", {"m": 0.5}).count() == 0 and stats.describe(df.limit(0), "v").first().n == 0
    assert stats.without_outliers(df.limit(0), ["v"]).count() == 0 and stats.without_outliers(df, ["v"]).count() == len(rows)


def test_metrics_are_label_free_and_guarded(spark):
    x = np.random.default_rng(4).normal(size=(30, 2))
    make = lambda labels: spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))], "id long, label int, vec array<double>")
    labels = np.arange(30) % 3
    a, b = (cm.ch_index(cm.sums_of_squares(make(c), 2)).first().ch_index for c in (labels, 2 - labels))
    assert a == pytest.approx(b)
    same = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [2.0])], "id long, label int, vec array<double>")
    assert cm.ch_index(cm.sums_of_squares(same, 1)).first().ch_index == 1.0
    assert [r.silhouette for r in cm.silhouettes(same).collect()] == [0.0, 0.0]
    blocks = {r.id: r.silhouette for r in cm.silhouettes(make(labels), block=7).collect()}
    whole = {r.id: r.silhouette for r in cm.silhouettes(make(labels)).collect()}
    assert blocks == pytest.approx(whole)


def test_vote_and_scale(spark):
    runs = spark.createDataFrame([(3, 1.0, 5.0), (1, 1.0, 5.0), (2, 1.0, 1.0)], "run_id int, flat double, good double")
    best = cm.vote(runs, {"flat": ("min", 1.0), "good": ("max", 2.0)}).first()
    assert (best.run_id, best.total) == (1, 3.0)


def test_words_pairs(spark):
    names = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a"]), (1, 3, ["a"]), (2, 4, ["z"])], "cluster int, id int, tokens array<string>")
    scores = spark.createDataFrame([("a", "b", 0.5)], "t1 string, t2 string, score double")
    got = {r.cluster: r.score for r in words_pairs.cluster_scores(names, scores).collect()}
    assert got == {1: pytest.approx((1.5 + 1.5 + 1.0) / (3 + 3 + 2))}


def test_features(spark):
    df = spark.createDataFrame([("a", "m1", "F1", 1.0), ("a", "m2", "F2", 2.0), ("b", "m1", "F1", 4.0)], "k string, m string, f string, v double")
    s = features.Selection("k", "v", {"m": ["m1"]})
    features.validate(df, [s])
    assert {r.k: r.total for r in features.feature_sum(df, s).collect()} == {"a": 1.0, "b": 4.0}
    for bad in ([s] * 3, [features.Selection("k", "v", {"m": ["no"]})], [features.Selection("x", "v")]):
        with pytest.raises(features.InvalidSelection):
            features.validate(df, bad)
    assert features.table_for("x", 2020, {("x", None): "t"}) == "t"


def test_stats_edges(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert stats.dedupe_counts(empty).first().rows_before == 0
    assert stats.profile(empty).count() == 0 and stats.next_id(empty, "a").first().next_id == 1
    some = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "a int, b string")
    assert {r.name: r.uniques for r in stats.profile(some).collect()} == {"a": 2, "b": 2}
    assert stats.without_empty_columns(some.withColumn("c", F.lit(None).cast("int"))).columns == ["a", "b"]
    assert stats.typical_positions(spark.createDataFrame([(["x", "y"],), (["y", "x"],)], "tokens array<string>")).where("token = 'x'").first().pos == 0


def test_tables(spark):
    a = spark.createDataFrame([(1, "p"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "q"), (3, "r")], "k int, v string")
    assert {(r.k, r.v) for r in tables.merge_last_wins([a, b], "k").collect()} == {(1, "p"), (2, "q"), (3, "r")}
    assert tables.project(a, ["v", "missing"]).columns == ["v", "missing"]
    assert tables.column_difference(a, b.withColumn("z", F.lit(1))) == {"left": [], "right": ["z"]}
    assert tables.safe_columns(a.withColumnRenamed("v", "A %b")).columns == ["k", "a_percb"]


def test_words_pairs_without_pairs(spark):
    """Totals by moments and best partners equal the sums over all pairs of names, repeats and empty names included."""
    rng = np.random.default_rng(9)
    voc = list("abcdefg")
    names = [(c, i, [str(x) for x in rng.choice(voc, rng.integers(0, 5))]) for c in range(3) for i in range(8)] + [(7, 0, ["a"]), (8, 0, []), (8, 1, [])] + [(9, i, ["a", "b"]) for i in range(5)]
    score = {(a, b): round(float(rng.random()) * 1.3, 2) for a, b in combinations(voc, 2) if rng.random() < 0.7}
    s = lambda x, y: 1.0 if x == y else score.get((min(x, y), max(x, y)), 0.0)
    df, sc = spark.createDataFrame(names, "cluster int, id int, tokens array<string>"), spark.createDataFrame([(a, b, v) for (a, b), v in score.items()], "t1 string, t2 string, score double")
    by, total, best = {}, {}, {}
    for c, _, t in names:
        by.setdefault(c, []).append(t)
    for c, of in by.items():
        pairs = list(combinations(of, 2))
        if pairs:
            total[c] = (sum(s(x, y) for a, b in pairs for x in a for y in b), sum(len(a) + len(b) for a, b in pairs), sum(map(len, of)))
            tops = [max(s(x, y) for y in b) for p in pairs for a, b in (p, p[::-1]) if b for x in dict.fromkeys(a)]
            if tops:
                best[c] = sum(tops) / len(tops)
    assert {r.cluster: r.score for r in words_pairs.cluster_scores(df, sc).collect()} == pytest.approx({c: v / n if n else 0.0 for c, (v, n, _) in total.items()})
    assert words_pairs.mean_cluster_score(df, sc).first()[0] == pytest.approx(np.mean([v / n for v, _, n in total.values() if n]))
    assert {r.cluster: r.score for r in words_pairs.max_per_token(df, sc).collect()} == pytest.approx(best)


def brute_key(names, cutoff=0.8):
    """The key of one cluster, step by step over its distinct normalised names."""
    tokens = lambda t, lower=True: list(dict.fromkeys(x for x in ((y.lower() if lower else y) for y in re.findall(tx.TOKEN, normal(t))) if len(x) > 1 and not re.search(r"\d", x) and x.lower() not in ("inf", "nan", "infinity")))
    parts, upper = {}, {}
    for name in sorted({normal(n) for n in names}):
        pieces = [p for p in (p.strip() for p in re.split(r" - |/|\(|\)|\[|\]", name) if p) if p]
        for i, piece in enumerate(pieces):
            parts.setdefault(i, []).append(piece)
    out = []
    for i in sorted(parts):
        frags = parts[i]
        if len(frags) < 2:
            continue
        upper |= {t.capitalize(): t for f in frags for t in tokens(f, lower=False) if t.isalpha() and t.isupper()}
        score = lambda x, y: 1.0 if x == y else 0.0 if "<" in x + y else round(2 * lcs(x, y) / (len(x) + len(y)), 2)
        matches = []
        for a, b in combinations(frags, 2):
            ta, tb = tokens(min(a, b)), tokens(max(a, b))
            if a == b:
                matches.append(tuple(ta))
                continue
            short, long = (ta, tb) if len(ta) <= len(tb) else (tb, ta)
            best = []
            for x in short:
                ranked = [(score(x, y), j, y) for j, y in enumerate(long)]
                if ranked and max(ranked)[0] >= cutoff:
                    best.append(max(ranked)[2])
            matches.append(tuple(best))
        matches = [m for m in matches if m]
        if not matches:
            continue
        freq = {}
        for m in matches:
            for t in m:
                freq[t] = freq.get(t, 0) + 1
        median = np.median([len(f) for f in frags])
        best = max(matches, key=lambda m: (sum(freq[t] for t in m) * len(m) / median if median else 0, m))
        places = {}
        for f in frags:
            for pos, t in enumerate(tokens(f)):
                places.setdefault(t, {}).setdefault(pos, 0)
                places[t][pos] += 1
        place = {t: min(p, key=lambda k: (-p[k], k)) for t, p in places.items()}
        out.append(" ".join(w.capitalize() for w in sorted(set(best), key=lambda t: (place[t], t))))
    return " - ".join(" ".join(upper.get(w, w) for w in part.split(" ")) for part in out)


def test_naming(spark):
    """Keys equal the plain version's, with fragments of equal token counts and tokens that share a partner."""
    rng = np.random.default_rng(12)
    verbs, things, extra = ["Install", "Installs", "Remove"], ["cable", "cables cable", "cables", "pump", "HVAC", "duct"], ["near", "north", "gate", "shaft"]
    clusters = {}
    for c in range(8):
        clusters[c] = [f"{rng.choice(verbs)} {rng.choice(things)} " + " ".join(rng.permutation(extra)[: k // 2 % 3]) + f" - Level {k}{'AB'[k % 2]} part" for k in range(int(rng.integers(4, 7)))]
        clusters[c] = [re.sub(" +", " ", n) for n in clusters[c]]
    members = spark.createDataFrame([(c, n) for c, names in clusters.items() for n in names], "cluster int, name string")
    got = {r.cluster: r.key for r in naming.key_clusters(members).collect()}
    want = {c: brute_key(names) for c, names in clusters.items()}
    assert got == want
    assert any("HVAC" in k for k in got.values())


def test_naming_edges(spark):
    names = ["Install cable tray - Level 1", "Install cable tray - Level 2", "Install cables - Level 3"]
    members = spark.createDataFrame([(1, n) for n in names] + [(2, "Install cable trays - Level 9"), (3, "7"), (4, "Dig 1"), (4, "Dig 2")], "cluster int, name string")
    keys = naming.key_clusters(members)
    got = {r.cluster: r.key for r in keys.collect()}
    assert got[1].startswith("Install Cable") and set(got) == {1, 2, 3, 4} and all(got.values())
    assert got[4] == "Dig <number>"  # all names are one after normalising
    merged = naming.merge_similar(members, keys, None, 0.6).collect()
    assert sum(len(r.merged_from) for r in merged) == 4
    near = spark.createDataFrame([("cable", [0.0]), ("wire", [0.0]), ("pump", [9.0])], "token string, vec array<double>")
    pairs = spark.createDataFrame([("cable", "wire"), ("cable", "pump"), ("cable", "other")], "t1 string, t2 string")
    scored = {(r.t1, r.t2): r.score for r in words_pairs.token_scores(pairs, near).collect()}
    assert scored["cable", "wire"] == pytest.approx(2 * lcs("cable", "wire") / 9 + 1) and scored["cable", "other"] == pytest.approx(2 * lcs("cable", "other") / 10)


def plain_silhouettes(x, labels):
    d, out = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(-1)), []
    for i, own in enumerate(labels):
        mine = (labels == own) & (np.arange(len(x)) != i)
        others = [d[i][labels == o].mean() for o in set(labels) - {own}]
        out.append(0.0 if not mine.any() or not others else (min(others) - d[i][mine].mean()) / max(min(others), d[i][mine].mean()))
    return out


def test_silhouettes_of_runs(spark):
    """All runs from one pass over pairs of blocks; each is what it is alone."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(50, 3))
    labels = {k: rng.integers(0, k, 50) for k in (1, 2, 5, 40)}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    runs = spark.createDataFrame([(k, i, int(v)) for k, of in labels.items() for i, v in enumerate(of)], "k int, id long, label int")
    got = cm.run_silhouettes(vectors, runs, block=16).toPandas()
    assert len(got) == 200
    for k, of in labels.items():
        mine = got[got.k == k].sort_values("id")
        assert mine.label.tolist() == of.tolist() and mine.silhouette.tolist() == pytest.approx(plain_silhouettes(x, of))
    alone = cm.silhouettes(vectors.join(runs.where("k = 5"), "id").select("id", "label", "vec"), block=20).toPandas().sort_values("id")
    assert alone.silhouette.tolist() == pytest.approx(plain_silhouettes(x, labels[5]))


def test_silhouettes_leave_the_task_as_minima(spark, monkeypatch):
    """Nested clusterings: what leaves the comparison is a few rows for each vector and k, not one for each label; copies in several clusters are at 0."""
    rng = np.random.default_rng(18)
    x = rng.normal(size=(240, 3))
    fine = rng.permutation(240) // 3
    labels = {20: fine // 4, 80: fine}
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    runs = spark.createDataFrame([(k, i, int(v)) for k, of in labels.items() for i, v in enumerate(of)], "k int, id long, label int")
    cut, met = cm.Scratch.cut, []
    monkeypatch.setattr(cm.Scratch, "cut", lambda self, df, *a, **b: [out := cut(self, df, *a, **b), met.append(out.count()) if "other" in df.columns else 0][0])
    got = cm.run_silhouettes(vectors, runs, block=40).toPandas()
    assert len(met) == 1 and met[0] <= 240 * 2 * 12
    for k, of in labels.items():
        assert got[got.k == k].sort_values("id").silhouette.tolist() == pytest.approx(plain_silhouettes(x, of))
    copies = spark.createDataFrame([(i, [5.3, 0.1 + i // 20]) for i in range(40)], "id long, vec array<double>")
    split = spark.createDataFrame([(4, i, i // 10) for i in range(40)], "k int, id long, label int")
    assert [r.silhouette for r in cm.run_silhouettes(copies, split, block=16).collect()] == [0.0] * 40


def test_run(spark):
    rng = np.random.default_rng(5)
    kinds = ["dig trench", "lay cable", "test pump"]
    rows = [(i, f"{kinds[i % 3]} {i}", int(rng.integers(1, 9)), (np.eye(3)[i % 3] + rng.normal(0, 0.02, 3)).tolist()) for i in range(30)]
    tasks = spark.createDataFrame([r[:3] for r in rows], "id long, name string, planned_days int")
    vectors = spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, vec array<double>")
    out = run(tasks, vectors, Config(percents=(10.0, 20.0)).with_weights(mean_duration_std=0, words_pairs=5))
    assert out.best in (3, 6) and out.runs.count() == 2
    assert run(tasks, vectors, Config(num_clusters=3)).best == 3
    # the names of a cluster are one after normalising, so the key is that name
    assert {r.key for r in out.keys.collect()} == {"dig trench <number>", "lay cable <number>", "test pump <number>"}
    # the words-pairs metric sums all scores, whatever the cutoff of naming
    low = run(tasks, vectors, Config(percents=(10.0,), token_cutoff=0.1)).runs.first().words_pairs
    assert low == run(tasks, vectors, Config(percents=(10.0,), token_cutoff=0.99)).runs.first().words_pairs > 0


def test_spectral(spark):
    edges = [(i, j, 1.0) for g in (range(5), range(5, 10)) for i in g for j in g if i < j] + [(0, 5, 0.01)]
    got = {r.id: r.label for r in spectral.spectral_labels(spark.createDataFrame(edges, "src long, dst long, weight double"), 2).collect()}
    assert len(got) == 10 and set(got.values()) <= {0, 1}
    assert len({got[i] for i in range(5)}) == len({got[i] for i in range(5, 10)}) == 1 and got[0] != got[9]


def test_spectral_against_dense(spark):
    """Values, vectors and parts as a dense solver gives them, with repeated and reversed edges and loops."""
    rng = np.random.default_rng(13)
    n, parts = 60, 4
    w = np.zeros((n, n))
    edges = []
    for i, j in combinations(range(n), 2):
        if (near := i % parts == j % parts) and rng.random() < 0.6 or rng.random() < 0.02:
            weight = float(rng.random() + 0.5) * (1 if near else 0.2)
            edges += [(i, j, weight / 2), (j, i, weight / 2)] if rng.random() < 0.3 else [(j, i, weight)]
            w[i, j] = w[j, i] = weight
    edges += [(3, 3, 9.0), (1, 2, 0.0)]
    root = np.sqrt(w.sum(1))
    values, vectors = np.linalg.eigh(w / np.outer(root, root))
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    rows, got = spectral.leading_vectors(df, parts)
    assert got == pytest.approx(values[::-1][:parts], abs=1e-5)
    v = np.array([r.v for r in sorted(rows.collect(), key=lambda r: r.id)])
    want = vectors[:, ::-1][:, :parts]
    assert np.abs(want @ want.T - v @ v.T).max() < 1e-2  # the same space
    label = {r.id: r.label for r in spectral.spectral_labels(df, parts).collect()}
    assert len(set(label.values())) == parts and all(label[i] == label[i % parts] for i in range(n))


def test_all_clusters_get_a_place(spark, monkeypatch):
    from taskweft.plans import queries_durations

    rows = [(i, i, f"c{i}", "f", 10, 10 + i % 7) for i in range(1200)]
    tasks = spark.createDataFrame(rows, "id long, cluster long, name string, file string, planned_days int, actual_days int")
    monkeypatch.setattr(queries_durations, "tasks", lambda t: tasks)
    assert sorted(r.place for r in queries_durations.clusters_by_overrun(None).collect()) == list(range(1, 1201))


def test_batch_size_comes_back(spark):
    """Two writers at once leave the session's own batch size behind, whoever ends first."""
    from taskweft.plans.scratch import small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    first, second = small_batches(spark), small_batches(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(key) == "1000"
    second.__exit__(None, None, None)
    assert spark.conf.get(key) == own


def test_release(spark):
    """Tables of the session go when the caller says so; later ones are made as before."""
    from taskweft.plans import scratch

    one = Scratch(spark, "gone")
    kept = one.cut(spark.range(5))
    assert kept.count() == 5 and scratch.release(spark) >= 1 and scratch.release(spark) == 0
    path = spark._jvm.org.apache.hadoop.fs.Path(one.root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert Scratch(spark, "next").cut(spark.range(3)).count() == 3
