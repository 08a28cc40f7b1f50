import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweft.llm import op2_mixing as mx, op4_quality as q
from taskweft.llm.queries import MIX, held_out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    words, rude = [f"w{i}" for i in range(300)], ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(400):
        text = list(rng.choice(words, rng.integers(20, 120)))
        kind = ["good", "good", "good", "low", "toxic"][i % 5]
        if kind == "low":
            text = [w.upper() + "!!" for w in text]
        if kind == "toxic":
            text[3] = text[9] = str(rng.choice(rude))
        rows.append((i, " ".join(text), "en", "s", 100))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_pair_term_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    m = q.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    rows = [(np.array([1, 4, 7]), np.array([0.5, 1.0, -2.0])), (np.array([2]), np.array([3.0])), (np.array([0, 8]), np.array([1.0, 1.0]))]
    starts = np.array([0, 3, 4])
    got = m.raw(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]), starts)
    for z, (ids, x) in zip(got, rows, strict=True):
        pairs = sum(m.factors[ids[a]] @ m.factors[ids[b]] * x[a] * x[b] for a in range(len(ids)) for b in range(a + 1, len(ids)))
        assert z == pytest.approx(0.3 + m.weights[ids] @ x + pairs)


def test_held_out_quality(data):
    docs, labels = data
    machine = q.train(docs, labels, training=lambda c: ~held_out(c))
    got = q.score_documents(docs, machine).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.97 and got.score.between(0, 1).all()
    again = q.score_documents(docs, q.train(docs, labels, training=lambda c: ~held_out(c)))
    assert again.agg(F.sum("score")).first()[0] == pytest.approx(q.score_documents(docs, machine).agg(F.sum("score")).first()[0])


def test_labels_do_not_leak(data):
    docs, labels = data
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (q.train(docs, x, training=lambda c: ~held_out(c)) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_odd_rows_score(odd, clash, none, no_labels, data):
    docs, labels = data
    for machine in (q.train(docs, labels), q.train(odd, no_labels), q.train(none, no_labels)):
        got = sorted(map(tuple, q.score_documents(odd, machine).collect()), key=repr)
        assert got == sorted(map(tuple, q.score_documents(clash, machine).collect()), key=repr)
        assert len(got) == 10 and all(0 <= r[1] <= 1 for r in got)
        kept = q.keep_good(clash, machine, 0.0)
        assert kept.columns == clash.columns and kept.count() == 10 and q.keep_good(odd, machine, 1.1).count() == 0
        assert q.score_documents(none, machine).count() == 0
    odd_labels = labels.limit(3).unionByName(labels.limit(3)).withColumn("quality", F.lit(None).cast("int"))
    assert q.train(docs, odd_labels).weights.any() == False  # noqa: E712


def solve(p, tau, target, scale, ridge):
    """The same problem by many plain projected steps."""
    r = np.ones(len(p))
    for _ in range(20_000):
        g = p @ ((tau * r) @ p / scale - target / scale) + ridge * (r - 1)
        r = np.maximum(0, r - 0.5 * g)
    return r


def test_rates_solve_the_problem(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.dirichlet([0.3, 0.3, 0.3], 60), 3)
    p[:, 0] += 1 - p.sum(axis=1)
    words = rng.integers(1, 500, 60)
    groups = spark.createDataFrame([(list(map(float, x)), int(w)) for x, w in zip(p, words, strict=True)], "p array<double>, words long")
    steps, info = mx.fit_rates(groups, [0.7, 0.3, 0.0], ridge=0.05, tolerance=1e-9, rounds=300)
    tau = words / words.sum()
    want = solve(p, tau, np.array(info["target"]), np.maximum(tau @ p, 1e-3), 0.05)
    assert np.abs(steps.looking(p) - want).max() < 5e-3 and (steps.looking(p) >= 0).all()
    assert mx.fit_rates(groups.limit(0), [0.5, 0.5, 0.0])[0].looking(p).tolist() == [1.0] * 60


def test_mixing(data, odd, clash, none, no_labels):
    docs, labels = data
    model = mx.train_domains(docs, labels)
    got = mx.mixing_rates(docs, model, MIX).join(labels, "doc_id").toPandas()
    assert got.rate.min() >= 0 and np.allclose(got[["p_good", "p_low", "p_toxic"]].sum(axis=1), 1)
    assert (got[got.toxic == 1].copies == 0).mean() > 0.95 and (got[(got.quality == 1) & (got.toxic == 0)].copies == 1).mean() > 0.98
    mixed = (got.n_words * got.rate * got.p_low).sum() / (got.n_words * got.rate).sum()
    assert abs(mixed - MIX["low"]) < 0.03
    for m in (model, mx.train_domains(odd, no_labels)):
        assert mx.mixing_rates(clash, m, MIX).count() == 10 and mx.mixing_rates(none, m, MIX).count() == 0
        assert mx.mix(clash, m, MIX).columns == clash.columns and mx.mix(none, m, MIX).count() == 0
    assert mx.mix(docs, model, MIX, repeat=False).join(labels, "doc_id").where("toxic = 1").count() <= 4


def test_realised_mix_follows_the_targets(spark):
    """Low documents far above their target keep some copies, and toxic ones none, so that the words meet the targets."""
    rng = np.random.default_rng(6)
    kinds = rng.choice(3, 3000, p=[0.7, 0.25, 0.05])
    p, words = np.eye(3)[kinds] * 0.98 + 0.02 / 3, rng.integers(50, 150, 3000)
    groups = spark.createDataFrame([(list(map(float, x)), int(w)) for x, w in zip(p, words, strict=True)], "p array<double>, words long")
    steps, info = mx.fit_rates(groups, MIX)
    assert np.abs(info["residual"]).max() < 0.005, info
    rates = steps.looking(p)
    copies = mx.copies_of(rates, np.array([mx._draw(i, None) for i in range(3000)]))
    share = (words * copies) @ p / (words * copies).sum()
    assert abs(share[1] - MIX["low"]) < 0.01 and share[2] < 0.01, share
    assert abs((words * copies).sum() / (words * rates).sum() - 1) < 0.02


def test_held_out_rank_on_documents(spark):
    """Area under the curve and accuracy on the held-out third of the labelled documents."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    machine = q.train(docs, labels, training=lambda c: ~held_out(c))
    got = q.score_documents(docs, machine).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert len(good) > 50 and len(bad) > 5
    assert (good[:, None] > bad[None, :]).mean() > 0.98 and (got.predicted == got.quality).mean() > 0.95


def test_long_texts_of_distinct_words(spark, data):
    docs, labels = data
    model = mx.train_domains(docs, labels)
    rows = [(1, " ".join(f"d{i}" for i in range(200_000)), "en", "s", 5), (2, None, None, None, None)]
    long = spark.createDataFrame(rows, docs.schema)
    got = {r.doc_id: r for r in mx.mixing_rates(long, model, MIX).collect()}
    assert got[1].n_words == 200_000 and got[2].n_words == 0
    assert 0 <= q.score_documents(long, q.train(docs, labels)).first().score <= 1


def test_fit_does_not_depend_on_the_order_of_rows(spark, data):
    docs, labels = data
    twice = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit(" again"))))
    a, b = (q.train(x, labels) for x in (twice.orderBy("text"), twice.orderBy(F.desc("text"))))
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.factors, b.factors)
    assert np.array_equal(*(mx.train_domains(x, labels).weights for x in (twice.orderBy("text"), twice.orderBy(F.desc("text")))))


def test_realised_shares_on_documents(spark):
    """Copies drawn from the rates follow the targets on the tables given."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = mx.mixing_rates(docs, mx.train_domains(docs, labels), MIX)
    share = got.agg(*(F.sum(F.col("n_words") * F.col("copies") * F.col(f"p_{d}")).alias(d) for d in MIX), F.sum(F.col("n_words") * F.col("copies")).alias("n")).first()
    for domain, target in MIX.items():
        assert abs(share[domain] / share["n"] - target) < 0.01, (domain, share)
