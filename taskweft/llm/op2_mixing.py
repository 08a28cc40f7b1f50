"""Mixing to target weights with soft membership.

A classifier fitted on a bounded sample of the labelled table gives each document a posterior over the
domains, rounded to thousandths.  A document counts for each domain with its words times the posterior.
Nonnegative rates (expected copies) are then fitted so that the domains' expected word totals meet the
targets: with tau the share of all words, minimise

    1/2 sum_k (sum_d tau_d p_dk r_d - t_k)^2 / s_k  +  ridge/2 sum_d tau_d (r_d - 1)^2,   r >= 0

by accelerated projected gradient steps.  ``s`` are the domains' shares before mixing, so errors count
relative to the domain.  Each step is one distributed sum over (posterior, words); only the k residuals
reach the driver.  Documents of equal posterior have equal rates, so the sums run over distinct posteriors,
whose number rounding bounds whatever the corpus; a rate follows from the posterior and the list of steps.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from taskweft.llm.common import map_batches, map_rows, per_task
from taskweft.llm.op4_quality import SAMPLE_ROWS, labelled_sample
from taskweft.llm.text_features import LEVELS, STATS, structure_ids, word_list
from taskweft.plans.scratch import Scratch

#: Domains by the labelled table: toxic rows, else rows of low quality, else good ones.
DOMAINS = ("good", "low", "toxic")
BUCKETS = 1 << 18
#: Words that tell domains apart: at most so many, with at least this chi-square and so many rows.
MAX_WORDS, MIN_CHI2, MIN_ROWS = 1024, 25.0, 5
N_STATS = len(STATS) * LEVELS
GRID = 1000
_EDGES = b".,;:!?\"'()[]*$%&#|-"


#: Words that a task remembers; the memo is emptied when it holds more.
MEMO_WORDS = 300_000
#: Bytes of the word beginnings that are features of their own, beside the whole word.
PREFIXES = (5, 6, 7)


class _Buckets(dict):
    """word -> buckets of the word without outer marks and of its beginnings."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        core = word.strip(_EDGES)
        digest = xxhash.xxh3_64_intdigest
        b = self[word] = (digest(core) % BUCKETS, *[digest(core[:n], n) % BUCKETS for n in PREFIXES if len(core) > n])
        return b


class _Columns(_Buckets):
    """word -> the model's columns among its buckets: for most words none."""

    def __init__(self, column: np.ndarray):
        super().__init__()
        self.column = {int(b): int(column[b]) for b in np.flatnonzero(column >= 0)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        told = [self.column[b] for b in super().__missing__(word) if b in self.column]
        self[word] = told = tuple(told) if told else ()
        return told


def _features(text: str | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, int]:
    """(structure ids, distinct buckets or columns of the words, number of words)."""
    raw = (text or "").encode()
    words = word_list(raw)
    ids = np.fromiter(set(chain.from_iterable(map(buckets.__getitem__, set(words)))), dtype=np.int64)
    return structure_ids(raw, words, len(raw)), ids, len(words)


@dataclass(frozen=True)
class DomainModel:
    """Softmax regression on structure levels and the presence of telling words and word beginnings."""

    column: np.ndarray  # (BUCKETS,) column of a bucket, -1 without
    weights: np.ndarray  # (columns, k)
    bias: np.ndarray  # (k,)

    def posterior(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """(documents, k) in thousandths that sum to 1. rows: features by ``_Columns``."""
        z = np.empty((len(rows), len(self.bias)))
        for i, (stats, columns, _) in enumerate(rows):
            z[i] = self.bias + self.weights[stats].sum(axis=0) + self.weights[columns].sum(axis=0)
        z = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p = np.floor(z / z.sum(axis=1, keepdims=True) * GRID).astype(np.int64)
        p[np.arange(len(p)), p.argmax(axis=1)] += GRID - p.sum(axis=1)
        return p / GRID


def fit_domains(rows, domain: np.ndarray, k: int, steps: int = 300, decay: float = 3e-3) -> DomainModel:
    """Choose words by chi-square, then descend the mean log loss; without rows all domains are alike."""
    n = len(rows)
    counts = np.zeros((k, BUCKETS))
    for (_, words, _), y in zip(rows, domain, strict=True):
        counts[y, words] += 1
    total, size = counts.sum(axis=0), np.bincount(domain, minlength=k).astype(float)
    chi = np.zeros(BUCKETS)
    for y in range(k):
        a, b = counts[y], total - counts[y]
        c, d = size[y] - a, n - size[y] - b
        chi = np.maximum(chi, n * (a * d - b * c) ** 2 / np.maximum(1e-9, (a + b) * (c + d) * (a + c) * (b + d)))
    chi[total < MIN_ROWS] = 0
    picked = np.argsort(-chi, kind="stable")[:MAX_WORDS]
    picked = picked[chi[picked] >= MIN_CHI2]
    column = np.full(BUCKETS, -1, np.int64)
    column[picked] = N_STATS + np.arange(len(picked))
    x = np.zeros((n, N_STATS + len(picked)), np.float32)
    for i, (stats, words, _) in enumerate(rows):
        x[i, stats] = 1
        at = column[words]
        x[i, at[at >= 0]] = 1
    y = np.eye(k, dtype=np.float32)[domain] if n else np.zeros((0, k), np.float32)
    bias = np.log((size + 1) / (n + k))
    w, seen = np.zeros((x.shape[1], k)), np.full((x.shape[1], k), 1e-4)
    for _ in range(steps if n else 0):
        z = x @ w.astype(np.float32) + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - y) / n + decay * w / np.sqrt(max(n, 1))
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        bias -= 0.3 * (p - y).mean(axis=0)
    return DomainModel(column, w, bias)


def train_domains(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Fit on at most ``sample_rows`` labelled rows (``labels``: doc_id, quality, toxic).

    Repeated ids count once, by their smallest text and labels, null texts as empty; rows with a null id or
    label are left out.  Without labelled rows all domains are equally likely everywhere.  Other columns are
    not read.
    """
    sample = labelled_sample(docs, labels, ["quality", "toxic"], id_col, text_col, "n_chars", None, sample_rows)

    @per_task
    def task():
        buckets = _Buckets()

        def work(ids, texts, quality, toxic):
            got = [_features(t, buckets) for t in texts]
            return {"doc_id": ids, "domain": [2 if t > 0 else 1 if q <= 0 else 0 for q, t in zip(quality, toxic, strict=True)], "stats": [s.astype(np.int32).tobytes() for s, _, _ in got], "words": [w.astype(np.int32).tobytes() for _, w, _ in got]}

        return work

    got = map_rows(sample.select("doc_id", "text", "quality", "toxic"), "doc_id long, domain int, stats binary, words binary", task).toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(s.as_buffer(), np.int32).astype(np.int64), np.frombuffer(w.as_buffer(), np.int32).astype(np.int64), 0) for s, w in zip(got["stats"], got["words"], strict=True)]
    return fit_domains(rows, got["domain"].to_numpy().astype(np.int64), len(DOMAINS))


def posteriors(df: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, p array<double>, draw), one row for each row of ``df``.

    Null and empty texts have no words and the posterior of an empty text; rows with null or repeated ids are
    judged each; texts are read whole; an empty table gives no rows; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @per_task
    def task():
        m = shared.value
        buckets = _Columns(m.column)

        def work(ids, texts):
            rows = [_features(t, buckets) for t in texts]
            return {"doc_id": ids, "n_words": [n for _, _, n in rows], "p": m.posterior(rows).tolist(), "draw": [_draw(i, t) for i, t in zip(ids, texts, strict=True)]}

        return work

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, n_words long, p array<double>, draw double", task)


def _draw(doc_id: int | None, text: str | None) -> float:
    """A number in [0, 1) by the id's hash, or by the text's where there is no id."""
    key = f"id {doc_id}" if doc_id is not None else f"text {text or ''}"
    return (xxhash.xxh3_64_intdigest(key.encode()) >> 11) / (1 << 53)


def copies_of(rates: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Whole copies whose expectation is the rate: a fraction is one copy where the draw lies below it."""
    whole = np.floor(rates)
    return (whole + (draws < rates - whole)).astype(np.int64)


@dataclass(frozen=True)
class Steps:
    """The descent so far: each step's momentum and its k-vector of weighted residuals."""

    rate: float
    ridge: float
    momentum: tuple[float, ...] = ()
    pull: tuple[tuple[float, ...], ...] = ()
    #: What the mix's rates are divided by: shares stay, and a clear document of the anchor domain has rate 1.
    unit: float = 1.0

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.looking(p) / self.unit

    def looking(self, p: np.ndarray, beta: float = 0.0) -> np.ndarray:
        """The point after these steps, moved on by ``beta`` times the last one."""
        r = before = np.ones(len(p))
        for b, g in zip(self.momentum, self.pull, strict=True):
            y = r + b * (r - before)
            before, r = r, np.maximum(0.0, y - self.rate * (p @ np.array(g) + self.ridge * (y - 1)))
        return r + beta * (r - before)


def fit_rates(groups: DataFrame, weights: dict[str, float] | list[float], total: float | None = None, ridge: float = 1e-2, rounds: int = 80, tolerance: float = 1e-6) -> tuple[Steps, dict]:
    """Steps of the descent for (p, words), and what came of it; a table without words has none, so all rates stay 1.

    The second result tells the words, the domains' shares before, the targets, the residuals left and the
    rounds.  Rows of the same p may repeat; null p or words are not expected here.  ``total`` is the mix's number of words; without it, the largest wanted domain keeps its own.
    """
    w = np.array(list(weights.values()) if isinstance(weights, dict) else weights, dtype=float)
    w = w / w.sum()
    k = len(w)
    first = groups.agg(F.sum("words").alias("n"), *(F.sum(F.col("words") * F.col("p")[j]).alias(f"d{j}") for j in range(k)), *(F.sum(F.col("words") * F.col("p")[i] * F.col("p")[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(k))).first()
    n = float(first["n"] or 0)
    if n == 0:
        return Steps(1.0, ridge), {"words": 0.0, "residual": [0.0] * k, "rounds": 0}
    share = np.array([first[f"d{j}"] / n for j in range(k)])
    scale = np.maximum(share, 1e-3)
    wanted = np.flatnonzero(w > 0)
    anchor = wanted[share[wanted].argmax()]
    target = w * (total / n if total is not None else share[anchor] / w[anchor])
    moments = np.array([[first[f"m{i}_{j}"] / n for j in range(k)] for i in range(k)])
    half = 1 / np.sqrt(scale)
    steps = Steps(1 / (np.linalg.eigvalsh(half[:, None] * moments * half[None, :]).max() + ridge), ridge)
    residual, theta = None, 1.0

    for done in range(rounds):
        nxt = (1 + np.sqrt(1 + 4 * theta * theta)) / 2
        beta = (theta - 1) / nxt

        def sums(batches, steps=steps, beta=beta):
            out = np.zeros(k)
            for batch in batches:
                p = batch.column(0).flatten().to_numpy().reshape(-1, k)
                out += (batch.column(1).to_numpy().astype(float) * steps.looking(p, beta)) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[f"x{j}" for j in range(k)])

        got = groups.select("p", "words").mapInArrow(sums, ", ".join(f"x{j} double" for j in range(k))).agg(*(F.sum(f"x{j}").alias(f"x{j}") for j in range(k))).first()
        new = np.array([got[f"x{j}"] / n for j in range(k)]) - target
        if residual is not None and np.abs(new - residual).max() < tolerance:
            return steps, {"words": n, "share": share.tolist(), "target": target.tolist(), "residual": new.tolist(), "rounds": done}
        residual, theta = new, nxt
        steps = Steps(steps.rate, ridge, (*steps.momentum, float(beta)), (*steps.pull, tuple((new / scale).tolist())))
    return steps, {"words": n, "share": share.tolist(), "target": target.tolist(), "residual": residual.tolist(), "rounds": rounds}


def _fit_mix(groups: DataFrame, weights: dict[str, float], total: float | None) -> Steps:
    """``fit_rates``; without ``total`` the unit is the rate of a clear document of the largest wanted domain."""
    steps, info = fit_rates(groups, weights, total)
    if total is not None or not info["words"]:
        return steps
    w = np.array(list(weights.values()), dtype=float)
    anchor = np.where(w > 0, info["share"], -1.0).argmax()
    unit = float(steps.looking(np.eye(len(w))[[anchor]])[0])
    return replace(steps, unit=unit) if unit > 0 else steps


def _grouped(found: DataFrame) -> DataFrame:
    return found.groupBy("p").agg(F.sum("n_words").alias("words"))


def mixing_rates(df: DataFrame, model: DomainModel, weights: dict[str, float], total: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, p_<domain>..., rate, copies), one row for each row of ``df``.

    ``copies`` is the rate's whole part, and one more where the draw of the doc_id lies below its fraction, so
    the copies' words follow the rates'.  Null and empty texts have no words and the rate of their
    posterior.  Ids may be null or repeated; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    found = scratch.cut(posteriors(df, model, id_col, text_col))
    groups = scratch.cut(_grouped(found))
    steps = _fit_mix(groups, weights, total)
    scratch.drop(groups)
    names = list(weights)

    def work(ids, words, p, draw):
        m = np.array(p, dtype=float).reshape(-1, len(names))
        r = steps.rates(m)
        return {"doc_id": ids, "n_words": words} | {f"p_{d}": pa.array(m[:, j]) for j, d in enumerate(names)} | {"rate": pa.array(r), "copies": pa.array(copies_of(r, np.array(draw, dtype=float)))}

    schema = "doc_id long, n_words long, " + ", ".join(f"p_{d} double" for d in names) + ", rate double, copies long"
    return map_rows(found.select("doc_id", "n_words", "p", "draw"), schema, work, slice_rows=4096)


def mix(df: DataFrame, model: DomainModel, weights: dict[str, float], total: float | None = None, repeat: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, each as often as ``mixing_rates`` says in ``copies``; at most once without ``repeat``.

    Null and empty texts have the rate of their posterior; rows with null ids are drawn by their text, repeated
    rows alike; an empty table gives none; other columns may bear any name.
    """
    scratch = Scratch(df.sparkSession, "mix")
    groups = scratch.cut(_grouped(posteriors(df.select(F.lit(0).alias("doc_id"), F.col(f"`{text_col}`").alias("text")), model)))
    steps = _fit_mix(groups, weights, total)
    scratch.drop(groups)
    shared, names = df.sparkSession.sparkContext.broadcast((model, steps)), df.columns

    def run(batches):
        m, s = shared.value
        buckets = _Columns(m.column)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(names.index(text_col)).to_pylist()
                p = m.posterior([_features(t, buckets) for t in texts])
                draws = [_draw(i, t) for i, t in zip(part.column(names.index(id_col)).to_pylist(), texts, strict=True)]
                copies = copies_of(s.rates(p), np.array(draws, dtype=float))
                yield part.take(pa.array(np.repeat(np.arange(len(copies)), copies if repeat else np.minimum(copies, 1))))

    return map_batches(df, run, df.schema)
