"""Quality classifier: a factorisation machine.

Features are hashed words, binned structure statistics of the text and its metadata (declared length).
The score is ``sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pair term is computed in
time linear in the features as ``(sum_f (sum_i v_if x_i)^2 - sum_i (v_if x_i)^2) / 2``.

It is fitted on a bounded sample of labelled rows and scores every document in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskweft.llm.common import map_batches, map_rows, per_task
from taskweft.llm.text_features import LEVELS, STATS, Buckets, structure_ids, word_buckets, word_list

#: Bound of the sample that is fitted: labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 8192
BUCKETS = 1 << 14
N_STATS = len(STATS) * LEVELS


@dataclass(frozen=True)
class Machine:
    bias: float
    weights: np.ndarray  # (features,)
    factors: np.ndarray  # (features, k)

    def raw(self, ids: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; ``starts`` marks each document's first feature."""
        linear = np.add.reduceat(self.weights[ids] * x, starts)
        v = self.factors[ids] * x[:, None]
        total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return self.bias + linear + 0.5 * (total * total - squares).sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: str | None, declared: int | None, buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values: statistics first (so never empty), then words of unit norm."""
    raw = (text or "").encode()
    words = word_list(raw)
    ids, counts = word_buckets(words, buckets)
    value = np.sqrt(counts)
    norm = np.sqrt((value * value).sum()) if len(value) else 1.0
    return np.concatenate([structure_ids(raw, words, declared), N_STATS + ids]), np.concatenate([np.full(len(STATS), 1 / np.sqrt(len(STATS))), value / norm])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int = 8, epochs: int = 15, batch: int = 128, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, mini-batches, AdaGrad.  Without rows, or with one class, the score is the share of label 1."""
    size = N_STATS + BUCKETS
    share = (labels.sum() + 1) / (len(labels) + 2)
    bias = float(np.log(share / (1 - share)))
    w, v = np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, k))
    if not len(labels) or labels.min() == labels.max():
        return Machine(bias, w, np.zeros((size, k)))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, k), 1e-3), 1e-3
    order = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), batch):
            pick = shuffled[at : at + batch]
            ids = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            lengths = np.array([len(rows[i][0]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts)
            z = bias + np.add.reduceat(w[ids] * x, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(axis=1)
            slope = (sigmoid(z) - labels[pick]) / len(pick)
            each = np.repeat(slope, lengths)
            touched, where = np.unique(ids, return_inverse=True)
            dw = np.bincount(where, each * x, len(touched)) + decay * w[touched]
            dv = np.zeros((len(touched), k))
            np.add.at(dv, where, (each * x)[:, None] * (np.repeat(total, lengths, axis=0) - vx))
            dv += decay * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= rate * dw / np.sqrt(gw[touched])
            v[touched] -= 0.5 * rate * dv / np.sqrt(gv[touched])
            gb += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(gb)
    return Machine(bias, w, v)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_cols: list[str], id_col: str, text_col: str, chars_col: str, training, rows: int) -> DataFrame:
    """(doc_id, text, n_chars, labels...) of at most ``rows`` labelled documents, by the smallest hash of their id.

    Labels that disagree about a document count by their smallest value; null labels and ids are left out.
    Of texts that share an id the smallest is taken; equal hashes go by id.  Without labels there are no rows.
    """
    one = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(*(F.min(F.col(c).cast("int")).alias(c) for c in label_cols))
    for c in ["doc_id", *label_cols]:
        one = one.where(F.col(c).isNotNull())
    if training is not None:
        one = one.where(training(F.col("doc_id")))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # the documented bound makes the broadcast safe
    chars = F.col(chars_col).cast("long") if chars_col in docs.columns else F.lit(None).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars"))
    met = texts.join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars")).alias("one"), *(F.min(c).alias(c) for c in label_cols)).select("doc_id", "one.*", *label_cols)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", training=None, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Fit on the sample; ``training`` maps the id column to the rows that may be learnt from.

    The fit depends on the rows, not on their order: repeated ids count once (``labelled_sample``), null texts
    as empty.  Without labelled rows, or with one class only, every document gets the share of label 1.
    Other columns are not read.
    """
    sample = labelled_sample(docs, labels, [label_col], id_col, text_col, chars_col, training, sample_rows)

    @per_task
    def task():
        buckets = Buckets(BUCKETS)

        def work(ids, texts, chars, label):
            got = [features(t, c, buckets) for t, c in zip(texts, chars, strict=True)]
            return {"doc_id": ids, "label": label, "ids": [i.astype(np.uint16).tobytes() for i, _ in got], "x": [x.astype(np.float32).tobytes() for _, x in got]}

        return work

    got = map_rows(sample.select("doc_id", "text", "n_chars", label_col), "doc_id long, label int, ids binary, x binary", task).toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(i.as_buffer(), np.uint16).astype(np.int64), np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)) for i, x in zip(got["ids"], got["x"], strict=True)]
    return fit(rows, (got["label"].to_numpy() > 0).astype(np.float64))


def _scorer(machine: Machine):
    buckets = Buckets(BUCKETS)

    def score(texts, chars) -> np.ndarray:
        if not len(texts):
            return np.empty(0)
        got = [features(t, c, buckets) for t, c in zip(texts, chars, strict=True)]
        lengths = np.array([len(i) for i, _ in got])
        return sigmoid(machine.raw(np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got]), np.concatenate([[0], np.cumsum(lengths)[:-1]])))

    return score


def score_documents(df: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """(doc_id, score, predicted), one row for each row of ``df``.

    Null texts score as empty ones, by their statistics; a missing or null declared length has a level of
    its own.  Ids may be null or repeated; other columns are not read; an empty table gives no rows.
    """
    weights = df.sparkSession.sparkContext.broadcast(machine)

    @per_task
    def task():
        score = _scorer(weights.value)

        def work(ids, texts, chars):
            s = score(texts, chars)
            return {"doc_id": ids, "score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))}

        return work

    chars = F.col(chars_col).cast("long") if chars_col in df.columns else F.lit(None).cast("long")
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars")), "doc_id long, score double, predicted int", task, slice_rows=256)


def keep_good(df: DataFrame, machine: Machine, floor: float = 0.5, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose score is at least ``floor``.

    A null text is scored as an empty one, a long one whole; repeated rows stay or go each, null ids are not
    looked at; an empty table gives no rows; other columns pass through, whatever their names.
    """
    weights, names = df.sparkSession.sparkContext.broadcast(machine), df.columns

    def run(batches):
        score = _scorer(weights.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                chars = part.column(names.index(chars_col)).to_pylist() if chars_col in names else [None] * part.num_rows
                yield part.filter(pa.array(score(part.column(names.index(text_col)).to_pylist(), chars) >= floor))

    return map_batches(df, run, df.schema)
