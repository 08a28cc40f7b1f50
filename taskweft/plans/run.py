"""The whole run: tasks and their vectors to named clusters, with the best number of clusters chosen."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from taskweft.functions.text import tokenize
from taskweft.operators import cluster_metrics as cm
from taskweft.operators import durations as du
from taskweft.operators import naming, stats, ward, words_pairs
from taskweft.plans.scratch import Scratch
from taskweft.sources.config import Config


@dataclass(frozen=True)
class Result:
    runs: DataFrame
    best: int
    assignments: DataFrame
    keys: DataFrame


def score_run(k: int, labelled: DataFrame, planned: DataFrame, names: DataFrame, scores: DataFrame, width: int, sil: DataFrame) -> DataFrame:
    """One row of the runs table for one clustering. labelled: (id, label, vec); sil: its mean silhouette, one row."""
    sizes = stats.size_stats(labelled).select("num_clusters", F.col("mean_size").alias("tasks_per_cluster_mean"), F.col("median_size").alias("tasks_per_cluster_median"), F.col("min_size").alias("min_tasks_per_cluster"), F.col("max_size").alias("max_tasks_per_cluster"), F.col("size_range").alias("min_max_tpc"))
    spread = du.duration_spread(labelled.select("id", "label"), planned).agg(F.avg("duration_std").alias("mean_duration_std"))
    ch = cm.ch_index(cm.sums_of_squares(labelled, width)).select(F.col("wss").alias("wcss"), F.col("bss").alias("bcss"), "ch_index")
    db = cm.davies_bouldin(labelled, width).select(F.col("davies_bouldin").alias("db_index"))
    tokens = names.join(labelled.select("id", F.col("label").alias("cluster")), "id").select("cluster", "id", "tokens")
    words = words_pairs.run_score(words_pairs.cluster_scores(tokens, scores))
    out = sizes
    for one in (spread, ch, db, sil, words):  # one row each
        out = out.crossJoin(one)
    return out.select(F.lit(k).alias("run_id"), "*")


def run(tasks: DataFrame, vectors: DataFrame, config: Config = Config(), token_vectors: DataFrame | None = None) -> Result:
    """tasks: (id, name, planned_days); vectors: (id, vec); token_vectors: (token, vec), for embedding scores beside edit ratios."""
    scratch = Scratch(tasks.sparkSession, "run")
    vectors = scratch.cut(vectors.join(tasks.select("id"), "id", "left_semi"))
    names = scratch.cut(tasks.select("id", tokenize(F.col("name"), unique=True, exclude_digit_tokens=True).alias("tokens")))
    n, width = vectors.count(), cm.width_of(vectors)
    ks = ward.candidate_ks(n, list(config.percents), config.num_clusters)
    labels = scratch.cut(ward.ward_labels(vectors, ks))
    # the scores of all tokens that meet in a cluster; the cutoff is for naming only
    together = names.join(labels, "id").select(F.struct("k", "label").alias("cluster"), "tokens")
    scores = scratch.cut(words_pairs.token_scores(words_pairs.meeting_tokens(together), token_vectors))
    planned = tasks.select("id", "planned_days")
    widths = scratch.cut(cm.run_silhouettes(vectors, labels).groupBy("k").agg(F.avg("silhouette").alias("silhouette")))

    def score(k: int) -> DataFrame:
        of = labels.where(F.col("k") == k).select("id", "label").join(vectors, "id")
        return Scratch(tasks.sparkSession, "score").cut(score_run(k, of, planned, names, scores, width, widths.where(F.col("k") == k).select("silhouette")))

    with ThreadPoolExecutor(min(4, len(ks)) or 1) as some:  # small jobs of several runs beside each other
        rows = list(some.map(score, ks))
    runs = rows[0]
    for r in rows[1:]:
        runs = runs.unionByName(r)
    runs = scratch.cut(runs)
    best = cm.vote(cm.large_enough(runs, config.min_cluster_size), config.metrics).first()["run_id"]
    chosen = labels.where(F.col("k") == best).select("id", F.col("label").alias("cluster"))
    members = tasks.join(chosen, "id").select("cluster", "name")
    keys = naming.key_clusters(members, None, config.token_cutoff, token_vectors)
    if config.merge_keys:
        keys = naming.merge_similar(members, scratch.cut(keys), None, config.key_similarity, config.token_cutoff, token_vectors)
    return Result(runs, best, chosen, keys)
