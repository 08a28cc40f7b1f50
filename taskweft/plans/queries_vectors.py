"""Queries over embeddings and their labels, and the choice of the best run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions import vectors as vx
from taskweft.operators import cluster_metrics as cm, vector_search, ward
from taskweft.plans.registry import Tables, query

WIDTH = 64


def labelled(t: Tables) -> DataFrame:
    """(id, label, vec)."""
    return t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))


_E = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_LONG = _E + ", long AS (SELECT id, label, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM e)"
_SS = _LONG + """, c AS (SELECT label, k, avg(x) AS c, count(*) AS n FROM long GROUP BY ALL), g AS (SELECT k, avg(x) AS g FROM long GROUP BY 1),
    w AS (SELECT l.label, sum((x - c) ** 2) AS wss FROM long l JOIN c ON c.label = l.label AND c.k = l.k GROUP BY 1), b AS (SELECT label, any_value(n) AS size, sum(n * (c - g) ** 2) AS bss FROM c JOIN g USING (k) GROUP BY 1)"""
_CENTROIDS = _LONG + ", c AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS m FROM long GROUP BY ALL) GROUP BY 1)"


@query(f"WITH {_LONG} SELECT label, k, round(avg(x), 6) AS mean FROM (SELECT label, CAST(k AS INTEGER) AS k, x FROM long) GROUP BY ALL")
def cluster_centroids(t):
    c = cm.centroids(labelled(t), WIDTH).select("label", F.posexplode("centroid").alias("k", "mean"))
    return c.select("label", (F.col("k") + 1).alias("k"), F.round("mean", 6).alias("mean"))


@query(f"WITH {_SS} SELECT w.label, size, round(bss, 5) AS bss, round(wss, 5) AS wss FROM w JOIN b ON b.label = w.label")
def cluster_sums_of_squares(t):
    return cm.sums_of_squares(labelled(t), WIDTH).select("label", "size", F.round("bss", 5).alias("bss"), F.round("wss", 5).alias("wss"))


@query(f"WITH {_SS} SELECT round(sum(bss), 4) AS bss, round(sum(wss), 4) AS wss, round(sum(bss) * (sum(size) - count(*)) / (sum(wss) * (count(*) - 1)), 5) AS ch_index FROM w JOIN b ON b.label = w.label")
def ch_index(t):
    return cm.ch_index(cm.sums_of_squares(labelled(t), WIDTH)).select(F.round("bss", 4).alias("bss"), F.round("wss", 4).alias("wss"), F.round("ch_index", 5).alias("ch_index"))


@query(f"WITH {_E} SELECT a.label, round(coalesce(sum(CASE WHEN a.id < b.id THEN list_distance(a.vec, b.vec) ** 2 END), 0) / (2 * count(DISTINCT a.id)), 5) AS wcss FROM e a JOIN e b ON a.label = b.label GROUP BY 1")
def wcss_by_pairs(t):
    return cm.wcss_by_pairs(labelled(t), WIDTH).withColumn("wcss", F.round("wcss", 5))


@query(f"""WITH {_CENTROIDS}, s AS (SELECT e.label, any_value(c) AS c, avg(list_distance(vec, c)) AS s FROM e JOIN c ON c.label = e.label GROUP BY 1)
    SELECT round(avg(m), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS m FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)""")
def davies_bouldin(t):
    return cm.davies_bouldin(labelled(t), WIDTH).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(f"""WITH {_E}, d AS (SELECT a.id, a.label, b.label AS other, sum(CASE WHEN a.id = b.id THEN 0 ELSE list_distance(a.vec, b.vec) END) AS total, count(*) AS n FROM e a, e b GROUP BY ALL),
    p AS (SELECT id, label, max(CASE WHEN label = other THEN n END) AS size, max(CASE WHEN label = other THEN total END) AS w, min(CASE WHEN label <> other THEN total / n END) AS b FROM d GROUP BY ALL)
    SELECT id, round(CASE WHEN size = 1 THEN 0 ELSE (b - w / (size - 1)) / greatest(w / (size - 1), b) END, 5) AS silhouette FROM p""")
def silhouette(t):
    return cm.silhouettes(labelled(t)).select("id", F.round("silhouette", 5).alias("silhouette"))


@query(f"WITH {_CENTROIDS} SELECT a.label AS l1, b.label AS l2, round(list_distance(a.c, b.c), 6) AS distance FROM c a JOIN c b ON a.label < b.label")
def centroid_distances(t):
    return cm.centroid_distances(labelled(t), WIDTH).withColumn("distance", F.round("distance", 6))


@query(f"WITH {_CENTROIDS}, p AS (SELECT a.label AS l1, b.label AS l2, list_distance(a.c, b.c) AS d FROM c a JOIN c b ON a.label < b.label) SELECT l1, l2, round(d, 6) AS distance, round(1 - d / (SELECT max(d) FROM p), 6) AS score FROM p")
def scaled_distances(t):
    out = cm.scale_distances(cm.centroid_distances(labelled(t), WIDTH))
    return out.select("l1", "l2", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(f"WITH {_CENTROIDS}, p AS (SELECT a.label AS l1, b.label AS l2, list_distance(a.c, b.c) AS d FROM c a JOIN c b ON a.label < b.label) SELECT l1, l2, round(d, 6) AS distance FROM p WHERE d >= 0.2")
def far_centroids(t):
    return cm.centroid_distances(labelled(t), WIDTH, 0.2).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_E}, q AS (SELECT * FROM e WHERE id % 100 = 0), s AS (SELECT q.id AS query, e.id, round(list_cosine_similarity(q.vec, e.vec), 9) AS s FROM q JOIN e ON e.id <> q.id)
    SELECT query, id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def nearest_vectors(t):
    """A top-k report: every vector whose id is divisible by 100 against all vectors."""
    e = labelled(t).select("id", "vec")
    found = vector_search.nearest(e.where("id % 100 = 0"), e, 10)
    return found.select("query", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_E} SELECT id, round(sqrt(list_inner_product(vec, vec)), 6) AS norm FROM e")
def vector_norms(t):
    return labelled(t).select("id", F.round(vx.norm(F.col("vec")), 6).alias("norm"))


_RUNS = """runs AS (SELECT o_custkey % 8 + 1 AS run_id, avg(o_totalprice) AS cost, stddev_pop(o_totalprice) AS spread, count(*) AS n FROM orders GROUP BY 1)"""


@query(f"""WITH {_RUNS}, m AS (SELECT min(cost) AS a, max(cost) AS b, min(spread) AS c, max(spread) AS d, min(n) AS e, max(n) AS f FROM runs)
    SELECT run_id, round(2.0 * (1 - (cost - a) / (b - a)) + 1.0 * (spread - c) / (d - c) + 0.5 * (n - e) / (f - e), 9) AS total FROM runs, m ORDER BY total DESC, run_id LIMIT 1""")
def vote_best_run(t):
    runs = t.orders.groupBy((F.col("o_custkey") % 8 + 1).alias("run_id")).agg(F.avg("o_totalprice").alias("cost"), F.stddev_pop("o_totalprice").alias("spread"), F.count(F.lit(1)).alias("n"))
    return cm.vote(runs, {"cost": ("min", 2.0), "spread": ("max", 1.0), "n": ("max", 0.5)})


@query("SELECT run_id, min_tasks_per_cluster FROM (SELECT o_custkey % 50 AS run_id, count(*) AS min_tasks_per_cluster FROM orders GROUP BY 1) WHERE min_tasks_per_cluster >= 300")
def large_enough_runs(t):
    runs = t.orders.groupBy((F.col("o_custkey") % 50).alias("run_id")).agg(F.count(F.lit(1)).alias("min_tasks_per_cluster"))
    return cm.large_enough(runs, 300)


@query("""WITH v AS (SELECT p_name AS token, avg(p_retailprice) AS x, avg(p_size) AS y FROM part WHERE p_name NOT LIKE '%bolt%' GROUP BY 1), n AS (SELECT l_orderkey AS id, p_name AS token FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) FILTER (WHERE x IS NULL) AS missing FROM n LEFT JOIN v USING (token) GROUP BY 1""")
def pooled_tokens(t):
    v = t.part.where("p_name NOT LIKE '%bolt%'").groupBy(F.col("p_name").alias("token")).agg(F.array(F.avg("p_retailprice"), F.avg("p_size")).alias("vec"))
    n = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("p_name").alias("tokens"))
    out = cm.pool_tokens(n, v, 2)
    return out.select("id", F.round(F.col("vec")[0], 6).alias("x"), F.round(F.col("vec")[1], 6).alias("y"), "missing")


@query()
def ward_clusters(t):
    return ward.ward_labels(labelled(t).select("id", "vec"), [5, 10, 20])


@query()
def dendrogram_leaves(t):
    return ward.leaf_counts(labelled(t).select("id", "vec"))


@query()
def best_clustering(t):
    """The whole run on embeddings of parts: choose k, name the clusters."""
    from taskweft.plans.run import run
    from taskweft.sources.config import Config

    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("planned_days"))
    v = labelled(t).select("id", "vec")
    tasks = p.join(v.select("id"), "id", "left_semi")
    result = run(tasks, v, Config(percents=(1.0, 2.0, 4.0)))
    return result.keys.select("cluster", "key").withColumn("run_id", F.lit(result.best))
