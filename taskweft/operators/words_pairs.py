"""How well the words of a cluster's names match, from a table of token-pair scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions.similarity import edit_ratio
from taskweft.functions.vectors import squared_distance
from taskweft.operators.cluster_metrics import scale_distances
from taskweft.plans.scratch import Scratch


def name_lists(names: DataFrame) -> DataFrame:
    """(cluster, tokens, n, list): distinct token lists of a cluster with their number. names: (cluster, id, tokens)."""
    return names.groupBy("cluster", "tokens").agg(F.count(F.lit(1)).alias("n")).withColumn("list", F.xxhash64("tokens"))


def _both_ways(scores: DataFrame) -> DataFrame:
    """(x, y, score) of different tokens, in both orders. scores: (t1, t2, score), t1 < t2."""
    s = scores.select(F.col("t1").alias("x"), F.col("t2").alias("y"), "score")
    return s.unionByName(s.select(F.col("y").alias("x"), F.col("x").alias("y"), "score"))


def pair_totals(names: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster, total, tokens, members): over all pairs of a cluster's names, the scores of their token pairs and the tokens compared.

    No pair of names is formed.  With T(x) the count of a token in the cluster and c(x) in a name, the pairs
    of names hold half of what T(x) T(y) s(x, y) sums to, less what each name holds with itself; every name
    is compared with all others, so the tokens are those of all names times the members less one.  Equal
    tokens score 1, pairs without a score 0.
    """
    lists = Scratch(names.sparkSession, "lists").cut(name_lists(names))
    one = lists.select("cluster", "n", F.explode("tokens").alias("x"))
    count = one.groupBy("cluster", "x").agg(F.sum("n").cast("double").alias("t"))
    same = count.select("cluster", (F.col("t") * F.col("t")).alias("part"))
    s = scores.select("t1", "t2", "score").where("score <> 0")
    first, second = count.select("cluster", F.col("x").alias("t1"), F.col("t").alias("a")), count.select(F.col("cluster").alias("c2"), F.col("x").alias("y"), F.col("t").alias("b"))
    met = first.join(s, "t1").join(second, (F.col("cluster") == F.col("c2")) & (F.col("t2") == F.col("y")))
    different = met.select("cluster", (2 * F.col("a") * F.col("b") * F.col("score")).alias("part"))
    own = lists.select("cluster", "n", F.explode("tokens").alias("x"), "tokens").select("cluster", "n", "x", F.explode("tokens").alias("y")).groupBy("cluster", "x", "y").agg(F.sum("n").cast("double").alias("w"))
    inside = lookup(own, scores).select("cluster", (-F.col("w") * F.col("score")).alias("part"))
    total = same.unionByName(different).unionByName(inside).groupBy("cluster").agg((F.sum("part") / 2).alias("total"))
    sizes = lists.groupBy("cluster").agg(F.sum("n").alias("members"), F.sum(F.col("n") * F.size("tokens")).alias("all"))
    return sizes.join(total, "cluster", "left").select("cluster", F.coalesce("total", F.lit(0.0)).alias("total"), ((F.col("members") - 1) * F.col("all")).alias("tokens"), "members")


def lookup(products: DataFrame, scores: DataFrame) -> DataFrame:
    """With ``score``: of the token pair, 1 for equal tokens, 0 if unknown. scores: (t1, t2, score), t1 < t2."""
    s = scores.select("t1", "t2", "score")
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    joined = products.withColumns({"_lo": lo, "_hi": hi}).join(s, (F.col("_lo") == F.col("t1")) & (F.col("_hi") == F.col("t2")), "left")
    return joined.withColumn("score", F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).drop("_lo", "_hi", "t1", "t2")


def meeting_tokens(names: DataFrame) -> DataFrame:
    """(t1, t2), t1 < t2: different tokens that stand in names of one cluster; tags are left out. names: (cluster, tokens)."""
    t = names.select("cluster", F.explode("tokens").alias("t1")).where(~F.col("t1").rlike("^<.*>$")).distinct()
    return t.join(t.withColumnRenamed("t1", "t2"), "cluster").where("t1 < t2").select("t1", "t2").distinct()


def token_scores(pairs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(t1, t2, score): the edit ratio, and with ``vectors`` (token, vec) the embedding score added to it.

    The embedding score is ``1 - distance / largest distance``, 0 where a token has no vector.
    """
    scored = pairs.select("t1", "t2", edit_ratio(F.col("t1"), F.col("t2")).alias("score"))
    if vectors is None:
        return scored
    v = vectors.select("token", "vec")
    near = embedding_scores(pairs, v).withColumnsRenamed({"t1": "x1", "t2": "x2", "score": "near"})
    both = scored.join(near, (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")), "left")
    return both.select("t1", "t2", (F.col("score") + F.coalesce("near", F.lit(0.0))).alias("score"))


def embedding_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(t1, t2, score) of the pairs whose two tokens have vectors (token, vec)."""
    one = vectors.select(F.col("token").alias("t1"), F.col("vec").alias("v1"))
    two = vectors.select(F.col("token").alias("t2"), F.col("vec").alias("v2"))
    apart = pairs.select("t1", "t2").join(one, "t1").join(two, "t2").select("t1", "t2", F.sqrt(squared_distance(F.col("v1"), F.col("v2"))).alias("distance"))
    return scale_distances(apart).select("t1", "t2", "score")


def cluster_scores(names: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """(cluster, score): pair scores over the tokens compared. Clusters without pairs are absent.

    Without ``scores`` the tokens that meet are scored by edit ratio, all of them, whatever their score.
    """
    if scores is None:
        scores = Scratch(names.sparkSession, "scores").cut(token_scores(meeting_tokens(names)))
    compared = F.col("tokens")
    return pair_totals(names, scores).where("members > 1").select("cluster", F.when(compared > 0, F.col("total") / compared).otherwise(0.0).alias("score"))


def run_score(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 2).alias("words_pairs"))


def best_partners(lists: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """(cluster, list, token, match, score): for each token of a cluster its best partner in a list, the last one among equals.

    lists: (cluster, list, tokens).  Partners below ``least`` do not count.  A token meets the lists that hold
    one of its partners, by the scores; lists are not multiplied with lists.
    """
    held = lists.select("cluster", "list", F.posexplode("tokens").alias("j", "y"))
    known = held.select("cluster", F.col("y").alias("x")).distinct()
    ways = known.join(_both_ways(scores.where(F.col("score") >= least)), "x").select("cluster", "x", "y", "score")
    if least <= 1:
        ways = ways.unionByName(known.select("cluster", "x", F.col("x").alias("y"), F.lit(1.0).alias("score")))
    met = ways.join(held, ["cluster", "y"])
    best = met.groupBy("cluster", "list", "x").agg(F.max(F.struct("score", "j", "y")).alias("best"))
    return best.select("cluster", "list", F.col("x").alias("token"), F.col("best.y").alias("match"), F.col("best.score").alias("score"))


def best_maps(lists: DataFrame, scores: DataFrame, least: float) -> DataFrame:
    """(cluster, list, best): ``best_partners`` as a map token -> match for each list."""
    return best_partners(lists, scores, least).groupBy("cluster", "list").agg(F.map_from_entries(F.collect_list(F.struct("token", "match"))).alias("best"))


def max_per_token(names: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster, score), older form: best partner score of each token over ordered pairs, by the tokens compared.

    A token's best partner in a list is looked up once, for all names with that token; no pair of names is formed.
    """
    lists = Scratch(names.sparkSession, "lists").cut(name_lists(names))
    tokens = lists.select("cluster", "list", "n", F.explode(F.array_distinct("tokens")).alias("token"))
    holders = tokens.groupBy("cluster", "token").agg(F.sum("n").alias("f"))
    filled = lists.where(F.size("tokens") > 0).groupBy("cluster").agg(F.sum("n").alias("names"))
    best = best_partners(lists.select("cluster", "list", "tokens"), scores, 0.0).where("score > 0").join(lists.select("cluster", "list", "n"), ["cluster", "list"])
    own = tokens.select("cluster", "list", "token", F.lit(1).alias("own"))
    weight = F.col("n") * (F.col("f") - F.coalesce("own", F.lit(0)))  # a name is not compared with itself
    top = best.join(holders, ["cluster", "token"]).join(own, ["cluster", "list", "token"], "left").groupBy("cluster").agg(F.sum(weight * F.col("score")).alias("s"))
    compared = holders.join(filled, "cluster").groupBy("cluster").agg(F.sum(F.col("f") * (F.col("names") - 1)).alias("w")).where("w > 0")
    return compared.join(top, "cluster", "left").select("cluster", (F.coalesce("s", F.lit(0.0)) / F.col("w")).alias("score"))


def mean_cluster_score(names: DataFrame, scores: DataFrame) -> DataFrame:
    """Older form: a cluster's pair scores by its members' tokens, averaged over clusters."""
    tokens = F.col("tokens") / (F.col("members") - 1)
    return pair_totals(names, scores).where("members > 1 and tokens > 0").agg(F.avg(F.col("total") / tokens).alias("mean_score"))


def restrict(scores: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pair scores whose two tokens are both among ``tokens`` (token)."""
    t = tokens.select("token").distinct()
    return scores.join(t.withColumnRenamed("token", "t1"), "t1", "left_semi").join(t.withColumnRenamed("token", "t2"), "t2", "left_semi").select(scores.columns)


def pair_matrices(tokens: DataFrame, vectors: DataFrame) -> DataFrame:
    """(t1, t2, edit_score, embed_score) for unordered pairs of tokens, t1 < t2.

    The embedding score is ``1 - distance / largest distance``, null where a token has no vector. All
    pairs are wanted here; use ``similarity_join.edit_pairs`` with a threshold where they are not.
    """
    from taskweft.operators.similarity_join import edit_pairs

    t = edit_pairs(tokens, "token").withColumnRenamed("score", "edit_score")
    return t.join(embedding_scores(t, vectors).withColumnRenamed("score", "embed_score"), ["t1", "t2"], "left")


def expand_synonyms(tokens: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(token, synonym) for known tokens, other than the token itself. synonyms: (token, synonym)."""
    return tokens.select("token").distinct().join(synonyms.select("token", "synonym"), "token").where("token <> synonym").distinct()


def same_as_lemma(tokens: DataFrame, lemmas: DataFrame, ending: str = "ing") -> DataFrame:
    """Tokens with the ending that are their own lemma. lemmas: (token, lemma), from any tagger."""
    return tokens.select("token").distinct().where(F.col("token").endswith(ending)).join(lemmas, "token").where("token = lemma").select("token")
