"""Readable keys for clusters of task names, and merging of clusters with near-identical keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions import text as tx
from taskweft.operators import words_pairs
from taskweft.operators.similarity_join import text_components
from taskweft.operators.stats import typical_positions
from taskweft.operators.tables import excluding
from taskweft.plans.scratch import Scratch


def _tokens(column):
    return tx.tokenize(column, unique=True, exclude_numbers=True, exclude_digit_tokens=True)


def fragments(members: DataFrame) -> DataFrame:
    """(cluster, part, fragment, n, tokens): distinct fragments at each part's place. members: (cluster, name).

    Names that are the same after normalising count once.
    """
    names = members.select("cluster", tx.normalize(F.col("name")).alias("normal")).distinct()
    parts = names.select("cluster", F.posexplode(tx.name_parts(F.col("normal"))).alias("part", "fragment"))
    counted = parts.groupBy("cluster", "part", "fragment").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("tokens", _tokens(F.col("fragment")))


def part_matches(frags: DataFrame, scores: DataFrame, cutoff: float) -> DataFrame:
    """(cluster, part, match, w): matched tokens of each pair of fragments, with the number of such pairs.

    Equal fragments match with all their tokens; of different ones each token of the shorter takes its best
    partner in the longer, in its own order, the same partner again where two tokens have it.  Of equal token
    counts the fragment that is smaller as text is the shorter.
    """
    same = frags.where("n > 1 and size(tokens) > 0").select("cluster", "part", F.col("tokens").alias("match"), (F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    f = frags.select(F.struct("cluster", "part").alias("place"), "fragment", "tokens", "n")
    maps = words_pairs.best_maps(f.select(F.col("place").alias("cluster"), F.col("fragment").alias("list"), "tokens"), scores, cutoff)
    f = Scratch(frags.sparkSession, "partners").cut(f.join(maps, (f["place"] == maps["cluster"]) & (f["fragment"] == maps["list"]), "left").select("place", "fragment", "tokens", "n", "best"))
    side = lambda k: f.select("place", *(F.col(c).alias(f"{c}{k}") for c in ("fragment", "tokens", "n", "best")))
    pairs = side(1).join(side(2), "place").where("fragment1 < fragment2")
    first = F.size("tokens1") <= F.size("tokens2")
    short, best = F.when(first, F.col("tokens1")).otherwise(F.col("tokens2")), F.when(first, F.col("best2")).otherwise(F.col("best1"))
    found = pairs.select("place", (F.col("n1") * F.col("n2")).cast("double").alias("w"), short.alias("short"), best.alias("best")).where("best is not null")
    matched = found.select("place", "w", F.filter(F.transform("short", lambda x: F.try_element_at("best", x)), lambda x: x.isNotNull()).alias("match")).where("size(match) > 0")
    both = same.unionByName(matched.select("place.cluster", "place.part", "match", "w"))
    return both.groupBy("cluster", "part", "match").agg(F.sum("w").alias("w"))


def part_keys(frags: DataFrame, scores: DataFrame, cutoff: float = 0.8) -> DataFrame:
    """(cluster, part, words): the best match of each part with two fragments or more.

    A match scores the frequency of its tokens over all matches, repeats counted, times its length over the
    median fragment length; ties go to the larger match in array order.
    """
    matches = Scratch(frags.sparkSession, "matches").cut(part_matches(frags, scores, cutoff))
    freq = matches.select("cluster", "part", "w", F.explode("match").alias("token")).groupBy("cluster", "part", "token").agg(F.sum("w").alias("f"))
    scored = matches.select("cluster", "part", "match", F.explode("match").alias("token")).join(freq, ["cluster", "part", "token"]).groupBy("cluster", "part", "match").agg(F.sum("f").alias("s"))
    lengths = frags.groupBy("cluster", "part").agg(F.percentile(F.length("fragment"), F.lit(0.5), F.col("n")).alias("median"))
    score = F.when(F.col("median") > 0, F.col("s") * F.size("match") / F.col("median")).otherwise(0.0)
    best = scored.join(lengths, ["cluster", "part"]).groupBy("cluster", "part").agg(F.max_by("match", F.struct(score, "match")).alias("match"))
    place = typical_positions(frags.select("cluster", "part", "tokens"), key=["cluster", "part"])
    words = best.select("cluster", "part", F.explode(F.array_distinct("match")).alias("token")).join(place, ["cluster", "part", "token"])
    ordered = words.groupBy("cluster", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w"))
    return ordered.select("cluster", "part", tx.capwords(F.array_join(F.transform("w", lambda x: x["token"]), " ")).alias("words"))


def upper_words(frags: DataFrame) -> DataFrame:
    """(cluster, upper): capitalised form -> upper-case word, of parts with two fragments or more."""
    several = frags.groupBy("cluster", "part").agg(F.sum("n").alias("several")).where("several > 1").select("cluster", "part")
    words = tx.tokenize(F.col("fragment"), unique=True, exclude_numbers=True, exclude_digit_tokens=True, lowercased=False)
    token = frags.join(several, ["cluster", "part"]).select("cluster", F.explode(words).alias("token")).where(tx.all_upper(F.col("token"))).distinct()
    return token.groupBy("cluster").agg(tx.upper_map(F.array_sort(F.collect_list("token"))).alias("upper"))


def key_clusters(members: DataFrame, scores: DataFrame | None = None, cutoff: float = 0.8, vectors: DataFrame | None = None) -> DataFrame:
    """(cluster, key): parts joined by `` - ``, upper-case words restored; without parts, the normalised first name, or the name itself.

    Token pairs match when their score (t1, t2, score) reaches the cutoff.  Without ``scores`` the tokens that
    meet are scored here, with ``vectors`` (token, vec) by the sum of edit and embedding score.
    """
    scratch = Scratch(members.sparkSession, "naming")
    frags = scratch.cut(fragments(members))
    if scores is None:
        scores = scratch.cut(words_pairs.token_scores(words_pairs.meeting_tokens(frags), vectors).withColumn("score", F.round("score", 2)))
    keys = part_keys(frags, scores, cutoff).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("part", "words"))).alias("parts"))
    first = members.groupBy("cluster").agg(F.min("name").alias("name"))
    joined = tx.clean_key(F.array_join(F.filter(F.transform("parts", lambda p: tx.clean_key(p["words"])), lambda t: t != ""), " - "))
    joined = F.array_join(tx.restore_upper(F.split(joined, " "), F.col("upper")), " ")
    plain = tx.clean_key(tx.normalize(F.col("name")))
    full = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    out = first.join(keys, "cluster", "left").join(upper_words(frags), "cluster", "left")
    return out.select("cluster", F.coalesce(full(joined), full(plain), F.col("name")).alias("key"))


def merge_similar(members: DataFrame, keys: DataFrame, scores: DataFrame | None = None, least: float = 0.9, cutoff: float = 0.8, vectors: DataFrame | None = None) -> DataFrame:
    """(cluster, key, merged_from): clusters whose keys are similar become one, named anew from all members."""
    scratch = Scratch(keys.sparkSession, "merge")
    groups = text_components(keys, "key", least)
    at = keys.join(groups, keys["key"] == groups["text"]).select("cluster", "component")
    target = at.groupBy("component").agg(F.min("cluster").alias("target"), F.array_sort(F.collect_list("cluster")).alias("merged_from"))
    to = scratch.cut(at.join(target, "component").select("cluster", "target", "merged_from"))
    again = members.join(to, "cluster").select(F.col("target").alias("cluster"), "name")
    named = key_clusters(again, scores, cutoff, vectors)
    return named.join(to.select(F.col("target").alias("cluster"), "merged_from").distinct(), "cluster")


def unmerged(keys: DataFrame, least: float = 0.9) -> DataFrame:
    """(cluster, key) whose key is like no other cluster's: those that merging leaves out."""
    groups = text_components(keys, "key", least)
    at = Scratch(keys.sparkSession, "groups").cut(keys.join(groups, keys["key"] == groups["text"]).select("cluster", "component"))
    several = at.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    return excluding(keys, at.join(several, "component", "left_semi"), "cluster")


def long_keys(keys: DataFrame, least: int, column: str = "key") -> DataFrame:
    """Rows whose key has more than ``least`` words; `` - `` counts as a blank."""
    return keys.where(F.size(F.split(F.replace(F.col(column), F.lit(" - "), F.lit(" ")), " ")) > least)


def uniform_clusters(members: DataFrame) -> DataFrame:
    """Clusters whose names are all the same."""
    return members.groupBy("cluster").agg(F.countDistinct("name").alias("n"), F.min("name").alias("name")).where("n = 1").select("cluster", "name")


def nearest_length_match(names: DataFrame, target: int) -> DataFrame:
    """(cluster, name) whose length is nearest to the target; the smallest name among equals."""
    return names.groupBy("cluster").agg(F.min_by("name", F.struct(F.abs(F.length("name") - target), "name")).alias("name"))
