"""Pairs of similar texts, their graph, and its components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from taskweft.functions.similarity import edit_ratio, ratio_reachable
from taskweft.operators.stats import global_row_id
from taskweft.plans.components import connected_components
from taskweft.plans.scratch import Scratch


def _farthest(length: Column, least: float) -> Column:
    """Most letters that a text and a longer partner can have apart: insertions and deletions at the ratio's bound."""
    longest = F.floor(length * (2 - least) / least + 1e-9)
    return F.floor((1 - least) * (length + longest) + 1e-9).cast("int")


def _cut_key(length: Column, number: Column, segment: Column) -> Column:
    return F.xxhash64(length, number, segment)


def segment_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(t1, t2), t1 < t2: pairs of distinct texts that can reach the ratio, by shared segments. texts: (t), distinct.

    At the bound a pair is ``d`` insertions and deletions apart.  The shorter text is cut into ``d + 1``
    segments; one of them stands unchanged in the longer, with ``i`` changes before segment ``i`` at most and
    the rest after it, which leaves few places where to look.  So pairs meet on (length, segment number,
    segment), an equal join.  Texts with fewer letters than segments meet all that their length allows.
    """
    t = texts.select("t", F.length("t").alias("n"))
    d = _farthest(F.col("n"), least)
    cuttable = d < F.col("n")
    place = lambda k, n, d: F.floor(k * n / (d + 1)).cast("int")

    # the shorter text: one row for each segment
    own = t.select(F.col("t").alias("s"), F.col("n").alias("ns"), d.alias("d"), F.explode(F.when(cuttable, F.sequence(F.lit(0), d)).otherwise(F.array(F.lit(-1)))).alias("i"))
    at, end = place(F.col("i"), F.col("ns"), F.col("d")), place(F.col("i") + 1, F.col("ns"), F.col("d"))
    index = own.select("s", "ns", _cut_key(F.col("ns"), F.col("i"), F.when(F.col("i") >= 0, F.substring("s", at + 1, end - at)).otherwise("")).alias("key"))

    # the longer text: one row for each place where a segment of a shorter one can stand
    shortest = F.greatest(F.ceil(F.col("n") * least / (2 - least) - 1e-9).cast("int"), F.lit(0))
    lengths = t.select(F.col("t").alias("l"), F.col("n").alias("nl"), F.explode(F.sequence(shortest, F.col("n"))).alias("ns"))
    near = lengths.withColumn("d", _farthest(F.col("ns"), least))
    numbered = near.select("*", F.explode(F.when(F.col("d") < F.col("ns"), F.sequence(F.lit(0), F.col("d"))).otherwise(F.array(F.lit(-1)))).alias("i"))
    more = F.col("nl") - F.col("ns")
    apart = F.floor((1 - least) * (F.col("ns") + F.col("nl")) + 1e-9).cast("int")
    gone, come = F.floor((apart - more) / 2).cast("int"), F.floor((apart + more) / 2).cast("int")
    left, after = F.col("i"), F.col("d") - F.col("i")
    low, high = F.greatest(-left, more - after, -gone), F.least(left, more + after, come)
    shifted = numbered.select("*", F.explode(F.when(F.col("i") < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("shift"))
    at, end = place(F.col("i"), F.col("ns"), F.col("d")), place(F.col("i") + 1, F.col("ns"), F.col("d"))
    begin = at + F.col("shift")
    inside = (F.col("i") < 0) | ((begin >= 0) & (begin + end - at <= F.col("nl")))
    probes = shifted.where(inside).select("l", "nl", "ns", _cut_key(F.col("ns"), F.col("i"), F.when(F.col("i") >= 0, F.substring("l", begin + 1, end - at)).otherwise("")).alias("key")).distinct()

    before = (F.col("ns") < F.col("nl")) | ((F.col("ns") == F.col("nl")) & (F.col("s") < F.col("l")))
    met = index.join(probes, ["key", "ns"]).where(before)
    return met.select(F.least("s", "l").alias("t1"), F.greatest("s", "l").alias("t2")).distinct()


def edit_pairs(texts: DataFrame, column: str, least: float = 0.0, skip_tags: bool = True) -> DataFrame:
    """(t1, t2, score) for unordered pairs of distinct texts, t1 < t2, with edit ratio >= ``least``.

    Tags (``<...>``) are left out.  With a threshold, pairs meet by shared segments before the ratio is
    computed; without one every pair is wanted and made.
    """
    t = texts.select(F.col(column).alias("t")).where("t is not null").distinct()
    if skip_tags:
        t = t.where(~F.col("t").rlike("^<.*>$"))
    if least <= 0:
        pairs = t.select(F.col("t").alias("t1")).join(t.select(F.col("t").alias("t2")), F.col("t1") < F.col("t2"))
    else:
        pairs = segment_pairs(t, least).where(ratio_reachable(F.col("t1"), F.col("t2"), least))
    scored = pairs.withColumn("score", edit_ratio(F.col("t1"), F.col("t2")))
    return scored.where(F.col("score") >= least) if least > 0 else scored


def symmetric(pairs: DataFrame, value: str = "score", diagonal: float | None = None) -> DataFrame:
    """Both directions of each pair; with ``diagonal`` also each text with itself."""
    both = pairs.select("t1", "t2", value).unionByName(pairs.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), value))
    if diagonal is None:
        return both
    alone = both.select("t1").distinct().select("t1", F.col("t1").alias("t2"), F.lit(float(diagonal)).alias(value))
    return both.unionByName(alone)


def text_components(texts: DataFrame, column: str, least: float = 0.9) -> DataFrame:
    """(text, component): the smallest text that similar pairs lead to. Texts are numbered in their order for the loop."""
    scratch = Scratch(texts.sparkSession, "texts")
    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    t = scratch.cut(global_row_id(distinct, ["text"]).withColumnRenamed("row_id", "id"))
    pairs = edit_pairs(t, "text", least, skip_tags=False)
    links = pairs.join(t.select(F.col("text").alias("t1"), F.col("id").alias("src")), "t1").join(t.select(F.col("text").alias("t2"), F.col("id").alias("dst")), "t2").select("src", "dst")
    labels = connected_components(links, scratch).withColumnRenamed("component", "root")
    rooted = t.join(labels, "id", "left").select("text", F.coalesce("root", "id").alias("root"))
    return rooted.join(t.select(F.col("id").alias("root"), F.col("text").alias("component")), "root").select("text", "component")


def component_members(clusters: DataFrame, components: DataFrame) -> DataFrame:
    """(component, members): cluster members gathered under merged keys. clusters: (key, member)."""
    return clusters.join(components.withColumnRenamed("text", "key"), "key").groupBy("component").agg(F.array_sort(F.collect_set("member")).alias("members"))


def leader_clusters(names: DataFrame, column: str, lo: float = 0.8, hi: float = 1.0, rounds: list[int] | None = None) -> DataFrame:
    """(name, leader) of the greedy pass in text order: a name joins the first leader it is strictly within (lo, hi) of.

    The pass is run by priority rounds.  A name leads as soon as no earlier name like it can still lead, and
    follows as soon as one of them leads; all such names are decided at once, and the result is that of the
    one-by-one pass.  Names meet by the edit join first: the matched blocks of the gestalt ratio are a common
    subsequence, so it is never above the edit ratio.  ``rounds`` receives the undecided names before each
    round.  Null names are left out.
    """
    from taskweft.functions.similarity import gestalt_ratio

    scratch = Scratch(names.sparkSession, "leaders")
    distinct = scratch.cut(names.select(F.col(column).alias("name")).where("name is not null").distinct())
    near = edit_pairs(distinct, "name", lo, skip_tags=False).select(F.col("t1").alias("a"), F.col("t2").alias("b"))
    ratio = gestalt_ratio()(F.col("a"), F.col("b"))
    alike = scratch.cut(near.withColumn("ratio", ratio).where((F.col("ratio") > lo) & (F.col("ratio") < hi)).select("a", "b"))
    open_, edges, leaders = distinct, alike, []
    while n := open_.count():
        if rounds is not None:
            rounds.append(n)
        new = scratch.cut(open_.join(edges.select(F.col("b").alias("name")).distinct(), "name", "left_anti"))
        follow = edges.join(new.withColumnRenamed("name", "a"), "a").select(F.col("b").alias("name")).distinct()
        left = scratch.cut(open_.join(new, "name", "left_anti").join(follow, "name", "left_anti"), rows=n)
        edges = scratch.cut(edges.join(left.withColumnRenamed("name", "a"), "a", "left_semi").join(left.withColumnRenamed("name", "b"), "b", "left_semi"))
        leaders.append(new)
        open_ = left
    if not leaders:
        return distinct.select("name", F.col("name").alias("leader"))
    lead = reduce(DataFrame.unionByName, leaders)
    joined = alike.join(lead.withColumnRenamed("name", "a"), "a").groupBy(F.col("b").alias("name")).agg(F.min("a").alias("leader"))
    return distinct.join(joined, "name", "left").select("name", F.coalesce("leader", "name").alias("leader"))


def similar_to(names: DataFrame, column: str, query: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(name, score): names whose gestalt ratio to the query lies within [lo, hi]."""
    from taskweft.functions.similarity import gestalt_ratio

    scored = names.select(F.col(column).alias("name")).distinct().withColumn("score", gestalt_ratio()(F.col("name"), F.lit(query)))
    return scored.where(F.col("score").between(lo, hi))
