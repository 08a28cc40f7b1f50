"""Queries of counts, profiles, outliers, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from taskweft.operators import features as fe, stats, tables as tb
from taskweft.plans.registry import query


def _rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("""SELECT CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after, CAST((SELECT count(*) FROM lineitem) - count(*) AS BIGINT) AS dropped FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem)""")
def dedupe_counts(t):
    return stats.dedupe_counts(t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def value_counts(t):
    return stats.value_counts(t.orders, "o_orderstatus")


@query("WITH n AS (SELECT o_custkey AS value, count(*) AS n FROM orders GROUP BY 1) SELECT value, n, (SELECT count(*) FROM n WHERE n = 1) AS singletons FROM n WHERE n > 1")
def repeated_values(t):
    return stats.repeated(t.orders, "o_custkey")


@query("SELECT DISTINCT c_mktsegment FROM customer")
def distinct_values(t):
    return t.customer.select("c_mktsegment").distinct()


@query("SELECT c_nationkey, list_sort(list(c_custkey)) AS members FROM customer GROUP BY 1")
def cluster_members(t):
    return t.customer.groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("members"))


@query("""SELECT count(*) AS num_clusters, round(avg(n), 6) AS mean_size, median(n) AS median_size, min(n) AS min_size, max(n) AS max_size, max(n) - min(n) AS size_range FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)""")
def cluster_size_stats(t):
    return _rounded(stats.size_stats(t.embeddings), 6, "mean_size")


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "note"]


@query(
    "WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS note FROM orders), p AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) * 100.0 / count(*) AS coverage, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS uniques, count(*) AS n FROM o" for c in _PROFILED)
    + ") SELECT name, round(CAST(coverage AS DOUBLE), 6) AS coverage, CAST(uniques AS BIGINT) AS uniques, round(CAST(uniques AS DOUBLE) * 100 / n, 6) AS percent_unique FROM p WHERE coverage > 0"
)
def column_profile(t):
    o = t.orders.withColumn("note", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).withColumn("empty", F.lit(None).cast("string"))
    p = stats.profile(o.select(*_PROFILED, "empty"))
    return _rounded(p.drop("type"), 6, "coverage", "percent_unique")


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
    SELECT event_id, value FROM events, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def iqr_outliers(t):
    return stats.iqr_outliers(t.events.select("event_id", "value"), "value")


@query("""WITH s AS (SELECT c_custkey, c_acctbal, sum(o_totalprice) AS spent FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
    q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a1, quantile_cont(c_acctbal, 0.75) AS a3, quantile_cont(spent, 0.25) AS b1, quantile_cont(spent, 0.75) AS b3 FROM s)
    SELECT c_custkey, c_acctbal, round(spent, 2) AS spent FROM s, q WHERE c_acctbal BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1) AND spent BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)""")
def without_outliers(t):
    s = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey", "c_acctbal").agg(F.sum("o_totalprice").alias("spent"))
    return _rounded(stats.without_outliers(s, ["c_acctbal", "spent"]), 2, "spent")


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3, min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem GROUP BY 1)
    SELECT l_returnflag, q1, q2, q3, greatest(q1 - 1.5 * (q3 - q1), mn) AS lower, least(q3 + 1.5 * (q3 - q1), mx) AS upper FROM q""")
def box_plot(t):
    return stats.box_plot(t.lineitem, "l_returnflag", "l_quantity")


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
    SELECT e.event_type, value FROM events e JOIN q ON e.event_type = q.event_type WHERE value > q3 + 1.5 * (q3 - q1) OR value < q1 - 1.5 * (q3 - q1)""")
def box_outliers(t):
    return stats.box_outliers(t.events, "event_type", "value")


@query("""WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events) SELECT max(value) AS max_within FROM events, m WHERE (value - a) / s <= 3""")
def max_within_z(t):
    return stats.max_within_z(t.events, "value")


@query("""WITH m AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), b AS (SELECT CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi FROM part, m)
    SELECT bin, round(lo + bin * ((hi - lo) / 20), 6) AS lo, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS hi, count(*) AS n FROM b GROUP BY bin, b.lo, b.hi""")
def price_histogram(t):
    return _rounded(stats.histogram(t.part, "p_retailprice", 20), 6, "lo", "hi")


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id FROM orders")
def next_id(t):
    return stats.next_id(t.orders, "o_orderkey")


@query("SELECT round(100.0 * count(*) FILTER (WHERE quality IS NULL) / count(*), 1)::DOUBLE AS percent_without FROM documents LEFT JOIN labels USING (doc_id)")
def share_without_label(t):
    return stats.share_without(t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left"), "quality")


@query("""SELECT p_partkey, 'S' || p_brand || '_' || (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS code FROM part""")
def sequence_in_group(t):
    return stats.sequence_in_group(t.part, "p_brand", ["p_partkey"]).select("p_partkey", "code")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS row_id FROM part")
def global_row_id(t):
    return stats.global_row_id(t.part.select("p_retailprice", "p_partkey"), ["p_retailprice"]).select("p_partkey", "row_id")


@query("WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo), 9) AS s_acctbal FROM supplier, m")
def min_max_scaled(t):
    return _rounded(stats.min_max_scale(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal"]), 9, "s_acctbal")


@query("WITH m AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier) SELECT s_suppkey, round(2000 * (1 - (s_acctbal - lo) / (hi - lo)), 6) AS s_acctbal FROM supplier, m")
def rescaled_inverted(t):
    return _rounded(stats.rescale(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", 2000.0, invert=True), 6, "s_acctbal")


@query("""WITH m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - a) / s, 6) AS z FROM events, m""")
def z_scores(t):
    return _rounded(stats.z_scores(t.events.select("event_id", "value"), "value").select("event_id", "z"), 6, "z")


@query("""SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def correlations(t):
    return _rounded(stats.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), 6, "r")


_CUSTOMER_SUM = "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1"


@query(_CUSTOMER_SUM)
def feature_sum(t):
    return _rounded(fe.feature_sum(t.orders, fe.Selection("o_custkey", "o_totalprice", {"o_orderstatus": ["F", "P"]})), 2, "total")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F') AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def feature_sum_two_filters(t):
    return _rounded(fe.feature_sum(t.orders, fe.Selection("o_custkey", "o_totalprice", {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})), 2, "total")


@query("SELECT p_type, round(sum(p_retailprice), 2) AS total FROM part WHERE regexp_matches(p_brand, '#1[0-9]?') GROUP BY p_type, regexp_extract(p_brand, '#1[0-9]?')")
def feature_sum_by_match(t):
    return _rounded(fe.feature_sum(t.part, fe.Selection("p_type", "p_retailprice", pattern=("p_brand", "#1[0-9]?"))), 2, "total")


@query("""SELECT c_custkey, c_name, n_name, round(total, 2) AS total, round(urgent, 2) AS urgent FROM customer JOIN nation ON n_nationkey = c_nationkey
    JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey JOIN (SELECT o_custkey, sum(o_totalprice) AS urgent FROM orders WHERE o_orderpriority IN ('1-URGENT') GROUP BY 1) b ON b.o_custkey = c_custkey""")
def feature_join(t):
    total = fe.feature_sum(t.orders, fe.Selection("o_custkey", "o_totalprice"))
    urgent = fe.feature_sum(t.orders, fe.Selection("o_custkey", "o_totalprice", {"o_orderpriority": ["1-URGENT"]}), "urgent")
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name")
    out = fe.combine([total, urgent, places], "o_custkey").select(F.col("o_custkey").alias("c_custkey"), "c_name", "n_name", "total", "urgent")
    return _rounded(out, 2, "total", "urgent")


@query("""SELECT c_custkey AS k, c_name AS name, 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier', NULL FROM supplier""")
def stacked_frames(t):
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    return tb.stack_frames([c, t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))])


@query("""SELECT coalesce(s_suppkey, c_custkey) AS k, coalesce(s_name, c_name) AS name FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""")
def merged_last_wins(t):
    return tb.merge_last_wins([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))], "k")


@query("""WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'O')
    SELECT f, n, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT f, n, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def frame_difference(t):
    side = lambda s: t.lineitem.where(F.col("l_linestatus") == s).select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return tb.frame_difference(side("F"), side("O"))


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def unordered_pairs(t):
    return tb.unordered_pairs(t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 3")
def top_orders(t):
    return tb.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def largest_orders(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def as_strings(t):
    return tb.as_strings(t.part.select("p_partkey", "p_name", "p_size"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'bolt')")
def name_contains(t):
    return t.part.where(F.col("p_name").contains("bolt")).select("p_partkey", "p_name")


@query("SELECT doc_id, quality FROM (SELECT doc_id, nullif(lang, 'en') AS lang FROM documents) JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL")
def complete_rows(t):
    d = t.documents.select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("lang")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return tb.drop_incomplete(d, ["lang", "quality"]).select("doc_id", "quality")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{\"id\":' || event_id || ',\"k\":' || json_extract_string(props, '$.k') || '}' AS doc FROM events")
def json_column(t):
    e = t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.withColumn("doc", F.to_json(F.struct(F.col("event_id").alias("id"), "k")))


@query("""WITH p AS (SELECT unnest([0.25, 0.5, 0.75, 0.9]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) AS n, round(avg(l_discount * 10), 6) AS mean, round(median(l_discount * 10), 6) AS median FROM lineitem, p WHERE l_discount * 10 >= threshold GROUP BY threshold""")
def threshold_sweep(t):
    out = stats.threshold_sweep(t.lineitem.select((F.col("l_discount") * 10).alias("s")), "s", [0.25, 0.5, 0.75, 0.9])
    return _rounded(out, 6, "mean", "median")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL HAVING count(*) > 2")
def filtered_types(t):
    return t.orders.where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
