"""Queries through the readers and writers: exports are written as text out of the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.operators import drilldown, durations as du, encoding, naming, tables as tb, vector_search, ward, words_pairs as wp
from taskweft.functions import text as tx
from taskweft.plans.queries_durations import TASKS, tasks
from taskweft.plans.queries_text import _lcs
from taskweft.plans.queries_vectors import _E, labelled
from taskweft.plans.registry import Tables, query
from taskweft.plans.scratch import Scratch
from taskweft.sources import schedules as so, sinks, stored


def _exports(t: Tables) -> DataFrame:
    """One row an order: what a schedule export tells about it. Some dates are blank, some types are no tasks."""
    o, k = t.orders, F.col("o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(
        k.cast("string").alias("id"),
        F.when(k % 3 == 0, "TT_Task").when(k % 3 == 1, "TT_TASK").otherwise("TT_Mile").alias("task_type"),
        F.concat(F.lit("Order_"), "o_orderpriority", F.lit("&amp of "), F.col("o_custkey").cast("string")).alias("label"),
        day("o_orderdate").alias("planned_start"),
        F.when(k % 7 == 0, "").otherwise(day(F.date_add("o_orderdate", 10))).alias("planned_end"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("export_"), (k % 5).cast("string")).alias("file"),
    )


_EXPORTS = """exports AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'TT_Task' WHEN 1 THEN 'TT_TASK' ELSE 'TT_Mile' END AS task_type,
    'Order ' || o_orderpriority || ' of ' || o_custkey AS label, strftime(o_orderdate, '%Y-%m-%d') AS planned_start,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') END AS planned_end, o_orderstatus AS status, 'export_' || (o_orderkey % 5) AS file, o_orderkey FROM orders)"""


def _node_texts(t: Tables) -> DataFrame:
    """(file, content): node text of one order, written twice, as UTF-8 with a byte-order mark or as Latin-1."""
    entry = lambda key, c: F.concat(F.lit(f'  <data key="{key}">'), F.col(c), F.lit("</data>\n"))
    node = F.concat(F.lit('<node id="'), "id", F.lit('">\n'), entry("TaskType", "task_type"), entry("Label", "label"), entry("PlannedStart", "planned_start"), entry("PlannedEnd", "planned_end"), entry("Status", "status"), entry("Unknown", "id"), F.lit("</node>\n"))
    text = F.concat(F.lit("<graphml>\n<!-- é -->\n"), node, node, F.lit("</graphml>"))
    content = F.when(F.col("id").cast("long") % 2 == 0, F.encode(F.concat(F.lit("﻿"), text), "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return _exports(t).select("file", content.alias("content"))


@query(f"WITH {_EXPORTS} SELECT id, task_type, label, planned_start, planned_end, status, file FROM exports WHERE task_type IN ('TT_Task', 'TT_TASK')")
def node_tasks(t):
    """Written as files of mixed encodings, one folder a file name, and read back by records."""
    path = Scratch(t.spark, "nodes").root
    written = _node_texts(t).select(F.col("content").cast("string").alias("value"), "file", F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    written.write.partitionBy("file", "utf8").text(path)
    return so.clean_tasks(so.read_nodes(t.spark, path)).select("id", "task_type", "label", "planned_start", "planned_end", "status", "file")


@query(f"WITH {_EXPORTS} SELECT CAST(id AS BIGINT) AS id, 10 AS planned_days FROM exports WHERE planned_end <> ''")
def text_durations(t):
    d = du.durations(_exports(t), "planned_start", "planned_end", "planned_days")
    return d.select(F.col("id").cast("long").alias("id"), "planned_days")


@query("SELECT c_custkey, c_name || ' Größe é' AS text FROM customer")
def decoded_texts(t):
    text = F.concat("c_name", F.lit(" Größe é"))
    content = F.when(F.col("c_custkey") % 3 == 0, F.encode(F.concat(F.lit("﻿"), text), "UTF-8")).when(F.col("c_custkey") % 3 == 1, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return t.customer.select("c_custkey", so.decode(content).alias("text"))


@query(f"""WITH {_EXPORTS} SELECT id, CASE WHEN o_orderkey % 3 < 2 THEN 'TT_TASK' ELSE 'TT_Mile' END AS task_type, replace(label, 'Order ', 'Order_') AS label, planned_start, planned_end, status, file FROM exports""")
def xer_text_tasks(t):
    e = _exports(t).withColumn("label", F.replace("label", F.lit("&amp"), F.lit("")))
    line = lambda *parts: F.concat_ws("\t", *parts)
    names = ["task_code", "task_type", "task_name", "target_start_date", "target_end_date", "act_start_date", "act_end_date", "total_float_hr_cnt", "status_code"]
    kind = F.when(F.col("task_type") == "TT_Task", "TASK_DEPENDENT").otherwise(F.col("task_type"))
    row = line(F.lit("%R"), "id", kind, "label", "planned_start", "planned_end", F.lit(""), F.lit(""), F.lit("0"), "status")
    text = F.concat_ws("\r\n", F.lit("ERMHDR\t8.0"), F.lit("%T\tPROJECT"), F.lit("%F\tproj_id"), F.lit("%R\t1"), F.lit("%T\tTASK"), F.lit("\t".join(["%F", *names])), row, F.lit("%E"))
    path = Scratch(t.spark, "xer").root
    e.select(text.alias("value"), "file").write.partitionBy("file").text(path)
    return so.xer_tasks(so.read_xer(t.spark, path)).select("id", "task_type", "label", "planned_start", "planned_end", "status", "file")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, 'a \"quoted\", ' || p_name AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def csv_round_trip(t):
    path = Scratch(t.spark, "csv").root
    sinks.write_files(t.part.select("p_partkey", F.concat(F.lit('a "quoted", '), "p_name").alias("p_name"), "p_size"), path, "csv")
    return so.read_csv(t.spark, path, ["p_partkey", "p_name", "p_size"])


@query("SELECT o_orderstatus, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(NULL AS VARCHAR) AS float FROM orders")
def projected_headers(t):
    return tb.project(tb.as_strings(t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")), ["o_orderstatus", "o_orderkey", "float"])


@query("SELECT p_partkey, key FROM (SELECT p_partkey, p_type || ' - ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN ' of it' ELSE '' END AS key FROM part) WHERE len(string_split(replace(key, ' - ', ' '), ' ')) > 3")
def long_keys(t):
    key = F.concat("p_type", F.lit(" - "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " of it").otherwise(""))
    return naming.long_keys(t.part.select("p_partkey", key.alias("key")), 3)


@query(f"WITH {TASKS} SELECT cluster, count(*) AS tasks, count(DISTINCT file) AS files, cluster || ' (' || count(*) || ' tasks, ' || count(DISTINCT file) || ' files)' AS title FROM tasks GROUP BY cluster")
def clusters_by_size(t):
    return drilldown.sorted_clusters(drilldown.annotate(tasks(t)), "size")


@query(f"""WITH {_E}, q AS (SELECT * FROM e WHERE id % 100 = 0), s AS (SELECT q.id AS query, e.id, round(list_cosine_similarity(q.vec, e.vec), 9) AS s FROM q JOIN e ON e.id <> q.id)
    SELECT query, id, round(s, 6) AS score FROM s WHERE s > 0.2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 10""")
def near_vectors_above(t):
    """The ten nearest with a score above a floor."""
    e = labelled(t).select("id", "vec")
    return vector_search.nearest(e.where("id % 100 = 0"), e, 10, floor=0.2).select("query", "id", F.round("score", 6).alias("score"))


_FORMS = """SELECT p_partkey, k, CASE k WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_brand WHEN 3 THEN ' -' || p_size || '_000 ' WHEN 4 THEN p_size || 'e-3' WHEN 5 THEN '.' || p_size WHEN 6 THEN p_size || '_' ELSE 'NaN' END AS token
    FROM part, unnest(range(8)) AS r(k)"""


@query(rf"""SELECT p_partkey, token, regexp_full_match(trim(token), '[+-]?[0-9]+(_[0-9]+)*') AS int, k IN (0, 1, 3, 4, 5, 7) AS float FROM ({_FORMS})""")
def number_tokens(t):
    s = F.col("p_size").cast("string")
    forms = [s, F.concat(s, F.lit(".5")), F.col("p_brand"), F.concat(F.lit(" -"), s, F.lit("_000 ")), F.concat(s, F.lit("e-3")), F.concat(F.lit("."), s), F.concat(s, F.lit("_")), F.lit("NaN")]
    return t.part.select("p_partkey", F.explode(F.array(*forms)).alias("token")).select("p_partkey", "token", tx.is_int(F.col("token")).alias("int"), tx.is_float(F.col("token")).alias("float"))


@query("""SELECT p_partkey, p_name || '- ' || p_type || '-x' AS key FROM part""")
def cleaned_keys(t):
    raw = F.concat(F.lit(" - <name> <number> "), "p_name", F.lit("&amp, "), "p_type", F.lit("/x"))
    return t.part.select("p_partkey", tx.clean_key(raw).alias("key"))


@query("SELECT CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT floor(n * p / 100) AS k FROM (SELECT count(*) AS n FROM part), unnest([2.5, 5, 7.5, 10, 12.5, 15, 17.5, 20]) AS u(p)) WHERE k > 1")
def cluster_counts_to_try(t):
    ks = ward.candidate_ks(t.part.count(), [2.5, 5.0, 7.5, 10.0, 12.5, 15.0, 17.5, 20.0])
    return t.spark.createDataFrame([(k,) for k in ks], "k int")


_KEYED = "keyed AS (SELECT p_partkey % 97 AS cluster, min(p_name) AS key FROM part GROUP BY 1)"


@query(f"""WITH RECURSIVE {_KEYED}, v AS (SELECT DISTINCT key AS t FROM keyed), s AS (SELECT a.t AS t1, b.t AS t2 FROM v a JOIN v b ON a.t <> b.t WHERE 2.0 * {_lcs('a.t', 'b.t')} / (length(a.t) + length(b.t)) >= 0.85),
    r(text, reach) AS (SELECT t, t FROM v UNION SELECT r.text, s.t2 FROM r JOIN s ON s.t1 = r.reach), c AS (SELECT text, min(reach) AS component FROM r GROUP BY 1),
    n AS (SELECT component, count(*) AS n FROM keyed JOIN c ON text = key GROUP BY 1)
    SELECT cluster, key FROM keyed JOIN c ON text = key JOIN n USING (component) WHERE n = 1""")
def unmerged_clusters(t):
    keyed = t.part.groupBy((F.col("p_partkey") % 97).alias("cluster")).agg(F.min("p_name").alias("key"))
    return naming.unmerged(keyed, 0.85)


@query("""SELECT o_orderstatus AS cluster, o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS id, 'task ' || o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 30 AS INTEGER) END AS planned_days,
    CAST(o_orderkey % 40 AS INTEGER) AS actual_days, 'f' || (o_orderkey % 9) AS file FROM orders""")
def result_documents(t):
    o, k = t.orders, F.col("o_orderkey")
    ident = k.cast("string").alias("id")
    clusters = o.select(F.col("o_orderstatus").alias("cluster"), F.col("o_orderpriority").alias("key"), ident, F.concat(F.lit("task "), F.col("o_custkey").cast("string")).alias("name"))
    planned, actual = o.where(k % 2 == 0).select(ident, (k % 30).cast("int").alias("planned_days")), o.select(ident, (k % 40).cast("int").alias("actual_days"))
    files = o.select(ident, F.concat(F.lit("f"), (k % 9).cast("string")).alias("file"))
    return sinks.parse_document(sinks.result_document(clusters, planned, actual, files)).select("cluster", "key", "id", "name", "planned_days", "actual_days", "file")


@query(f"""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part), m AS (SELECT p_partkey % 97 AS cluster, string_split(p_name, ' ') AS l FROM part), u AS (SELECT DISTINCT cluster, unnest(l) AS t FROM m)
    SELECT DISTINCT a.t AS t1, b.t AS t2, round(2.0 * {_lcs('a.t', 'b.t')} / (length(a.t) + length(b.t)), 6) AS score FROM u a JOIN u b ON a.cluster = b.cluster AND a.t < b.t""")
def meeting_token_scores(t):
    n = t.part.select((F.col("p_partkey") % 97).alias("cluster"), F.split("p_name", " ").alias("tokens"))
    return wp.token_scores(wp.meeting_tokens(n)).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 300000 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def updated_rows(t):
    """A stored copy of the table, updated in place."""
    path = Scratch(t.spark, "updated").root
    t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
    stored.update(t.spark, path, "o_orderpriority", F.col("o_totalprice") > 300000, {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)})
    return stored.read(t.spark, path).drop("o_orderpriority")


def _letter_counts():
    return lambda texts: [[x.count(c) for c in "abcde"] for x in texts]


@query("SELECT DISTINCT p_name, " + ", ".join(f"CAST(length(p_name) - length(replace(p_name, '{c}', '')) AS DOUBLE) AS {c}" for c in "abcde") + " FROM part")
def encoded_names(t):
    """An encoder of the caller's choice (here: letter counts) over distinct names."""
    found = encoding.encode_texts(t.part, "p_name", _letter_counts)
    return found.select("p_name", *(F.col("vec")[i].alias(c) for i, c in enumerate("abcde")))


def _plural_off():
    return lambda tokens: [x[:-1] if x.endswith("s") else x for x in tokens]


@query("SELECT DISTINCT token, CASE WHEN token LIKE '%s' THEN left(token, length(token) - 1) ELSE token END AS lemma FROM (SELECT unnest(string_split(lower(text), ' ')) AS token FROM documents)")
def lemmatised_tokens(t):
    """A lemmatiser of the caller's choice (here: without a last s) over distinct tokens."""
    return encoding.lemmas_of(t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token")), "token", _plural_off)
