"""Queries over task names: a part's name, type, brand and size make a dirty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskweft.functions import similarity as sim, text as tx
from taskweft.operators import naming, similarity_join as sj, stats, words_pairs as wp
from taskweft.plans.scratch import Scratch
from taskweft.plans.registry import Tables, query

_NAME = "p_name || ' - ' || p_type || ' ' || p_brand || '/' || p_size"


def names(t: Tables) -> DataFrame:
    """(id, cluster, name)."""
    name = F.concat("p_name", F.lit(" - "), "p_type", F.lit(" "), "p_brand", F.lit("/"), F.col("p_size").cast("string"))
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("cluster"), name.alias("name"))


def _normal(c: str) -> str:
    punctuation = tx.PUNCTUATION.replace("'", "''")
    step = f"CASE WHEN regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') THEN replace(acc, t, '<name>') WHEN regexp_matches(t, '[0-9]') THEN replace(acc, t, '<number>') WHEN regexp_matches(t, '{punctuation}') THEN replace(acc, t, '<name>') ELSE acc END"
    return f"replace(replace(list_reduce(string_split({c}, ' '), lambda acc, t: {step}, {c}), '<name> <name>', '<name>'), '<number> <number>', '<number>')"


def _tokens(c: str, pattern: str = tx.TOKEN) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '{pattern}'), lambda x: lower(x)), lambda x: length(x) > 1)"


def _unique(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


NAMES = f"names AS (SELECT p_partkey AS id, p_type AS cluster, {_NAME} AS name FROM part), normal AS (SELECT *, {_normal('name')} AS n FROM names)"
TOKENS = NAMES + f", tok AS (SELECT id, cluster, name, {_tokens('n')} AS tokens FROM normal)"
VOCABULARY = "voc AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part)"


def _lcs(a: str, b: str) -> str:
    inner = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN substr({a}, i[1], 1) = substr({b}, j[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[j[1]]) END), [0::BIGINT])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [i]), lambda prev, i: {inner}, list_transform(range(length({b}) + 1), lambda j: 0::BIGINT))[-1]"


SCORES = VOCABULARY + f", scores AS (SELECT a.t AS t1, b.t AS t2, 2.0 * {_lcs('a.t', 'b.t')} / (length(a.t) + length(b.t)) AS score FROM voc a JOIN voc b ON a.t < b.t)"


@query(f"WITH {NAMES} SELECT id, n AS normal FROM normal")
def normalize_names(t):
    return names(t).select("id", tx.normalize(F.col("name")).alias("normal"))


@query(f"WITH {TOKENS} SELECT id, array_to_string(tokens, ' ') AS tokens FROM tok")
def tokenize_names(t):
    return names(t).select("id", F.array_join(tx.tokenize(F.col("name")), " ").alias("tokens"))


@query(f"WITH {TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM tok) GROUP BY 1")
def token_counts(t):
    return stats.token_counts(names(t).select(tx.tokenize(F.col("name")).alias("tokens")))


@query(f"""WITH {TOKENS}, u AS (SELECT {_unique('tokens')} AS tokens FROM tok), p AS (SELECT unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM u),
    c AS (SELECT token, pos, count(*) AS n FROM p GROUP BY ALL) SELECT token, CAST(pos AS INTEGER) AS pos FROM c QUALIFY row_number() OVER (PARTITION BY token ORDER BY n DESC, pos) = 1""")
def typical_positions(t):
    return stats.typical_positions(names(t).select(tx.tokenize(F.col("name"), unique=True).alias("tokens")))


@query("""SELECT p_partkey, array_to_string(list_concat(list_filter(l, lambda x: NOT contains(x, '#')), flatten(list_transform(list_filter(l, lambda x: contains(x, '#')), lambda x: string_split(x, '#')))), ' ') AS tokens
    FROM (SELECT p_partkey, string_split(p_brand || ' ' || p_name, ' ') AS l FROM part)""")
def split_tokens(t):
    tokens = F.split(F.concat_ws(" ", "p_brand", "p_name"), " ")
    return t.part.select("p_partkey", F.array_join(tx.split_tokens(tokens, "#"), " ").alias("tokens"))


@query(f"WITH {NAMES} SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(name, ' - |/|\\(|\\)|\\[|\\]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM names")
def name_parts(t):
    return names(t).select("id", F.array_join(tx.name_parts(F.col("name")), "|").alias("parts"))


@query("""SELECT p_partkey, regexp_full_match(p_type, '[A-Z]*') AS upper, regexp_matches(p_brand, '[A-Z]') AS any_upper FROM part""")
def upper_tests(t):
    return t.part.select("p_partkey", tx.all_upper(F.col("p_type")).alias("upper"), tx.any_upper(F.col("p_brand")).alias("any_upper"))


@query("""WITH w AS (SELECT p_partkey, p_type, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[-1] AS b FROM part), c AS (SELECT *, upper(p_type[1]) || lower(p_type[2:]) AS t, upper(a[1]) || a[2:] AS x, upper(b[1]) || b[2:] AS y FROM w)
    SELECT p_partkey, t || ' ' || x || ' ' || y AS lowered, p_type || ' ' || upper(a) || ' ' || CASE WHEN a = b THEN upper(b) ELSE y END AS restored FROM c""")
def restored_upper(t):
    """Capitalised words, and those of them restored that occur in upper case."""
    words = F.split("p_name", " ")
    a, b = F.element_at(words, 1), F.element_at(words, -1)
    low = t.part.select("p_partkey", F.array(F.initcap("p_type"), F.initcap(a), F.initcap(b)).alias("lowered"), tx.upper_map(F.array(F.col("p_type"), F.upper(a), b)).alias("m"))
    return low.select("p_partkey", F.array_join("lowered", " ").alias("lowered"), F.array_join(tx.restore_upper(F.col("lowered"), F.col("m")), " ").alias("restored"))


@query("""SELECT doc_id, CAST(len(string_split(text, ' - ')) - 1 AS INTEGER) AS hyphens, contains(text, chr(65533)) AS broken FROM documents""")
def hyphen_counts(t):
    return t.documents.select("doc_id", tx.hyphens(F.col("text")).alias("hyphens"), (F.length(tx.strip_replacement_char(F.col("text"))) != F.length("text")).alias("broken"))


@query("""WITH w AS (SELECT p_partkey, CASE k WHEN 0 THEN p_size || 'mm' WHEN 1 THEN p_size || 'm' WHEN 2 THEN p_size || 'kV' WHEN 3 THEN p_type WHEN 4 THEN 'a.' || p_size ELSE p_brand END AS token FROM part, unnest(range(6)) AS r(k))
    SELECT p_partkey, token, CASE WHEN regexp_full_match(token, '(?i)[0-9]+(\\.[0-9]+)?(mm|cm|km)') THEN 'metric' WHEN regexp_full_match(token, '(?i)[0-9]+(\\.[0-9]+)?m') THEN 'meters' WHEN regexp_full_match(token, '(?i)[0-9]+(\\.[0-9]+)?k?v') THEN 'volts'
    WHEN regexp_full_match(token, '[A-Za-z]+') THEN 'letters' WHEN regexp_full_match(token, '[0-9A-Za-z_]+(\\.[0-9A-Za-z_]+)+') THEN 'dotted' ELSE 'other' END AS class FROM w""")
def token_classes(t):
    s = F.col("p_size").cast("string")
    w = t.part.select("p_partkey", F.explode(F.array(F.concat(s, F.lit("mm")), F.concat(s, F.lit("m")), F.concat(s, F.lit("kV")), F.col("p_type"), F.concat(F.lit("a."), s), F.col("p_brand"))).alias("token"))
    return w.select("p_partkey", "token", tx.token_class(F.col("token")).alias("class"))


@query("""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace('mail c' || c_custkey || '@shop.example.com on 2024-01-0' || (c_custkey % 9 + 1) || ' for ' || c_nationkey || ' by www.' || lower(c_mktsegment) || '.org',
    '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<email>', 'g'), 'https?://[^\\s<>]+|www\\.[^\\s<>]+', '<link>', 'g'), '\\b\\d{1,4}[/-]\\d{1,2}[/-]\\d{1,4}\\b', '<date>', 'g'), '\\b\\d+(\\.\\d+)?\\b', '<number>', 'g') AS tagged FROM customer""")
def tagged_entities(t):
    text = F.concat(F.lit("mail c"), F.col("c_custkey").cast("string"), F.lit("@shop.example.com on 2024-01-0"), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit(" for "), F.col("c_nationkey").cast("string"), F.lit(" by www."), F.lower("c_mktsegment"), F.lit(".org"))
    return t.customer.select("c_custkey", tx.tag_entities(text).alias("tagged"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || '-' || p_brand || '.' || p_type, '[/.,-]'), lambda x: regexp_replace(x, '[0-9]', '', 'g')), lambda x: length(x) > 1), '|') AS pieces FROM part""")
def split_digit_tokens(t):
    text = F.concat("p_name", F.lit("-"), "p_brand", F.lit("."), "p_type")
    return t.part.select("p_partkey", F.array_join(tx.split_digits(text), "|").alias("pieces"))


@query("""SELECT c_custkey, replace(replace(c_name, '&amp', ''), '_', ' ') AS label, 'Customer ' || c_nationkey AS company FROM customer""")
def cleaned_labels(t):
    file = F.concat(F.lit("Customer "), F.col("c_nationkey").cast("string"), F.lit("_2023-04-19.csv"))
    return t.customer.select("c_custkey", tx.clean_label(F.col("c_name")).alias("label"), tx.company_of_file(file).alias("company"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM part")
def capitalised(t):
    return t.part.select("p_partkey", tx.capwords(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "  "))).alias("title"))


@query(f"WITH {SCORES} SELECT t1, t2, round(score, 6) AS score FROM scores")
def edit_ratio_all(t):
    v = t.part.select(F.explode(F.split("p_name", " ")).alias("token"))
    return sj.edit_pairs(v, "token").withColumn("score", F.round("score", 6))


@query(f"WITH v AS (SELECT DISTINCT p_name AS t FROM part), s AS (SELECT a.t AS t1, b.t AS t2, 2.0 * {_lcs('a.t', 'b.t')} / (length(a.t) + length(b.t)) AS score FROM v a JOIN v b ON a.t < b.t) SELECT t1, t2, round(score, 6) AS score FROM s WHERE score >= 0.8")
def edit_ratio_pairs(t):
    return sj.edit_pairs(t.part, "p_name", 0.8).withColumn("score", F.round("score", 6))


@query(f"""WITH {SCORES}, b AS (SELECT t1, t2, score FROM scores UNION ALL SELECT t2, t1, score FROM scores UNION ALL SELECT t, t, 1.0 FROM voc) SELECT t1, t2, round(score, 6) AS score FROM b""")
def edit_matrix(t):
    v = t.part.select(F.explode(F.split("p_name", " ")).alias("token"))
    return sj.symmetric(sj.edit_pairs(v, "token"), diagonal=1.0).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE v AS (SELECT DISTINCT p_name AS t FROM part), s AS (SELECT a.t AS t1, b.t AS t2 FROM v a JOIN v b ON a.t <> b.t WHERE 2.0 * {_lcs('a.t', 'b.t')} / (length(a.t) + length(b.t)) >= 0.85),
    r(text, reach) AS (SELECT t, t FROM v UNION SELECT r.text, s.t2 FROM r JOIN s ON s.t1 = r.reach) SELECT text, min(reach) AS component FROM r GROUP BY 1""")
def key_components(t):
    return sj.text_components(t.part, "p_name", 0.85)


@query(f"""WITH RECURSIVE v AS (SELECT DISTINCT p_name AS t FROM part), s AS (SELECT a.t AS t1, b.t AS t2 FROM v a JOIN v b ON a.t <> b.t WHERE 2.0 * {_lcs('a.t', 'b.t')} / (length(a.t) + length(b.t)) >= 0.85),
    r(text, reach) AS (SELECT t, t FROM v UNION SELECT r.text, s.t2 FROM r JOIN s ON s.t1 = r.reach), c AS (SELECT text, min(reach) AS component FROM r GROUP BY 1)
    SELECT component, list_sort(list(DISTINCT p_partkey)) AS members FROM part JOIN c ON c.text = p_name GROUP BY 1""")
def component_members(t):
    c = t.part.select(F.col("p_name").alias("key"), F.col("p_partkey").alias("member"))
    return sj.component_members(c, sj.text_components(t.part, "p_name", 0.85))


def _pair_names(t: Tables) -> DataFrame:
    """(cluster, id, tokens): parts in 97 clusters by key."""
    return t.part.select((F.col("p_partkey") % 97).alias("cluster"), F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens"))


_PAIRS = SCORES + """, n AS (SELECT p_partkey % 97 AS cluster, p_partkey AS id, string_split(p_name, ' ') AS tokens FROM part),
    pairs AS (SELECT a.cluster, a.id AS id1, b.id AS id2, a.tokens AS x, b.tokens AS y FROM n a JOIN n b ON a.cluster = b.cluster AND a.id < b.id),
    prod AS (SELECT cluster, id1, id2, x, unnest(y) AS y FROM (SELECT cluster, id1, id2, unnest(x) AS x, y FROM pairs)),
    sc AS (SELECT p.*, CASE WHEN x = y THEN 1.0 ELSE coalesce(s.score, 0) END AS score FROM prod p LEFT JOIN scores s ON s.t1 = least(x, y) AND s.t2 = greatest(x, y)),
    cs AS (SELECT sz.cluster, s / tokens AS score FROM (SELECT cluster, sum(score) AS s FROM sc GROUP BY 1) q JOIN (SELECT cluster, sum(len(x) + len(y)) AS tokens FROM pairs GROUP BY 1) sz ON sz.cluster = q.cluster)"""


def _scores(t: Tables) -> DataFrame:
    return sj.edit_pairs(t.part.select(F.explode(F.split("p_name", " ")).alias("token")), "token")


def _met_scores(t: Tables) -> DataFrame:
    """Scores of the tokens that meet in a cluster; no other pair is asked for."""
    return Scratch(t.spark, "scores").cut(wp.token_scores(wp.meeting_tokens(_pair_names(t))))


@query(f"WITH {_PAIRS} SELECT cluster, round(score, 6) AS score FROM cs")
def words_pairs_score(t):
    return wp.cluster_scores(_pair_names(t)).withColumn("score", F.round("score", 6))


@query(f"WITH {_PAIRS} SELECT round(sum(score), 2) AS words_pairs FROM cs")
def words_pairs_total(t):
    return wp.run_score(wp.cluster_scores(_pair_names(t)))


@query(f"WITH {_PAIRS} SELECT round(avg(s / n), 6) AS mean_score FROM (SELECT cluster, sum(score) AS s FROM sc GROUP BY 1) JOIN (SELECT cluster, sum(len(tokens)) AS n FROM n GROUP BY 1) USING (cluster)")
def words_pairs_mean(t):
    return wp.mean_cluster_score(_pair_names(t), _met_scores(t)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"""WITH {_PAIRS}, o AS (SELECT cluster, id1, id2, x, score FROM sc UNION ALL SELECT cluster, id2, id1, y, score FROM sc), b AS (SELECT cluster, id1, id2, x, max(score) AS best FROM o GROUP BY ALL)
    SELECT cluster, round(sum(best) / count(*), 6) AS score FROM b GROUP BY 1""")
def words_pairs_best(t):
    return wp.max_per_token(_pair_names(t), _met_scores(t)).withColumn("score", F.round("score", 6))


@query("SELECT l_orderkey AS cluster, min(l_returnflag) AS name FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def uniform_clusters(t):
    return naming.uniform_clusters(t.lineitem.select(F.col("l_orderkey").alias("cluster"), F.col("l_returnflag").alias("name")))


@query("SELECT p_brand AS cluster, arg_min(p_name, (abs(length(p_name) - 9), p_name)) AS name FROM part GROUP BY 1")
def nearest_length_names(t):
    return naming.nearest_length_match(t.part.select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name")), 9)


@query()
def cluster_keys(t):
    return naming.key_clusters(names(t).select("cluster", "name"))


@query()
def merged_cluster_keys(t):
    members = t.part.select(F.col("p_brand").alias("cluster"), F.col("p_name").alias("name"))
    return naming.merge_similar(members, Scratch(t.spark, "keys").cut(naming.key_clusters(members)), None, 0.9)


@query()
def leader_clusters(t):
    return sj.leader_clusters(t.part, "p_name", 0.7, 1.0)


@query()
def similar_names(t):
    return sj.similar_to(t.part, "p_name", "small ring", 0.6, 1.0)


@query("SELECT token FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part) WHERE token NOT IN (SELECT DISTINCT unnest(string_split(lower(text), ' ')) FROM documents)")
def unknown_tokens(t):
    v = t.part.select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    known = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct()
    return v.join(known, "token", "left_anti")


@query("SELECT p_partkey, 2.0 * length(p_name) / (length(p_name) + length(p_type)) >= 0.8 AS reachable FROM part WHERE length(p_name) <= length(p_type)")
def reachable_lengths(t):
    return t.part.where("length(p_name) <= length(p_type)").select("p_partkey", sim.ratio_reachable(F.col("p_name"), F.col("p_type"), 0.8).alias("reachable"))


@query(f"WITH {SCORES}, keep AS (SELECT t FROM voc WHERE t <> 'bolt') SELECT t1, t2, round(score, 6) AS score FROM scores WHERE t1 IN (SELECT t FROM keep) AND t2 IN (SELECT t FROM keep)")
def restricted_scores(t):
    v = t.part.select(F.explode(F.split("p_name", " ")).alias("token")).where("token <> 'bolt'")
    return wp.restrict(_scores(t), v).withColumn("score", F.round("score", 6))


@query(f"""WITH {SCORES}, v AS (SELECT t AS token, [length(t)::DOUBLE, ascii(t)::DOUBLE] AS vec FROM voc), d AS (SELECT a.token AS t1, b.token AS t2, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.token < b.token)
    SELECT s.t1, s.t2, round(s.score, 6) AS edit_score, round(1 - d / (SELECT max(d) FROM d), 6) AS embed_score FROM scores s JOIN d ON d.t1 = s.t1 AND d.t2 = s.t2""")
def pair_matrices(t):
    tokens = t.part.select(F.explode(F.split("p_name", " ")).alias("token")).distinct()
    v = tokens.select("token", F.array(F.length("token").cast("double"), F.ascii("token").cast("double")).alias("vec"))
    return wp.pair_matrices(tokens, v).select("t1", "t2", F.round("edit_score", 6).alias("edit_score"), F.round("embed_score", 6).alias("embed_score"))


@query("""WITH s AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS token, string_split(p_name, ' ')[-1] AS synonym FROM part), v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part WHERE p_size < 40)
    SELECT token, synonym FROM s WHERE token <> synonym AND token IN (SELECT token FROM v)""")
def synonyms(t):
    """A name's last word as a synonym of its first, for the tokens of names of some sizes."""
    words = F.split("p_name", " ")
    table = t.part.select(F.element_at(words, 1).alias("token"), F.element_at(words, -1).alias("synonym"))
    return wp.expand_synonyms(t.part.where("p_size < 40").select(F.explode(words).alias("token")), table)


_LEMMA = "CASE WHEN length(token) % 2 = 0 THEN token ELSE left(token, length(token) - 3) END"


@query(f"SELECT token FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS token FROM documents) WHERE token LIKE '%ing' AND token = {_LEMMA}")
def unchanged_by_lemma(t):
    """Tokens in -ing that a table of lemmas (here: of even length) leaves as they are."""
    tokens = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token"))
    return wp.same_as_lemma(tokens, tokens.distinct().where("token LIKE '%ing'").withColumn("lemma", F.expr(_LEMMA)))
