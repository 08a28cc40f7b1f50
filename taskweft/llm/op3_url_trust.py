"""URL filter by propagation over the host graph.

Rules of the form (action, host, path) judge what they fit.  The rest is judged by its host: personalised
PageRank spreads trust from hosts with allowed pages along links, and distrust from hosts with blocked pages
against them (whoever links to a blocked host is suspect), over host-to-host edges weighted by the number
of linking pages.  A host is blocked when its distrust is more than ``ratio`` times its trust.

Links are read with SQL functions and summed to host edges before anything is shuffled; ranks, edges and
verdicts are distributed tables.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, functions as F

from taskweft.plans.scratch import Scratch

# The rules (action, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING = 0.85
#: Rounds that the DuckDB twin writes out.
ROUNDS = 12
#: Propagation ends when the scores of all hosts change by less than this in sum.
TOLERANCE = 1e-9
#: A host whose distrust is more than this many times its trust is blocked.
RATIO = 1.0
#: Distrust counts as more than trust where it is so by more than this share of it: scores are sums of doubles.
MARGIN = 1e-6
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
_LINK_HOST = "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def host_of_link(reference: Column) -> Column:
    """The host that a link names itself: after ``scheme://`` or ``//`` at its beginning, A-Z lower-cased; else empty.

    A ``://`` further on belongs to the link's path, query or fragment.
    """
    return F.translate(F.regexp_extract(reference, _LINK_HOST, 1), UPPER, LOWER)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): pages of src that link to another host dst. Relative links stay on their host."""
    found = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_HREF), F.lit(1)), host_of_link)
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.filter(found, lambda h: h != ""))).alias("dst"))
    return links.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def _rank(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, rounds: int | None) -> DataFrame:
    """Personalised PageRank: (host, score). edges: (src, dst, share), shares of a source sum to 1. seeds: (host, mass).

    A host without edges out keeps what it would pass on.  Without ``rounds`` it goes on until the scores
    change by less than TOLERANCE in sum.
    """
    score = seeds.select("host", F.col("mass").alias("score"))
    if edges.isEmpty() or seeds.isEmpty():  # nothing moves: a fixed point from the start
        return score
    dead = scratch.cut(seeds.select("host").unionByName(edges.select(F.col("dst").alias("host"))).distinct().join(edges.select(F.col("src").alias("host")).distinct(), "host", "left_anti"))
    last = None
    for _ in count() if rounds is None else range(rounds):
        passed = edges.join(score.withColumnRenamed("host", "src"), "src").select(F.col("dst").alias("host"), (F.lit(damping) * F.col("share") * F.col("score")).alias("score"))
        stayed = score.join(dead, "host", "left_semi").select("host", (F.lit(damping) * F.col("score")).alias("score"))
        back = seeds.select("host", (F.lit(1 - damping) * F.col("mass")).alias("score"))
        new = passed.unionByName(stayed).unionByName(back).withColumn("old", F.lit(0.0)).unionByName(score.select("host", F.lit(0.0).alias("score"), F.col("score").alias("old")))
        nxt = scratch.cut(new.groupBy("host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")))
        score = nxt.select("host", "score")
        change = nxt.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] if rounds is None else None
        if last is not None:
            scratch.drop(last)
        last = nxt
        if change is not None and change < TOLERANCE:
            break
    return score


def host_trust(judged: DataFrame, edges: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int | None = None, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, blocked) for hosts that trust or distrust reaches. judged: (host, action) a page."""
    counts = judged.groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("barred")).where("host <> '' and allowed + barred > 0")
    counts = scratch.cut(counts)
    sums = counts.agg(F.sum("allowed").alias("a"), F.sum("barred").alias("b")).first()
    seeds = lambda c, total: counts.where(F.col(c) > 0).select("host", (F.col(c) / F.lit(float(total or 1))).alias("mass"))
    edges = scratch.cut(edges)
    out_sum = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    in_sum = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    forward = scratch.cut(edges.join(out_sum, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    backward = scratch.cut(edges.join(in_sum, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("weight") / F.col("total")).alias("share")))
    trust = _rank(forward, seeds("allowed", sums["a"]), scratch, damping, rounds)
    distrust = _rank(backward, seeds("barred", sums["b"]), scratch, damping, rounds)
    both = trust.select("host", F.col("score").alias("trust")).join(distrust.select("host", F.col("score").alias("distrust")), "host", "full")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return both.select("host", t.alias("trust"), d.alias("distrust"), (d * (1 - MARGIN) > ratio * t).alias("blocked"))


def judge_urls(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int | None = None, ratio: float = RATIO, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust), one row for each row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path; no rule fits an empty host, and such
    pages, like those of hosts that neither trust nor distrust reaches, are allowed.  Null html has no
    links, very long html is read whole.  Repeated rows count as pages of their own.  An empty table gives no
    rows; other columns are not read, whatever their names.
    """
    scratch = Scratch(pages.sparkSession, "hosts")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, action = matched_rule(host, path, rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), action.alias("action"))
    trust = scratch.cut(host_trust(rows, host_edges(pages, url_col, html_col), scratch, damping, rounds, ratio))
    joined = rows.join(trust, "host", "left")
    verdict = F.coalesce("action", F.when(F.col("blocked"), F.lit("block")), F.lit("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def oracle(rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, ratio: float = RATIO, table: str = "pages") -> str:
    """DuckDB twin, with the rounds written out: (page_id, host, path, rule, verdict)."""
    whens = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, act) for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in whens) + " END"
    action = "CASE " + " ".join(f"WHEN {w} THEN '{a}'" for w, _, a in whens) + " END"
    host = f"coalesce(translate(regexp_extract({{0}}, '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    ctes = [
        f"urls AS (SELECT page_id, html, {host.format('url')} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM {table})",
        f"judged AS (SELECT page_id, html, host, path, {rule} AS rule, {action} AS action FROM urls)",
        """links AS (SELECT page_id, host, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS u FROM judged)""",
        f"named AS (SELECT DISTINCT page_id, host AS src, translate(regexp_extract(u, '{_LINK_HOST}', 1), '{UPPER}', '{LOWER}') AS dst FROM links)",
        "edges AS (SELECT src, dst, count(*) AS weight FROM named WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
    ]
    for name, act, a, b in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        ctes += [
            f"{name}e AS (SELECT {a} AS x, {b} AS y, weight / sum(weight) OVER (PARTITION BY {a}) AS share FROM edges)",
            f"{name}s AS (SELECT host, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM judged WHERE host <> '' AND action = '{act}') AS mass FROM judged WHERE host <> '' AND action = '{act}' GROUP BY host)",
            f"{name}0 AS (SELECT host, mass AS score FROM {name}s)",
        ]
        for k in range(rounds):
            ctes.append(
                f"{name}{k + 1} AS (SELECT host, sum(score) AS score FROM ("
                f"SELECT e.y AS host, {damping} * e.share * r.score AS score FROM {name}e e JOIN {name}{k} r ON e.x = r.host "
                f"UNION ALL SELECT host, {damping} * score FROM {name}{k} WHERE host NOT IN (SELECT x FROM {name}e) "
                f"UNION ALL SELECT host, {1 - damping} * mass FROM {name}s) GROUP BY host)"
            )
    ctes.append(
        f"hosts AS (SELECT coalesce(t.host, d.host) AS host, coalesce(d.score, 0) * {1 - MARGIN} > {ratio} * coalesce(t.score, 0) AS blocked FROM t{rounds} t FULL JOIN d{rounds} d ON t.host = d.host)"
    )
    return "WITH " + ",\n".join(ctes) + "\nSELECT page_id, j.host, path, rule, coalesce(action, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM judged j LEFT JOIN hosts h ON j.host = h.host"
