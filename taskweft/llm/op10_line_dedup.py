"""Line de-duplication by site-relative frequency.

Lines are counted per host: the share of a host's pages that contain the line.  Lines above the ratio are
the site's boilerplate and are dropped from its pages.  With ``distinct_pages`` pages of a host with equal
texts count once, so copies of a page do not make its lines boilerplate; that costs a shuffle more.

Only hashes of lines are shuffled, never texts.  The boilerplate of a host is short: no more than its mean
number of distinct lines a page divided by the ratio.  It is joined to the pages by host, as one array a
host; whether that table is broadcast is left to Catalyst's size check, and beyond it the join is by host,
where adaptive execution splits a host that holds a large part of all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskweft.llm.common import fresh
from taskweft.plans.scratch import Scratch


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_blank(line: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(line, "[\\t\\r\\x0B\\f]", " "))) == 0


def boilerplate(df: DataFrame, max_ratio: float, min_pages: int = 1, distinct_pages: bool = False, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """(host, lines): the hashes of each host's lines that stand on ``min_pages`` pages and more than ``max_ratio`` of all.

    Null hosts form a host of their own.  Null texts are no pages.  Blank lines are not counted.
    """
    pages = df.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    hashed = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_is_blank(x)), lambda x: F.xxhash64(x)))
    if distinct_pages:
        page = F.xxhash64("text").alias("page")
        counted = pages.select("host", page).distinct()
        lines = pages.select("host", page, F.explode(hashed).alias("line")).distinct()
    else:
        counted, lines = pages, pages.select("host", F.explode(hashed).alias("line"))
    totals = counted.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    on = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, min_pages))
    return (
        on.join(totals, on["host"].eqNullSafe(totals["host"]))
        .where(F.col("n") > max_ratio * F.col("pages"))
        .groupBy(on["host"])
        .agg(F.array_sort(F.collect_list("line")).alias("lines"))
    )


def drop_boilerplate(df: DataFrame, max_ratio: float = 0.1, min_pages: int = 1, distinct_pages: bool = False, host_col: str = "source", text_col: str = "text", count_col: str | None = None, chars_col: str | None = None) -> DataFrame:
    """``df`` with its host's boilerplate lines taken out of each text; all rows stay.

    Without ``min_pages`` every line of a host's only page is on all its pages and goes.  A page whose every line is boilerplate keeps an empty text; a null text stays null.  Blank lines and
    the order of lines are kept.  ``count_col`` adds the number of lines dropped (replacing a column of that
    name), ``chars_col`` is set to the new text's length.  Repeated rows and null ids are treated alike;
    other columns pass through, whatever their names; an empty table gives none.
    """
    scratch = Scratch(df.sparkSession, "lines")
    host, bad = fresh(df, "_host"), fresh(df, "_boilerplate")
    found = scratch.cut(boilerplate(df, max_ratio, min_pages, distinct_pages, host_col, text_col)).withColumnsRenamed({"host": host, "lines": bad})
    joined = df.join(found, F.col(f"`{host_col}`").cast("string").eqNullSafe(F.col(host)), "left")
    text = F.col(f"`{text_col}`").cast("string")
    kept = F.filter(_lines(text), lambda x: _is_blank(x) | ~F.array_contains(F.col(bad), F.xxhash64(x)))
    new = F.when(F.col(bad).isNull(), text).otherwise(F.array_join(kept, "\n"))
    out = {text_col: new}
    if chars_col:
        out[chars_col] = F.length(new).cast(df.schema[chars_col].dataType)
    cols = [(out[c] if c in out else F.col(f"`{c}`")).alias(c) for c in df.columns if not (count_col and c.lower() == count_col.lower())]
    if count_col:
        dropped = F.when(F.col(bad).isNull(), 0).otherwise(F.size(_lines(text)) - F.size(kept))
        cols.append(F.coalesce(dropped, F.lit(0)).cast("long").alias(count_col))
    return joined.select(*cols)


def oracle(max_ratio: float, min_pages: int = 1, distinct_pages: bool = False, table: str = "documents") -> str:
    """DuckDB twin: (doc_id, n_dropped, text)."""
    blank = "length(trim(regexp_replace({0}, '[\\t\\r\\x0B\\f]', ' ', 'g'))) = 0"
    return f"""
    WITH pages AS ({"SELECT DISTINCT source, text, 0 AS page" if distinct_pages else "SELECT source, text, row_number() OVER () AS page"} FROM {table} WHERE text IS NOT NULL),
    totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
    lines AS (SELECT DISTINCT source, text, page, unnest(string_split(text, chr(10))) AS line FROM pages),
    bad AS (
        SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
        WHERE NOT ({blank.format("l.line")})
        GROUP BY l.source, l.line, t.pages HAVING count(*) >= {min_pages} AND count(*) > {max_ratio} * t.pages),
    lists AS (SELECT source, list(line) AS bad FROM bad GROUP BY source),
    cut AS (
        SELECT d.doc_id, string_split(d.text, chr(10)) AS lines,
               list_filter(string_split(d.text, chr(10)), lambda x: NOT coalesce(list_contains(b.bad, x), false)) AS kept
        FROM {table} d LEFT JOIN lists b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM cut
    """
