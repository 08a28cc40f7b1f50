"""How far the sources of a language differ in the terms they use.

Mappers count terms with numpy, a row for each (language, source, term) of a slice.  Kept terms become wide
vectors: each term is pivoted into an array with a place for each source of its language.  JVM higher-order
functions emit a term's contribution to each pair of sources, and partial sums on the map side reduce them
to a row for each pair and task before anything is shuffled.

A source without the term has the same share for every such term, its base.  A pair's value is the number
of kept terms times the distance of the two bases, plus what terms add to that; only sources that have the
term (their share is not the base) emit, so a rare term costs its own sources times all and not all pairs.
Everything is computed in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taskweft.llm.words import Words
from taskweft.plans.scratch import Scratch

#: Word places that a mapper holds before it counts, and bytes that it cuts at once.
SLICE_WORDS, CUT_BYTES = 2_500_000, 4_000_000

_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def count_terms(df: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, summed over slices of a task only."""

    def run(batches):
        words, groups, of_doc, ids, waiting, here, size = Words(), {}, [], [], [], 0, 0

        def flush():
            found = np.concatenate(ids)
            docs = np.cumsum(found == 0)  # a stop stands before each document
            at = found > 0
            seen, n = np.unique(docs[at] - 1 << 32 | found[at] - 1, return_counts=True)
            key, at = np.unique(np.array(of_doc, np.int64)[seen >> 32] << 32 | seen & 0xFFFFFFFF, return_inverse=True)
            n, d = np.bincount(at, weights=n).astype(np.int64), np.bincount(at)
            names = list(groups)
            langs, sources = pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.string())
            terms = pa.array(words.raw, pa.binary()).cast(pa.string())
            for s in range(0, len(key), 20_000):
                k = key[s : s + 20_000]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(k >> 32)), sources.take(pa.array(k >> 32)), terms.take(pa.array(k & 0xFFFFFFFF)), pa.array(n[s : s + 20_000]), pa.array(d[s : s + 20_000])], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                of_doc.append(groups.setdefault((lang, source), len(groups)))
                waiting.append(b"!" + raw.as_py().translate(_BYTES))
                here += len(waiting[-1])
                if here >= CUT_BYTES:
                    ids.append(words.number(b"".join(waiting)))
                    size, waiting, here = size + len(ids[-1]), [], 0
                    if size >= SLICE_WORDS:
                        yield from flush()
                        words, groups, of_doc, ids, size = Words(), {}, [], [], 0
        if waiting or ids:
            ids.append(words.number(b"".join(waiting)))
            yield from flush()

    texts = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _share(count: str, total: str) -> F.Column:
    """1 + floor(1000000000 (count + 5) / (total + 5 terms)), in decimals: products pass 64 bits."""
    return F.expr(f"1 + (cast(1000000000 as decimal(10, 0)) * cast({count} + 5 as decimal(19, 0))) div cast({total} + 5 * terms as decimal(19, 0))")


def divergence(df: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources ('pair') and terms that stand out ('term').

    Terms are runs of ASCII letters and other characters beyond ASCII, A-Z lower-cased; each language keeps
    those in ``least_docs`` of its documents or more.  The ``top`` terms of each source are reported.

    Null texts, languages and sources count as empty strings.  Repeated rows count each.  A source without
    terms has pairs and no terms; a language of one source has no pairs; without kept terms all distances
    are 0.  Equal values rank by bytes.  An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "divergence")
    rows = count_terms(df, lang_col, source_col, text_col)
    counted = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    wide = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = scratch.cut(wide.where(F.col("docs") >= least_docs).select("lang", "term", "all", "by"))

    named = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for c, x in ((lang_col, "lang"), (source_col, "source")))).distinct()
    placed = named.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    totals = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = placed.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").select("lang", "source", "i", zero("terms"), zero("lang_total"), zero("total"))
    base = F.when(F.col("terms") > 0, _share("0", "total")).otherwise(0)
    groups = scratch.cut(groups.withColumn("base", base))

    long = kept.select("lang", "term", "all", F.explode("by").alias("x")).select("lang", "term", "all", "x.source", "x.n")
    shares = scratch.cut(long.join(groups, ["lang", "source"]).select("lang", "term", "source", "i", "base", _share("n", "total").alias("p"), _share("`all`", "lang_total").alias("q")))

    bases = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda x: x["base"]).alias("bases"))
    vectors = shares.where("p <> base").groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("i", "p"))).alias("live")).join(scratch.cut(bases), "lang")
    v = F.transform("bases", lambda b, i: F.coalesce(F.element_at("live", i), b))
    one = vectors.withColumn("v", v).select("lang", "v", "bases", F.explode("live").alias("i", "p"))
    more = F.transform("v", lambda x, j: F.when((j > F.col("i")) | ((j < F.col("i")) & (x == F.get("bases", j))), F.abs(F.col("p") - x) - F.abs(F.get("bases", F.col("i")) - F.get("bases", j))))
    added = one.select("lang", "i", F.posexplode(more).alias("j", "f")).where("f is not null").groupBy("lang", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(F.sum("f").alias("f"))

    a = groups.select("lang", "source", "i", "base", "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("base").alias("other"))
    pairs = a.join(b, "lang").where("i <> j").withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})  # what is asked for: every other source
    pair = pairs.join(scratch.cut(added), ["lang", "lo", "hi"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("terms") * F.abs(F.col("base") - F.col("other")) + F.coalesce("f", F.lit(0))).alias("value"))
    term = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pair.withColumn("rank", F.row_number().over(order)).unionByName(term.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def oracle(least_docs: int = 30, top: int = 50, table: str = "documents") -> str:
    """DuckDB twin, over a dense table of groups and terms."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    share = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * terms)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
    words AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
    kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= {least_docs}),
    counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    terms AS (SELECT lang, count(*) AS terms FROM kept GROUP BY 1),
    dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, terms FROM groups JOIN kept USING (lang) JOIN terms USING (lang) LEFT JOIN counts USING (lang, source, term)),
    p AS (SELECT lang, source, term, n, {share.format('n', 'sum(n) OVER (PARTITION BY lang, source)')} AS p,
                 {share.format('sum(n) OVER (PARTITION BY lang, term)', 'sum(n) OVER (PARTITION BY lang)')} AS q FROM dense),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
        UNION ALL
        SELECT lang, source, 'term' AS part, term AS item, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q QUALIFY rank <= {top})
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
    """
