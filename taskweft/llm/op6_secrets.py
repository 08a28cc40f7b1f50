"""Secret scan with multipart credential linking, in SQL functions only.

Three base kinds are reported wherever they stand: ``assign``, ``access`` and ``hex``.  Weak candidates
(identifiers such as ``user=...``, short or bare secrets, endpoints) mean little alone.  They are spans too,
and an interval join within scopes links them: two parts belong together when no more than ``scope``
characters lie between them.  A weak secret is reported when an identifier shares its scope, a weak
identifier when a secret does, an endpoint when both do.

The join is on the document and a grid of scope-wide cells, so each span meets only its own and the two
neighbouring cells; spans of one kind do not overlap, so a cell holds few of them, however long the text.
Texts are scanned once and never shuffled; only spans are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskweft.plans.scratch import Scratch

# The kinds in their order, their patterns (one group inside, or none) and the least length
# of that group, or of the whole match without one.
KINDS = ["assign", "access", "hex", "ident", "weak", "bare", "endpoint"]
BASE = 3
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    "access": (r"(AKIA[A-Z0-9]+)", 16),
    "hex": (r"([0-9a-f]{32,})", 32),
    "ident": (r"""(?<![A-Za-z0-9_])(?i:(?:user|username|user_?id|login|account|client_?id|access_?key_?id|key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 3),
    "weak": (r"""(?<![A-Za-z0-9_])(?i:(?:pass|pwd|key|auth|credential|private_?key|signature))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 4),
    "bare": (r"(?<![A-Za-z0-9+/_.=-])((?=[A-Za-z+/]*[0-9])(?=[0-9a-z+/]*[A-Z])[A-Za-z0-9+/]{20,}={0,2})", 20),
    "endpoint": (r"""(?<![A-Za-z0-9_])(?i:(?:https?|ftps?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://)([^\s"'<>]+)""", 3),
}
#: A plain string that every match of the kind holds; texts without it are not searched.
NEEDS = {"access": "AKIA", "endpoint": "://"}
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "ident"), ("assign", "hex", "weak", "bare"), ("endpoint",)
SCOPE = 300


def _running(lengths: Column) -> Column:
    """Running sums of an array, by parts of the square root of its size: appending copies an array each time."""
    append = lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
    sums = lambda part, start: F.aggregate(part, F.array(start), append)
    zero = F.lit(0).cast("long")
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(lengths))).cast("int"))
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), step)).otherwise(F.array().cast("array<int>"))
    parts = F.transform(starts, lambda at: F.slice(lengths, at, step))
    before = sums(F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, n: a + n)), zero)
    return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, start: F.slice(sums(p, start), F.lit(2), F.size(p))))


def _spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end>> of one kind's matches, leftmost and not overlapping, in code points.

    Each match is extracted with the text before it, so the running sum of lengths gives the positions.
    """
    pattern, least = PATTERNS[kind]
    with_gap = F.lit(rf"\G(?s:(.*?))({pattern})")  # \G: each starts where the last ended, so the rest after the last match is read once
    lengths = F.transform(F.regexp_extract_all(text, with_gap, F.lit(0)), lambda s: F.length(s).cast("long"))
    found = F.arrays_zip(_running(lengths).alias("end"), F.regexp_extract_all(text, with_gap, F.lit(2)).alias("match"), F.regexp_extract_all(text, with_gap, F.lit(3)).alias("value"))
    long_enough = F.filter(found, lambda x: F.length(x["value"]) >= least)
    spans = F.transform(long_enough, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), (x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end")))
    there = text.rlike(pattern)
    if kind in NEEDS:
        there = text.contains(NEEDS[kind]) & there
    return F.when(there, spans).otherwise(F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>"))


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, kind, start, end): all spans, and one row of kind -1 for each row of ``df``.

    ``key`` is a hash of id and text: rows that repeat both are told apart from others, not from each other.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    marker = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")))
    return df.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), F.explode(F.concat(marker, *(_spans(text, k) for k in KINDS))).alias("s")).select("doc_id", "key", "s.kind", "s.start", "s.end")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans (doc_id, key, kind, start, end) whose complementary parts share their scope."""
    at = lambda kinds: F.col("kind").isin([KINDS.index(k) for k in kinds])
    role = F.when(at(IDENTIFIERS), 1).when(at(SECRETS), 2).when(at(ENDPOINTS), 3)
    parts = spans.where("kind >= 0").distinct().withColumn("role", role)
    weak = parts.where(F.col("kind") >= BASE)
    # a span lies in every cell that it, widened by half a scope, touches; the pair is taken in one cell only
    half = scope // 2 + 1
    first, last = F.floor((F.col("start") - half) / scope), F.floor((F.col("end") + half) / scope)
    cells = lambda f: f.withColumn("cell", F.explode(F.sequence(first, last)))
    others = cells(parts).select(F.col("key").alias("k2"), F.col("doc_id").alias("d2"), "cell", F.col("role").alias("role2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    near = (F.col("s2") <= F.col("end") + scope) & (F.col("start") <= F.col("e2") + scope) & (F.col("role") != F.col("role2"))
    # the same characters are one part: a weak reading of a base span does not support itself
    apart = (F.col("e2") <= F.col("start")) | (F.col("end") <= F.col("s2"))
    met = cells(weak).withColumnRenamed("cell", "c").join(others, (F.col("key") == F.col("k2")) & (F.col("c") == F.col("cell")) & F.col("doc_id").eqNullSafe(F.col("d2")) & near & apart)
    judged = met.groupBy("doc_id", "key", "kind", "start", "end", "role").agg(F.max((F.col("role2") == 1).cast("int")).alias("ids"), F.max((F.col("role2") == 2).cast("int")).alias("keys"))
    complete = F.when(F.col("role") == 1, F.col("keys")).when(F.col("role") == 2, F.col("ids")).otherwise(F.least("ids", "keys"))
    return judged.where(complete == 1).select("doc_id", "key", "kind", "start", "end")


def scan_secrets(df: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, base): for each row of ``df`` its spans array<struct<start, kind, end>>, in order of start, then kind.

    ``base`` holds the base kinds only.  Positions are code points, the end exclusive.  Null and empty texts
    have no spans; rows with null or repeated ids are judged each by their own text; repeated rows come
    back as often; an empty table gives none; other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "secrets")
    found = scratch.cut(find_spans(df, id_col, text_col))
    reported = found.where(F.col("kind") < BASE).unionByName(link_parts(found, scope))
    span = F.struct("start", "kind", "end")
    whole = reported.groupBy("doc_id", "key").agg(F.count_if(F.col("kind") == -1).alias("rows"), F.array_sort(F.collect_set(F.when(F.col("kind") >= 0, span))).alias("spans"))
    each = whole.select("doc_id", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    return each.select("doc_id", "spans", F.filter("spans", lambda s: s["kind"] < BASE).alias("base"))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
