"""Near-duplicate documents by one-permutation MinHash.

1. A document's words give its set of hashed word shingles.  One hash permutation cut into ``bins`` equal
   ranges gives one minimum a bin; an empty bin takes the value of the first filled bin in a probing order
   of its own (optimal densification).  Documents with equal sets form one class, whose smallest id goes on.
2. Bands of ``rows`` bins are hashed to buckets.  In each bucket one centre is elected, the member that
   meets the most others in its buckets (in every other band: the one with the smallest hash), and each
   other member is paired with it: a star, so a bucket of n gives n - 1 candidate pairs.  Pairs whose set
   sizes rule the threshold out are dropped.
3. The candidates' full sets are compared, and the links are joined to components.
4. The exact rest: a star can miss a link between two members that are not linked with its centre.  So the
   members of a bucket that still holds several components are compared with each other, too.  They are
   sorted so that members of the same buckets are neighbours, and cut into tiles of bounded size; two tiles
   that share a bucket are compared in one step, by a matrix product of their sets' incidences where many
   pairs are open, pair by pair where few are.  No pair becomes a row: a pair of tiles returns one row for
   each member with a link.

So no two documents that share a bucket and lie in different components stay uncompared.  No bucket is capped
and no member dropped; sets, links and labels stay in distributed tables.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from taskweft.llm.common import connect, map_rows, per_task
from taskweft.plans.components import connected_components
from taskweft.plans.scratch import Scratch

BINS = 256
#: Documents in a tile of the exact rest, and the bytes that a set takes there on average, at most.
TILE, SET_BYTES = 1024, 4096
#: Columns of an incidence matrix, and the multiplications that take the time of comparing two sets.
COLUMNS, PAIR_COST = 2048, 200_000
#: Words whose hashes a task remembers; the memo is emptied when it holds more.
MEMO_WORDS = 100_000
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


class _Words(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; fewer words give one shingle, none an empty set."""
    tokens = (text or "").encode().translate(_UPPER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(acc)


def probing_order(bins: int) -> np.ndarray:
    """For each bin, a permutation of all bins (fixed seed)."""
    draw = np.random.default_rng(20_170_811)
    return np.argsort(draw.random((bins, bins)), axis=1).astype(np.int64)


def signature(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """One minimum a bin of a sorted, non-empty set; ``bins`` is a power of two."""
    bins = len(probes)
    which = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], which[1:] != which[:-1]])
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[which[first]] = hashes[first]
    filled[which[first]] = True
    empty = np.flatnonzero(~filled)
    for lo, hi in ((0, 8), (8, 64), (64, bins)):
        if not len(empty):
            break
        tries = probes[empty, lo:hi]
        hit = filled[tries]
        got = hit.any(axis=1)
        out[empty[got]] = out[tries[got, hit[got].argmax(axis=1)]]
        empty = empty[~got]
    return out


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = len(sig) // rows
    parts = sig[: bands * rows].reshape(bands, rows)
    acc = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return acc.view(np.int64)


def set_sketches(docs: DataFrame, words: int, rows: int, bins: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) for (doc_id, text); the key is null for an empty set."""

    @per_task
    def task():
        memo, probes = _Words(), probing_order(bins)

        def work(ids, texts):
            sets = [shingle_set(t, words, memo) for t in texts]
            return {
                "doc_id": ids,
                "n_shingles": [len(s) for s in sets],
                "set_key": [_digest(s.tobytes()) if len(s) else None for s in sets],
                "bands": [band_hashes(signature(s, probes), rows) if len(s) else [] for s in sets],
            }

        return work

    return map_rows(docs, "doc_id long, n_shingles long, set_key binary, bands array<long>", task)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(key, hashes): the sorted sets of the classes ``wanted`` (key, rep, set_key) as packed 64-bit integers."""

    @per_task
    def task():
        memo = _Words()

        def work(keys, set_keys, texts):
            sets = [shingle_set(t, words, memo).tobytes() for t in texts]
            # a document id that repeats with another text is not this class
            return {"key": keys, "hashes": [s if _digest(s) == k else None for s, k in zip(sets, set_keys, strict=True)]}

        return work

    rows = docs.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("key", "set_key", "text")
    return map_rows(rows, "key long, hashes binary", task).where("hashes is not null").dropDuplicates(["key"])


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ha", "hb")

    def run(batches):
        for batch in batches:
            keep = []
            for ha, hb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(ha.as_buffer(), np.uint64), np.frombuffer(hb.as_buffer(), np.uint64)
                common = _in_common(x, y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


# -- the exact rest -----------------------------------------------------------------------------------------


def _pack_tiles(rest: DataFrame, docs: int, size: int) -> DataFrame:
    """Runs of members in the order of ``rest`` as one row each, of ``docs`` sets and ``docs * size`` bytes at most (or one set)."""

    def run(batches):
        part, number, held, weight = TaskContext.get().partitionId(), 0, [], 0

        def emit(rows):
            nonlocal number
            number += 1
            labels = np.array([r[1] for r in rows])
            buckets = [np.sort(np.asarray(r[2], np.int64)) for r in rows]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + number], pa.int64()),
                    pa.array([int(labels.min())], pa.int64()),
                    pa.array([int(labels.max())], pa.int64()),
                    pa.array([np.unique(np.concatenate(buckets)).tolist()], pa.list_(pa.int64())),
                    pa.array([np.array([r[0] for r in rows]).tobytes()], pa.binary()),
                    pa.array([labels.tobytes()], pa.binary()),
                    pa.array([[b.tobytes() for b in buckets]], pa.list_(pa.binary())),
                    pa.array([[r[3] for r in rows]], pa.list_(pa.binary())),
                ],
                names=["tile", "lo", "hi", "all_buckets", "keys", "labels", "buckets", "sets"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (len(held) == docs or weight + len(row[3]) > docs * size):
                    yield emit(held)
                    held, weight = [], 0
                held.append(row)
                weight += len(row[3])
        if held:
            yield emit(held)

    return rest.mapInArrow(run, "tile long, lo long, hi long, all_buckets array<long>, keys binary, labels binary, buckets array<binary>, sets array<binary>")


class _Tile:
    def __init__(self, keys, labels, buckets, sets):
        self.keys, self.labels = np.frombuffer(keys, np.int64), np.frombuffer(labels, np.int64)
        self.sets = [np.frombuffer(s, np.uint64) for s in sets]
        self.sizes = np.array([len(s) for s in self.sets])
        flat = [np.frombuffer(b, np.int64) for b in buckets]
        owner = np.repeat(np.arange(len(flat)), [len(b) for b in flat])
        flat = np.concatenate(flat)
        order = np.argsort(flat, kind="stable")
        names, starts = np.unique(flat[order], return_index=True)
        self.members = dict(zip(names.tolist(), np.split(owner[order], starts[1:]), strict=True))


def _compare_tiles(x: _Tile, y: _Tile, percent: int) -> np.ndarray:
    """Which members share a bucket, lie in different components and reach the threshold: a (x, y) matrix."""
    open_ = np.zeros((len(x.keys), len(y.keys)), bool)
    for bucket in x.members.keys() & y.members.keys():
        open_[np.ix_(x.members[bucket], y.members[bucket])] = True
    open_ &= x.labels[:, None] != y.labels[None, :]
    open_ &= 100 * np.minimum(x.sizes[:, None], y.sizes[None, :]) >= percent * np.maximum(x.sizes[:, None], y.sizes[None, :])
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    common = np.zeros(open_.shape, np.float32)
    if not len(rows):
        return open_
    left, right = np.concatenate([x.sets[i] for i in rows]), np.concatenate([y.sets[j] for j in cols])
    shared = np.intersect1d(left, right)
    if int(open_.sum()) * PAIR_COST < len(shared) * len(rows) * len(cols):
        for i, j in zip(*np.nonzero(open_), strict=True):
            common[i, j] = _in_common(x.sets[i], y.sets[j])
    else:  # a matrix product of incidences, some columns at a time
        at = lambda t, which, flat: (np.repeat(np.arange(len(which)), t.sizes[which]), np.searchsorted(shared, flat))
        (ra, ca), (rb, cb) = at(x, rows, left), at(y, cols, right)
        ok_a, ok_b = shared[np.minimum(ca, len(shared) - 1)] == left, shared[np.minimum(cb, len(shared) - 1)] == right
        ra, ca, rb, cb = ra[ok_a], ca[ok_a], rb[ok_b], cb[ok_b]
        total = np.zeros((len(rows), len(cols)), np.float32)
        for start in range(0, len(shared), COLUMNS):
            a, b = np.zeros((len(rows), COLUMNS), np.float32), np.zeros((len(cols), COLUMNS), np.float32)
            here = (ca >= start) & (ca < start + COLUMNS)
            a[ra[here], ca[here] - start] = 1
            here = (cb >= start) & (cb < start + COLUMNS)
            b[rb[here], cb[here] - start] = 1
            total += a @ b.T
        common[np.ix_(rows, cols)] = total
    common = np.rint(common).astype(np.int64)
    return open_ & (100 * common >= percent * (x.sizes[:, None] + y.sizes[None, :] - common))


def _tile_links(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b): each linked member of a pair of tiles with the smallest member that it reaches there."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x = _Tile(r["keys"], r["labels"], r["buckets"], r["sets"])
                same = r["keys2"] is None
                y = x if same else _Tile(r["keys2"], r["labels2"], r["buckets2"], r["sets2"])
                hits = _compare_tiles(x, y, percent)
                at_x, at_y = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
                if not len(at_x):
                    continue
                root_x, root_y = connect(hits[np.ix_(at_x, at_y)], x.keys[at_x], y.keys[at_y], same)
                keys, roots = np.concatenate([x.keys[at_x], y.keys[at_y]]), np.concatenate([root_x, root_y])
                moved = keys != roots
                yield pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(roots[moved])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def rest_links(members: DataFrame, centres: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, rows: int, docs: int = TILE) -> DataFrame:
    """(a, b): links between members of different components that share a bucket and were no centre there.

    Members of such buckets are sorted so that those of the same buckets, and there those of the same
    component, are neighbours, and cut into tiles with their sets.  Two tiles meet if they share a bucket and
    do not both hold one and the same component.  A pair of tiles returns a row for each linked member.
    """
    # of a bucket of two one is the centre, and the other has met it
    left = members.select("bucket", "key").join(centres.where("size > 2").select("bucket", F.col("c.key").alias("centre")), "bucket").where("key <> centre")
    named = scratch.cut(left.join(labels, left["key"] == labels["id"], "left").select("bucket", "key", F.coalesce("component", "key").alias("label")), rows=rows)
    mixed = named.groupBy("bucket").agg(F.min("label").alias("family"), F.max("label").alias("hi")).where("family < hi").select("bucket", "family")
    rest = scratch.cut(named.join(mixed, "bucket").groupBy("key").agg(F.min("family").alias("family"), F.min("label").alias("label"), F.collect_list("bucket").alias("buckets")), rows=rows)
    scratch.drop(named)
    parts = max(1, -(-rest.count() // (4 * docs)))
    order = ["family", "label", "key"]
    sorted_ = rest.join(sets, "key").repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)
    tiles = scratch.cut(_pack_tiles(sorted_.select("key", "label", "buckets", "hashes"), docs, SET_BYTES))
    touched = tiles.select("tile", "lo", "hi", F.explode("all_buckets").alias("bucket"))
    other = touched.select("bucket", F.col("tile").alias("tile2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = touched.join(other, "bucket").where("tile <= tile2 and not (lo = hi and lo2 = hi2 and lo = lo2)").select("tile", "tile2").distinct()
    content = ["keys", "labels", "buckets", "sets"]
    right = tiles.select(F.col("tile").alias("tile2"), *(F.col(c).alias(c + "2") for c in content))
    met = pairs.join(tiles.select("tile", *content), "tile").join(right, (pairs["tile2"] == right["tile2"]) & (pairs["tile"] < right["tile2"]), "left")
    found = scratch.cut(_tile_links(met.select(*content, *(c + "2" for c in content)), percent))
    scratch.drop(rest, tiles)
    return found


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, rows: int = 6, bins: int = BINS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``df``.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of ``words``-word shingles.
    ``component_id`` is the smallest doc_id reachable by links, itself included; ``kept`` is
    ``doc_id = component_id``.  Words are what lies between white space (0x20, 0x09-0x0D), A-Z in lower
    case.  Null and empty texts, and texts of white space, have an empty set and link with nothing.  Rows
    that repeat a doc_id are one document: whatever links one of their texts links them all, in whatever
    order rows come.  A null doc_id links with nothing; its component is null and it is not kept.  An empty
    table gives no rows; very long texts are taken whole; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketched = scratch.cut(set_sketches(docs, words, rows, bins))

    # classes of equal sets go on under a number of their own, with their smallest id
    total = sketched.count()
    known = sketched.where("doc_id is not null and set_key is not null")
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by("n_shingles", "doc_id").alias("n"), F.min_by("bands", "doc_id").alias("bands"))
    classes = scratch.cut(classes.withColumn("key", F.monotonically_increasing_id()), rows=total, per_file=4_000)
    # texts under one id are one document
    several = known.groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first < last").select("doc_id", "first")
    same_id = known.join(several, "doc_id").where("set_key <> first").select("set_key", "first").distinct()
    key_of = lambda name: classes.select(F.col("set_key").alias(f"{name}_set"), F.col("key").alias(name))
    links = scratch.cut(same_id.join(key_of("a"), F.col("set_key") == F.col("a_set")).join(key_of("b"), F.col("first") == F.col("b_set")).select("a", "b"))

    slots = classes.select("key", "n", F.posexplode("bands").alias("band", "value"))
    n_slots = classes.count() * (bins // rows)
    sizes = scratch.cut(slots.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), rows=n_slots // 2)
    shared = scratch.cut(slots.join(sizes, ["band", "value"]).select(F.shiftleft(F.shiftrightunsigned(F.xxhash64("band", "value"), 1), 1).bitwiseOR(F.col("band") % 2).alias("bucket"), "key", "n", "size"), rows=n_slots)
    scratch.drop(sizes)

    # the more of its buckets' members a document meets, the more it is like an original of many copies
    n_slots = shared.count()
    weight = scratch.cut(shared.groupBy("key").agg(F.sum("size").alias("weight")), rows=total)
    turn = F.struct(F.when(F.col("bucket") % 2 == 0, -F.col("weight")).otherwise(F.xxhash64("key", "bucket")).alias("by"), "key").alias("turn")
    members = scratch.cut(shared.join(weight, "key").select("bucket", "key", "n", turn), rows=n_slots)
    sets = scratch.cut(full_sets(docs, classes.join(weight, "key").select("key", "rep", "set_key"), words), rows=weight.count(), per_file=5_000)
    scratch.drop(shared, weight)

    close = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    centres = scratch.cut(members.groupBy("bucket").agg(F.min("turn").alias("c"), F.min_by("n", "turn").alias("m"), F.count(F.lit(1)).alias("size")), rows=n_slots)
    pairs = members.join(centres, "bucket").where((F.col("key") != F.col("c.key")) & close).select(F.least("key", "c.key").alias("a"), F.greatest("key", "c.key").alias("b")).distinct()
    pairs = scratch.cut(pairs, rows=n_slots)
    n_pairs = pairs.count()
    links = links.unionByName(scratch.cut(_confirm(pairs, sets, percent), rows=n_pairs, per_file=10_000))
    labels = connected_components(links, scratch, "a", "b", rows=n_pairs + total)

    more = rest_links(members, centres, labels, sets, scratch, percent, n_slots, tile)
    scratch.drop(members, sets, centres, pairs)
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more), scratch, "a", "b", rows=n_pairs + 2 * total)

    placed = scratch.cut(classes.join(labels, classes["key"] == labels["id"], "left").select("set_key", "rep", F.coalesce("component", "key").alias("group")), rows=total)
    scratch.drop(classes)
    least = placed.groupBy("group").agg(F.min("rep").alias("component"))
    reps = scratch.cut(placed.join(least, "group").select("set_key", "component"), rows=total)
    scratch.drop(placed)
    out = sketched.join(reps, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def oracle(words: int, percent: int, table: str = "documents") -> str:
    """DuckDB twin: sets that share a shingle are compared in full; equal sets count as one."""
    shingles = f"CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i:i + {words} - 1], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
    s AS (SELECT doc_id, list_sort({shingles}) AS s FROM d),
    classes AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
    long AS (SELECT rep, n, unnest(s) AS h FROM classes),
    common AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM long a JOIN long b ON a.h = b.h AND a.rep < b.rep
        AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
    one AS (SELECT a, b FROM common WHERE 100 * k >= {percent} * (na + nb - k)),
    links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
    reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    c AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
    SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
    FROM s LEFT JOIN classes ON classes.s = s.s LEFT JOIN c ON c.a = classes.rep
    """
