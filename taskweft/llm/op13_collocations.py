"""Phrase collocations, counted in the slots of minimal perfect hashes.

Levels go from words to phrases of three words.  A level's candidates are Apriori-safe: every shorter part
has to be frequent, and so has the bucket that its key falls into; both tests can pass too much, never too
little.

* Texts are cut into words and numbered once; the numbers are written, a row for each slice, and every level
  reads them.
* Mappers count the windows of a slice with numpy, and send each window's 96-bit key with its count to the
  segment of its key.  The frequent parts are known to them as a bit field of bounded size
  (``FILTER_BITS``): beyond that many keys it lets more pass, and only the shuffle grows.
* A segment's task bincounts buckets, builds a minimal perfect hash over the keys of full buckets, looks up
  every entry, verifies the key stored in its slot, and bincounts by slot, array by array; the arrays are
  summed as a tree.  There is a segment for each ``SEGMENT_BYTES`` of text, so its memory is bounded, and a
  frequent window reaches it once a slice and not once an occurrence.
* One more pass names the frequent keys.  The counts of a phrase's parts are read by their keys, as a join,
  which adaptive execution splits at a frequent word.

Texts, keys and counts never pass through the driver; what it holds is the bit field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taskweft.llm.words import STOP, Words
from taskweft.plans.scratch import Scratch

#: Bits of the filter of frequent parts at most (16 MB), and bits for a key below that.
FILTER_BITS, BITS_A_KEY = 1 << 27, 16
#: Bytes of text for each segment.
SEGMENT_BYTES = 6_000_000
#: Word places that a mapper holds before it counts, and bytes that it cuts at once.
SLICE_WORDS, CUT_BYTES = 1_000_000, 3_000_000
#: Slices in a file of the numbered table: a reader decodes a file's rows together.
SLICES_A_FILE = 4
#: Longest phrase.
WORDS = 3

_FROM = bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t"
_BYTES = bytes.maketrans(_FROM, bytes(range(97, 123)) + STOP * 10 + b" ")
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd factors, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Slots:
    """A minimal perfect hash over distinct keys (a, b), with the keys stored in their slots.

    Level by level the keys fall on twice as many places as there are keys; those alone on their place are
    done, the others go on to the next level.  A key's slot is the number of taken places before its own.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.fields: list[tuple[int, np.ndarray, int]] = []  # places, rank before each, slots of earlier levels
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(b), np.uint32)
        left, done, salt = np.arange(len(a)), 0, 0
        while len(left):
            places = 2 * len(left) + 1
            at = self._place(a[left], b[left], len(self.fields), places)
            alone = np.bincount(at, minlength=places) == 1
            rank = np.concatenate([[0], np.cumsum(alone)])
            mine = alone[at]
            slot = done + rank[at[mine]]
            self.a[slot], self.b[slot] = a[left[mine]], b[left[mine]]
            self.fields.append((places, rank, done))
            done += int(mine.sum())
            left = left[~mine]

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, places: int) -> np.ndarray:
        return (mix(a + mix(b.astype(np.uint64) + _U(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))) % _U(places)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (places, rank, before) in enumerate(self.fields):
            at = self._place(a[left], b[left], level, places)
            taken = rank[at + 1] > rank[at]
            out[left[taken]] = before + rank[at[taken]]
            left = left[~taken]
        there = out >= 0
        there[there] = (self.a[out[there]] == a[there]) & (self.b[out[there]] == b[there])
        out[~there] = -1
        return out


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    while len(arrays) > 1:
        arrays = [sum(arrays[i + 1 : i + 2], arrays[i]) for i in range(0, len(arrays), 2)]
    return arrays[0]


def _grouped(chunks: list[tuple], entries: int) -> list[tuple]:
    """Chunks joined until each has ``entries`` or more, so that arrays of slots are not longer than what they count."""
    out, held, size = [], [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk[0])
        if size >= entries:
            out.append(held)
            held, size = [], 0
    return [tuple(map(np.concatenate, zip(*x, strict=True))) for x in [*out, held] if x]


def frequent_keys(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, count) of the keys with ``least`` or more in sum. chunks: arrays of (a, b, count)."""
    size = 1 << max(10, sum(len(a) for a, _, _ in chunks).bit_length())
    chunks = _grouped(chunks, size // 2)
    counted = lambda at, n, size: np.bincount(at, weights=n, minlength=size).astype(np.int64)
    buckets = [((a >> _U(20)) & _U(size - 1)).view(np.int64) for a, _, _ in chunks]
    sums = tree_sum([counted(at, n, size) for at, (_, _, n) in zip(buckets, chunks, strict=True)] or [np.zeros(size, np.int64)])
    full = [tuple(x[f] for x in c) for c, f in zip(chunks, (sums[at] >= least for at in buckets), strict=True)]
    ka, kb = (np.concatenate([np.zeros(0, t), *(c[i] for c in full)]) for i, t in ((0, np.uint64), (1, np.uint32)))
    order = np.lexsort((kb, ka))
    ka, kb = ka[order], kb[order]
    first = np.ones(len(ka), bool)
    first[1:] = (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])
    slots = Slots(ka[first], kb[first])
    parts = [np.zeros(len(slots.a), np.int64)]
    for a, b, n in full:
        at = slots.find(a, b)
        parts.append(counted(at[at >= 0], n[at >= 0], len(slots.a)))
    total = tree_sum(parts)
    kept = total >= least
    return slots.a[kept], slots.b[kept], total[kept]


def lanes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hash lanes of each word, with a zero in front."""
    import xxhash

    both = np.frombuffer(b"\0" * 16 + b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def keys(lang: str, parts: list[np.ndarray], both: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """96-bit keys of phrases in a language: word numbers by place; no words give the language's own key."""
    seed = lanes([lang.encode()])
    out = []
    for i in (0, 1):
        key = np.full(len(parts[0]) if parts else 1, seed[i][1], np.uint64)
        for p in parts:
            key = mix(mix(key) + both[i][p])
        out.append(mix(key))
    return out[0], (out[1] >> _U(32)).astype(np.uint32)


def passes(bits: np.ndarray | None, a: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set; without a field all pass."""
    if bits is None:
        return np.ones(len(a), bool)
    at = (a >> _U(8)) & _U(len(bits) * 8 - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def windows(ids: np.ndarray, level: int, lang: str, both, bits: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct windows of ``level`` words whose shorter parts may be frequent: word numbers by place, and their counts."""
    if level == 1:
        found, n = np.unique(ids[ids > 0], return_counts=True)
        return [found], n
    x, y = ids[:-1], ids[1:]
    if level == 2:
        live = passes(bits, keys(lang, [np.arange(len(both[0]))], both)[0])
        live[0] = False
        ok = live[x] & live[y]
        pair, n = np.unique(x[ok] << 32 | y[ok], return_counts=True)
        return [pair >> 32, pair & 0xFFFFFFFF], n
    at = np.flatnonzero((x > 0) & (y > 0))
    live = np.zeros(len(x), bool)
    live[at] = passes(bits, keys(lang, [x[at], y[at]], both)[0])
    at = np.flatnonzero(live[:-1] & live[1:])
    pairs, number = np.unique(x[at] << 32 | y[at], return_inverse=True)
    both_, n = np.unique(number << 32 | ids[at + 2], return_counts=True)
    first = pairs[both_ >> 32]
    return [first >> 32, first & 0xFFFFFFFF, both_ & 0xFFFFFFFF], n


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in portions that end between words."""
    at = 0
    while at < len(text):
        end = at + CUT_BYTES
        if end < len(text):
            end = min((i for i in (text.find(b" ", end), text.find(STOP, end)) if i >= 0), default=len(text))
        yield text[at:end]
        at = end


def number_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, dict[str, tuple[np.ndarray, int]]]]:
    """(words, {lang: (ids, carried)}): numbered words of slices; a language's next slice begins with the last words, ``carried`` in number, of the one before."""
    words, held, carried, waiting, size, here = Words(), {}, {}, {}, 0, 0

    def number():
        nonlocal size, here
        for lang, parts in waiting.items():
            ids = words.number(b"".join(parts))
            held.setdefault(lang, []).append(ids)
            size += len(ids)
        waiting.clear()
        here = 0

    def flush():
        nonlocal words, size
        found = {lang: (np.concatenate(arrays), carried.get(lang, 0)) for lang, arrays in held.items()}
        yield words, found
        tails = {lang: [words.raw[i - 1] if i else STOP for i in ids[max(0, len(ids) - WORDS + 1) :]] for lang, (ids, _) in found.items()}
        words, size = Words(), 0
        held.clear()
        held.update({lang: [np.array([words[w] for w in tail], np.int64)] for lang, tail in tails.items() if any(w != STOP for w in tail)})
        carried.clear()
        carried.update({lang: len(tail) for lang, (tail,) in held.items()})

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _cut(raw.as_py().translate(_BYTES)):
                waiting.setdefault(lang, []).append(part)
                here += len(part)
                if here >= CUT_BYTES:
                    number()
                    if size >= SLICE_WORDS:
                        yield from flush()
            waiting.setdefault(lang, []).append(STOP)
    number()
    yield from flush()


def of_level(words: list[bytes], found: dict[str, tuple[np.ndarray, int]], level: int) -> Iterator[tuple[str, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """(lang, ids, lanes) of a slice, with no more carried words than windows of ``level`` words need."""
    both = lanes(words)
    for lang, (ids, carried) in found.items():
        yield lang, ids[max(0, carried - level + 1) :], both


def slices(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[tuple[str, np.ndarray, Words, tuple[np.ndarray, np.ndarray]]]:
    """(lang, ids, words, lanes): slices of texts for windows of ``level`` words, numbered and read at once."""
    for words, found in number_slices(batches):
        for lang, ids, both in of_level(words.raw, found, level):
            yield lang, ids, words, both


def packed(words: Words, found: dict[str, tuple[np.ndarray, int]]) -> pa.RecordBatch:
    """A slice as a row (words, lang, ids, carried)."""
    ids, carried = [x.astype(np.int32).tobytes() for x, _ in found.values()], [n for _, n in found.values()]
    return pa.RecordBatch.from_arrays([pa.array([b" ".join(words.raw)], pa.binary()), pa.array([list(found)], pa.list_(pa.string())), pa.array([ids], pa.list_(pa.binary())), pa.array([carried], pa.list_(pa.int32()))], names=["words", "lang", "ids", "carried"])


def _numbered(texts: DataFrame) -> DataFrame:
    """(words, lang, ids, carried): a row for each slice, so that all levels read numbers and texts are cut once."""

    def run(batches):
        for words, found in number_slices(batches):
            yield packed(words, found)

    return texts.mapInArrow(run, "words binary, lang array<string>, ids array<binary>, carried array<int>")


def read_slices(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[tuple[str, np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray]]]:
    """(lang, ids, words, lanes) of the slices of a numbered table."""
    for batch in batches:
        for words, langs, ids, carried in zip(*batch.columns, strict=True):
            names = words.as_py().split(b" ")
            found = {lang.as_py(): (np.frombuffer(x.as_py(), np.int32).astype(np.int64), n.as_py()) for lang, x, n in zip(langs, ids, carried, strict=True)}
            for lang, numbers, both in of_level(names, found, level):
                yield lang, numbers, names, both


def _entries(numbered: DataFrame, level: int, segments: int, bits) -> DataFrame:
    """(segment, a, b, n): packed keys and counts of a slice's windows."""

    def run(batches):
        field = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for lang, ids, _, both in read_slices(batches, level):
            parts, n = windows(ids, level, lang, both, field)
            a, b = keys(lang, parts, both)
            if level == 1:  # the language's own key counts all words
                own = keys(lang, [], both)
                a, b, n = np.append(a, own[0]), np.append(b, own[1]), np.append(n, n.sum())
            to = (a % _U(segments)).astype(np.int32)
            order = np.argsort(to)
            a, b, n, to = a[order], b[order], n[order].astype(np.uint32), to[order]
            starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
            ends = [*starts[1:], len(to)]
            for at in range(0, len(starts), 16):
                rows = [slice(s, e) for s, e in zip(starts[at : at + 16], ends[at : at + 16], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to[starts[at : at + 16]], pa.int32()), *(pa.array([v[r].tobytes() for r in rows], pa.binary()) for v in (a, b, n))], names=["segment", "a", "b", "n"])

    return numbered.mapInArrow(run, "segment int, a binary, b binary, n binary")


def _counted(entries: DataFrame, least: int) -> DataFrame:
    """(a, b, f) of the keys that reach ``least``."""

    def run(t):
        as_arrays = lambda name, kind: [np.frombuffer(x, kind) for x in t.column(name).to_pylist()]
        a, b, f = frequent_keys(list(zip(as_arrays("a", np.uint64), as_arrays("b", np.uint32), as_arrays("n", np.uint32), strict=True)), least)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int32), "f": f})

    return entries.groupBy("segment").applyInArrow(run, "a long, b int, f long")


def _filter(counts: DataFrame) -> object:
    """The keys of a table as a bit field of bounded size, broadcast. Parts of it are made in tasks."""
    spark = counts.sparkSession
    size = 1 << max(16, min(FILTER_BITS, counts.count() * BITS_A_KEY).bit_length())
    size = min(size, FILTER_BITS)
    part = min(size, 1 << 20)

    def run(key, t):
        a = t.column("a").to_numpy().view(np.uint64)
        on = np.zeros(part, bool)
        on[((a >> _U(8)) & _U(part - 1)).astype(np.int64)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(on, bitorder="little").tobytes()]})

    of = F.shiftrightunsigned("a", 8).bitwiseAND(F.lit(size - 1))
    made = counts.select("a", F.shiftright(of, part.bit_length() - 1).cast("int").alias("part")).distinct().groupBy("part").applyInArrow(run, "part int, bits binary")
    field = bytearray(size // 8)
    for row in made.collect():  # at most FILTER_BITS
        field[row.part * part // 8 : (row.part + 1) * part // 8] = row.bits
    return spark.sparkContext.broadcast(bytes(field))


def _named(numbered: DataFrame, bits) -> DataFrame:
    """(lang, phrase): phrases of two words or more whose keys may be frequent."""

    def run(batches):
        field = np.frombuffer(bits.value, np.uint8)
        for lang, ids, words, both in read_slices(batches, WORDS):
            raw = [STOP, *words]
            live = [np.zeros(len(ids), bool) for _ in range(WORDS + 1)]
            for level in range(2, WORDS + 1):
                if len(ids) < level:
                    continue
                parts = [ids[j : len(ids) - level + 1 + j] for j in range(level)]
                at = np.flatnonzero(np.logical_and.reduce([p > 0 for p in parts]) if level == 2 else live[level - 1][: len(parts[0])] & live[level - 1][1 : len(parts[0]) + 1])
                ok = passes(field, keys(lang, [p[at] for p in parts], both)[0])
                live[level][at[ok]] = True
                at = at[ok]
                first = parts[0][at] << 32 | parts[1][at]
                if level == 3:
                    pairs, number = np.unique(first, return_inverse=True)
                    both_ = np.unique(number << 32 | parts[2][at])
                    first = pairs[both_ >> 32]
                    rows = zip((first >> 32).tolist(), (first & 0xFFFFFFFF).tolist(), (both_ & 0xFFFFFFFF).tolist(), strict=True)
                else:
                    first = np.unique(first)
                    rows = zip((first >> 32).tolist(), (first & 0xFFFFFFFF).tolist(), strict=True)
                names = [b" ".join([raw[i] for i in r]) for r in rows]
                for k in range(0, len(names), 20_000):
                    part = names[k : k + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())], names=["lang", "phrase"])

    return numbered.mapInArrow(run, "lang string, phrase string").distinct()


def _parts(named: DataFrame) -> DataFrame:
    """(lang, phrase, words, role, a, b): keys of a phrase ('f') and of its parts, 'l1' to 'r2' by the words of the first part."""

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("lang", "phrase", "words", "role", "a", "b")}
            rows = list(zip(batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()], strict=True))
            for lang, size in {(lang, len(w)) for lang, w in rows}:
                mine = [w for x, w in rows if x == lang and len(w) == size]
                both = lanes([x for w in mine for x in w])
                number = np.arange(1, len(mine) * size + 1).reshape(-1, size)
                roles = {"f": (0, size)} | {f"l{k}": (0, k) for k in range(1, size)} | {f"r{k}": (k, size) for k in range(1, size)}
                for role, (i, j) in roles.items():
                    a, b = keys(lang, [number[:, c] for c in range(i, j)], both)
                    for c, v in (("lang", [lang] * len(mine)), ("phrase", [b" ".join(w).decode() for w in mine]), ("words", [size] * len(mine)), ("role", [role] * len(mine)), ("a", a.view(np.int64)), ("b", b.view(np.int32))):
                        out[c].extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=list(out))

    return named.mapInArrow(run, "lang string, phrase string, words int, role string, a long, b int")


def _totals(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences, read by each language's own key."""

    def run(batches):
        for batch in batches:
            of = [keys(x, [], None) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(a.view(np.int64)[0]) for a, _ in of], pa.int64()), pa.array([int(b.view(np.int32)[0]) for _, b in of], pa.int32())], names=["lang", "a", "b"])

    return texts.select("lang").distinct().mapInArrow(run, "lang string, a long, b int").join(counts, ["a", "b"]).select("lang", F.col("f").alias("n"))


def collocations(df: DataFrame, least: int = 10, top: int | None = 2000, share: int = 50, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two and three words found ``least`` times or more, best first.

    Words are what lies between blanks and tabs in the pieces between ``.,;:!?`` and line ends, A-Z
    lower-cased.  ``score`` is floor(1000000 a a / (l r)) at the lowest-scoring cut.  A phrase inside a longer
    one with at least ``share`` percent of its count is left out.  ``top`` bounds the report of each language
    (all without it).

    Null texts count as empty, a null language as ``und``; repeated rows count each; long texts are cut in
    portions that overlap; equal scores rank by count, then by bytes; an empty table gives no rows; other
    columns are not read, whatever their names.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "phrases")
    col = lambda c: F.col(f"`{c}`").cast("string")
    texts = df.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    segments = max(64, -(-size // SEGMENT_BYTES))
    numbered = scratch.cut(_numbered(texts), per_file_rows=SLICES_A_FILE)
    levels, bits = [], None
    for level in range(1, WORDS + 1):
        levels.append(scratch.cut(_counted(_entries(numbered, level, segments, bits), least)))
        if level < WORDS:
            bits = _filter(levels[-1])
    long = levels[1].unionByName(levels[2])
    counts = levels[0].unionByName(long)
    named = _named(numbered, _filter(long))
    asked = _parts(named)
    read = asked.join(counts, ["a", "b"]).groupBy("lang", "phrase", "words").agg(*(F.max(F.when(F.col("role") == x, F.col("f"))).alias(x) for x in ("f", "l1", "r1", "l2", "r2"))).where("f is not null")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    scored = read.withColumns({f"s{k}": F.expr(f"(1000000 * (cast(f as decimal(19,0)) * cast(f as decimal(19,0)))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))") for k in (1, 2)})
    cut = lambda k: F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))
    worst = scratch.cut(scored.withColumn("worst", F.when(F.col("words") == 2, cut(1)).otherwise(F.least(cut(1), cut(2)))))
    scratch.drop(numbered)
    triple = worst.where("words = 3").withColumn("w", F.split("phrase", " "))
    inside = triple.select("lang", "f", F.explode(F.array(F.struct(F.array_join(F.slice("w", 1, 2), " ").alias("p"), F.col("l2").alias("of")), F.struct(F.array_join(F.slice("w", 2, 2), " ").alias("p"), F.col("r1").alias("of")))).alias("x"))
    covered = inside.where(F.col("f") * 100 >= F.col("x.of") * share).select("lang", F.col("x.p").alias("phrase")).distinct()
    kept = worst.join(covered, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("f"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    n = scratch.cut(_totals(texts, levels[0]))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long"), "phrase", F.col("f").alias("a"), F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), "n", F.col("worst.score").cast("long").alias("score"))


def oracle(least: int = 10, top: int = 2000, share: int = 50, table: str = "documents") -> str:
    """DuckDB twin."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = lambda k: f"SELECT lang, {k} AS words, concat_ws(' ', {', '.join(f'z[{j + 1}]' for j in range(k))}) AS phrase FROM (SELECT lang, unnest(list_zip({', '.join(f'w[{j + 1}:len(w) - {k - 1 - j}]' for j in range(k))})) AS z FROM pieces WHERE len(w) >= {k})"
    return f"""
    WITH pieces AS (
        SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w
        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM {table})),
    counts AS (SELECT lang, words, phrase, count(*) AS f FROM ({" UNION ALL ".join(gram(k) for k in (1, 2, 3))}) GROUP BY ALL),
    total AS (SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY 1),
    cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= {least}),
    keyed AS (SELECT lang || chr(0) || phrase AS key, f FROM counts),
    parts AS (SELECT *, lang || chr(0) || array_to_string(w[1:k], ' ') AS one, lang || chr(0) || array_to_string(w[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, words)) AS k FROM cand)),
    cuts AS (
        SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
        FROM parts c JOIN keyed x ON x.key = one JOIN keyed y ON y.key = two),
    worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE words = 3),
    kept AS (SELECT * FROM worst x WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE x.words = 2 AND i.lang = x.lang AND i.phrase = x.phrase AND 100 * i.a >= {share} * x.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM kept JOIN total USING (lang) QUALIFY rank <= {top}
    """
