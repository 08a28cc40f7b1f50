"""License scan, source divergence and collocations against plain versions."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskweft.llm import op11_licenses as licenses, op12_divergence as divergence, op13_collocations as phrases
from taskweft.llm.words import Words

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, sf):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# collocations


def plain_collocations(table, least=10, top=2000, share=50):
    f, total = defaultdict(Counter), Counter()
    for d in table:
        lang = "und" if d["lang"] is None else d["lang"]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (d["text"] or "").translate(UPPER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in cand.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= share * counts[q]}
        best = []
        for p, a in cand.items():
            if p not in covered:
                score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out, key=repr)


def test_collocations_on_documents(spark, sf):
    table = docs(spark, sf)
    assert rows(phrases.collocations(spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"]) for d in table], DOCS))) == plain_collocations(table)


def test_collocations_small(spark, monkeypatch):
    texts = ["New York is big. new york! IS big", "a a a a a", "x\x1cy\xa0z x\x1cy\xa0z\tb", "", None, "É É é", "a\rb\nc;d:e?f", "one"]
    table = [(i, t, lang, "s") for i, t in enumerate(texts * 3) for lang in ("en", None)]
    want = plain_collocations([dict(zip(("doc_id", "text", "lang", "source"), r, strict=True)) for r in table], 2, 4)
    assert rows(phrases.collocations(spark.createDataFrame(table, DOCS), 2, 4)) == want
    assert any("x\x1cy\xa0z b" in r[2] for r in want)


def test_collocations_odd_rows(spark, odd, clash, none):
    table = [r.asDict() for r in odd.collect()]
    want = plain_collocations(table, 2)
    assert rows(phrases.collocations(odd, 2)) == want and rows(phrases.collocations(clash, 2)) == want
    assert rows(phrases.collocations(none)) == []


def test_slices_overlap(monkeypatch):
    """Windows of cut texts and slices are counted once each."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE_WORDS", 7)
    monkeypatch.setattr(phrases, "CUT_BYTES", 9)
    rng = np.random.default_rng(3)
    texts = [(lang, " ".join(rng.choice(["a", "bb", "ccc", "d.", "!"], rng.integers(0, 40)))) for lang in ("en", "de") * 10]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([t.encode() for _, t in texts])], names=["lang", "text"])
    every = np.full(1 << 13, 255, np.uint8)
    for level in (1, 2, 3):
        got = Counter()
        for lang, ids, words, both in phrases.slices(iter([batch]), level):
            if len(ids) >= level:
                parts, n = phrases.windows(ids, level, lang, both, every if level > 1 else None)
                for *p, c in zip(*parts, n, strict=True):
                    got[lang, tuple(words.raw[i - 1].decode() for i in p)] += int(c)
        want = Counter()
        for lang, t in texts:
            for piece in re.split("[.!]", t):
                w = piece.split()
                want.update((lang, tuple(w[i : i + level])) for i in range(len(w) - level + 1))
        assert got == want


def test_texts_are_numbered_once(spark):
    """All levels read the written numbers: the texts are made once to measure them and once to cut them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return "a b c. New York is big" * (i % 3)

    table = spark.range(40).select(F.col("id").alias("doc_id"), text("id").alias("text"), F.lit("en").alias("lang"))
    got = rows(phrases.collocations(table, 5))
    assert got == plain_collocations([{"text": "a b c. New York is big" * (i % 3), "lang": "en"} for i in range(40)], 5)
    assert got and made.value == 2 * 40


def test_packed_slices_are_read_back(monkeypatch):
    """What a level reads from packed slices is what cutting the texts for it gives."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE_WORDS", 7)
    monkeypatch.setattr(phrases, "CUT_BYTES", 9)
    rng = np.random.default_rng(4)
    texts = [(lang, " ".join(rng.choice(["a", "bb", "c\xa0c", "d.", "!", ""], rng.integers(0, 40)))) for lang in ("en", "de", "") * 10] + [("fr", ""), ("it", "one")]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([t.encode() for _, t in texts])], names=["lang", "text"])
    table = pa.Table.from_batches([phrases.packed(*found) for found in phrases.number_slices(iter([batch]))])
    assert table.num_rows > 10
    for level in (1, 2, 3):
        plain = lambda found: [(lang, [words[i - 1] if i else None for i in ids]) for lang, ids, words, _ in found]
        want = plain((lang, ids, words.raw, both) for lang, ids, words, both in phrases.slices(iter([batch]), level))
        assert plain(phrases.read_slices(iter(table.to_batches(3)), level)) == want


@pytest.mark.parametrize("size", [0, 1, 2, 5000])
def test_slots_are_minimal_and_perfect(size):
    rng = np.random.default_rng(size)
    a = rng.integers(0, 1 << 62, size).astype(np.uint64)
    a[: size // 2] = a[0] if size else 0  # many keys differ in their second part only
    b = np.arange(size, dtype=np.uint32)
    slots = phrases.Slots(a, b)
    assert sorted(slots.find(a, b).tolist()) == list(range(size))
    other = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    assert (slots.find(other, np.full(3000, 9, np.uint32)) == -1).all()


def test_bucket_sums_never_lose_a_key():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 300, 4000).astype(np.uint64)
    chunks = [(k, (k % np.uint64(3)).astype(np.uint32), np.ones(len(k), np.uint32)) for k in np.array_split(keys, 7)]
    a, _, n = phrases.frequent_keys(chunks, 12)
    assert dict(zip(a.tolist(), n.tolist(), strict=True)) == {k: c for k, c in Counter(keys.tolist()).items() if c >= 12}


def test_numbers_match_split():
    text = b"  a bb\x1c a\xc2\xa0b ! c " * 3
    words = Words()
    ids = words.number(text)
    assert [words.raw[i - 1] if i else b"!" for i in ids] == text.replace(b"!", b" ! ").split(b" ") or [words.raw[i - 1] if i else b"!" for i in ids] == [w for w in text.split(b" ") if w]


def test_new_words_are_numbered_at_once(monkeypatch):
    """No call in Python for each new word, numbers by first place over portions."""
    monkeypatch.delattr(Words, "__missing__")
    words = Words()
    got = [words.number(t).tolist() for t in (b"b a b!c", b"", b" ", b"c \xc3\xa9 a ! \xff b")]
    assert got == [[1, 2, 1, 0, 3], [], [], [3, 4, 2, 0, 5, 1]] and words.raw == [b"b", b"a", b"c", b"\xc3\xa9", b"\xff"]


# divergence


def plain_divergence(table, least=30, top=50):
    groups, n, docs_with = defaultdict(set), Counter(), Counter()
    for d in table:
        lang, source = d["lang"] or "", d["source"] or ""
        groups[lang].add(source)
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (d["text"] or "").translate(UPPER))
        n.update((lang, source, t) for t in w)
        docs_with.update((lang, t) for t in set(w))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), c in docs_with.items() if x == lang and c >= least)
        share = lambda c, total: 1 + int(Fraction(10**9 * (c + 5), total + 5 * len(kept)))  # noqa: E731, B023
        p = {s: [share(n[lang, s, t], sum(n[lang, s, u] for u in kept)) for t in kept] for s in sources}
        every = sum(n[lang, s, t] for s in sources for t in kept)
        q = [share(sum(n[lang, s, t] for s in sources), every) for t in kept]
        for s in sources:
            pair = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s)
            term = sorted((b - a, t.encode()) for t, a, b in zip(kept, p[s], q, strict=True) if n[lang, s, t] and a > b)[:top]
            out += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pair), ("term", term)) for i, (v, item) in enumerate(found)]
    return sorted(out, key=repr)


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def test_divergence_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(divergence.divergence(df, 5, 7)) == plain_divergence(as_dicts(df), 5, 7)


def test_divergence_odd_rows(spark, odd, clash, none):
    for least in (1, 2, 30):
        want = plain_divergence(as_dicts(odd), least)
        assert rows(divergence.divergence(odd, least)) == want and rows(divergence.divergence(clash, least)) == want
    assert rows(divergence.divergence(none)) == []


def test_divergence_without_kept_terms(spark):
    df = spark.createDataFrame([(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "x", None, None)], DOCS)
    assert rows(divergence.divergence(df)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_divergence_in_slices(spark, sf):
    """Small slices give the same counts."""
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    whole = {tuple(r[:3]): r[3:] for r in rows(divergence.count_terms(df, "lang", "source", "text").groupBy("lang", "source", "term").sum("n", "docs"))}
    plain, held = Counter(), Counter()
    for d in as_dicts(df):
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", d["text"].translate(UPPER))
        plain.update((d["lang"], d["source"], t) for t in w)
        held.update((d["lang"], d["source"], t) for t in set(w))
    assert whole == {k: (plain[k], held[k]) for k in plain}


# licenses


def plain_base(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def check_base(df):
    got = df.collect()
    out = {}
    for r in licenses.scan_licenses(df).collect():
        out.setdefault(r.doc_id, []).append(r)
    for d in got:
        for r in out[d.doc_id]:
            assert r[1:6] == plain_base(d.text) if len(out[d.doc_id]) == 1 else True
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sum(map(len, out.values())) == len(got)
    return out


def test_license_base_on_documents(spark, sf):
    check_base(spark.read.parquet(f"{sf}/documents.parquet"))


def test_license_odd_rows(spark, odd, clash, none):
    check_base(odd)
    assert sorted(licenses.scan_licenses(clash).columns) == sorted(licenses.scan_licenses(odd).columns)
    assert licenses.scan_licenses(none).collect() == []


CASES = [
    ("CC BY cc-by\tCC  BY 4.0", "cc-by", 3),
    ("All rights reserved. GNU GENERAL PUBLIC LICENSE", "gpl,reserved", 2),
    ("cc by-nc", "cc-by", 1),
    ("acc by all rights, reservedly general public licenses", "", 0),
    ("all rights reserved", "", 0),
]


@pytest.mark.parametrize(("text", "labels", "n"), CASES)
def test_base_phrases(text, labels, n):
    assert plain_base(text)[1] == n == len(licenses.base_places(licenses.words_of(text.encode())))
    assert ",".join(sorted({x for _, x in licenses.base_places(licenses.words_of(text.encode()))})) == labels


def test_templates_are_found(spark):
    """Each notice in other text, with a word dropped or added, keeps its label; the words of a long one in another order do not."""
    rng = np.random.default_rng(11)
    texts, want = [], []
    for label, notice, needed in licenses.TEMPLATES:
        filler = " ".join(rng.choice(["of", "the", "software", "license", "words", "public"], 300))
        texts.append(f"{filler} {notice.title()}, {filler}")
        want.append(label)
        w = notice.split()
        free = [i for i in range(len(w)) if not any(w[i] in p.split() for p in needed)]
        if len(w) > 12:
            middle = free[len(free) // 2]
            texts.append(" ".join(x for i, x in enumerate([*w[:middle], "extra", *w[middle:]]) if i != free[0]))
            want.append(label)
        texts.append(" ".join(sorted(w) * 2) if len(w) > 12 else "nothing here")
        want.append(None)
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS)).collect()}
    for i, label in enumerate(want):
        found = got[i].labels.split(",")
        if label is None:
            assert got[i].score in (0.0, licenses.BASE_SCORE), (texts[i], found)
        else:
            assert label in found and got[i].score >= licenses.LEAST, (label, found)


def test_document_frequencies(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    total, found = licenses.document_frequencies(df, "text")
    texts = [set(licenses.words_of(r.text.encode())) for r in df.select("text").collect()]
    assert total == len(texts) and {w: sum(w.encode() in t for t in texts) for w in licenses.vocabulary()} == {w: found.get(w, 0) for w in licenses.vocabulary()}
