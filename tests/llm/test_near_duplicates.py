import random

import numpy as np

from taskweft.llm import op5_minhash as m


def brute(rows, words, percent):
    sets, ids = {}, {i for i, _ in rows if i is not None}
    for i, t in rows:
        w = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        s = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)]) if w else frozenset()
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = [(i, s) for i in ids for s in sets[i] if s]
    for a, (i, s) in enumerate(known):
        for j, t in known[a + 1 :]:
            if 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in ids}


def near(spark, texts, **how):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return m.near_duplicates(df, **how).collect()


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, passage = [], rng.choices(vocabulary, k=60)
    for i in range(0, 400, 8):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 30, 80, 300]))
        if i % 3 == 0:
            base = passage + base
        for k in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i + k, " ".join(copy)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for words, percent, rows_a_band in ((3, 85, 7), (5, 80, 6)):
        rows = corpus(words)
        want = brute(rows, words, percent)
        got = near(spark, rows, words=words, percent=percent, rows=rows_a_band)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(200)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    assert {r.component_id for r in near(spark, rows, words=3, percent=85, rows=7)} == {0}


def test_odd_rows(spark, odd, clash, none):
    got = sorted(map(tuple, m.near_duplicates(clash, words=3, percent=85, rows=7).collect()), key=repr)
    assert got == sorted(map(tuple, m.near_duplicates(odd, words=3, percent=85, rows=7).collect()), key=repr)
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == 10 and by[5, 9][2:] == (1, False) and by[1, 9][2:] == (1, True)
    assert by[2, 0][2:] == (2, True) and by[3, 0][2:] == (3, True) and by[4, 0][2:] == (4, True)
    assert [r[2:] for r in got if r[0] is None] == [(None, False)] and by[7, 1][2:] == (7, True) and by[9, 1][2:] == (9, True)
    assert m.near_duplicates(none).count() == 0


def test_densified_signatures_estimate_similarity():
    probes, rng = m.probing_order(256), np.random.default_rng(0)
    for n in (5, 40, 3000):
        base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = base[: max(1, int(len(base) * 0.8))]
        same = (m.signature(base, probes) == m.signature(keep, probes)).mean()
        assert abs(same - len(keep) / len(base)) < 0.25
        assert (m.signature(base, probes) == m.signature(base, probes)).all()


def test_families_without_a_common_original(spark):
    """All share their buckets by common words, and only pairs of them reach the threshold."""
    rng = random.Random(12)
    shared, rows = [f"c{i}" for i in range(120)], []
    for i in range(0, 160, 2):
        own = [f"o{i}x{k}" for k in range(40)]
        rows.append((i, " ".join(shared + own)))
        rows.append((i + 1, " ".join(shared + own[:-3] + [f"m{rng.random()}" for _ in range(3)])))
    rng.shuffle(rows)
    want = brute(rows, 3, 85)
    assert len(set(want.values())) == 80
    for tile in (16, 1024):
        got = near(spark, rows, words=3, percent=85, rows=1, bins=8, tile=tile)
        assert {r.doc_id: r.component_id for r in got} == want


def brute_by_product(rows, words, percent):
    """Components by one product of incidences; for distinct ids with text."""
    sets = [{" ".join(w[k : k + words]) for k in range(len(w) - words + 1)} for w in (t.split() for _, t in rows)]
    at = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s]] = 1
    common, n = np.rint(m @ m.T), m.sum(axis=1)
    hits = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    ids = np.array([i for i, _ in rows])
    root = ids.copy()
    while (new := np.where(hits, root[None, :], ids.max() + 1).min(axis=1)).tolist() != root.tolist():
        root = new
    return dict(zip(ids.tolist(), root.tolist(), strict=True))


def family(pairs, cuts=7, gap=15, seed=21):
    """Pairs of near copies of one text that is not among them: the two of a pair share all cuts but one."""
    rng = random.Random(seed)
    base, rows = [f"b{i}" for i in range(1000)], []
    for i in range(pairs):
        first = [rng.randrange(985) for _ in range(cuts)]
        for k, at in enumerate((first, [*first[1:], rng.randrange(985)])):
            gone = {c + j for c in at for j in range(gap)}
            rows.append((2 * i + k, " ".join(w for n, w in enumerate(base) if n not in gone)))
    rng.shuffle(rows)
    return rows


def test_family_of_cut_copies(spark):
    for rows, tile in ((family(450), 64), (family(450, gap=20), 1024)):
        want = brute_by_product(rows, 3, 85)
        assert len(set(want.values())) > 5
        assert {r.doc_id: r.component_id for r in near(spark, rows, words=3, percent=85, rows=7, tile=tile)} == want


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "c d e f"), (4, a + " fin"), (9, "c d e f"), (8, "x y z"), (7, "x y z")]
    want = {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 8: 7, 7: 7}
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        assert {r.doc_id: r.component_id for r in near(spark, order, words=3, percent=85, rows=7)} == want == brute(rows, 3, 85)


def test_long_texts_of_distinct_words(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-500])), (3, " ".join(words[:30_000])), (4, " ".join(words[3:]))]
    assert {r.doc_id: r.component_id for r in near(spark, rows)} == {1: 1, 2: 1, 3: 3, 4: 1}
