"""License scan by a positional index of rare words.

Notices of licenses are templates with mandatory key phrases.  Their words' document frequencies are counted
over all documents, and each template is indexed under its highest-IDF words with their places.  A file's
rare words are looked up; postings that agree on the relative position (file place less template place, give
or take ``SLACK`` words) name a template and where it would begin.  There the whole template is aligned,
weighted by IDF, and accepted with ``LEAST`` of its weight and all its key phrases.

Templates are constants, so what is broadcast and what comes back from the count is bounded by them.  Each
document is read whole, by itself, in both passes; nothing but counts is shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from taskweft.llm.common import map_rows

# Base phrases and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
# Label, notice, mandatory key phrases.  Wording of the public license notices.
TEMPLATES = [
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc0", "dedicated to the public domain under the cc0 public domain dedication", ["cc0"]),
    ("creative-commons", "this work is licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("gpl-reference", "licensed under the gnu general public license version", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "is hereby granted"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted"]),
    ("mit-reference", "released under the mit license", ["mit license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
#: Rare words of a template that are indexed, and how many of them have to agree on a place.
RARE, AGREE = 3, 2
#: Words that may be missing or added before a word without losing its alignment.
SLACK = 2
#: Share of a template's IDF weight that a file has to hold.
LEAST = 0.7
#: Score of a file with base phrases only.
BASE_SCORE = 0.5

#: A-Z to a-z; other ASCII than letters and digits to blanks.
_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_BYTES).split()


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, notice, _ in templates for w in notice.split()})


def document_frequencies(df: DataFrame, text_col: str, templates=TEMPLATES) -> tuple[int, dict[str, int]]:
    """Rows of ``df`` and, for each template word, those that hold it; as many numbers as template words come back."""
    wanted = frozenset(w.encode() for w in vocabulary(templates))
    plain = df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    held = map_rows(plain, "words array<string>", lambda texts: {"words": [["", *(w.decode() for w in wanted.intersection(words_of(t)))] for t in texts]})
    found = {r["w"]: r["n"] for r in held.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.pop("", 0), found


class Index:
    """Templates under their rare words, with places."""

    def __init__(self, total: int, docs: dict[str, int], templates=TEMPLATES):
        idf = {w.encode(): math.log((total + 1) / (docs.get(w, 0) + 1)) + 1 for w in vocabulary(templates)}
        self.labels = [label for label, _, _ in templates]
        self.words = [notice.encode().split() for _, notice, _ in templates]
        self.needed = [[b" %b " % p.encode() for p in phrases] for _, _, phrases in templates]
        self.weights = [[idf[w] for w in words] for words in self.words]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            for w in sorted(set(words), key=lambda w: (-idf[w], w))[:RARE]:
                self.postings[w].extend((t, j) for j, x in enumerate(words) if x == w)
        self.rare = frozenset(self.postings)

    def candidates(self, words: list[bytes]):
        """(template, begin): where rare words agree, each begin once."""
        if not self.rare.intersection(words):
            return
        begins: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for at, w in enumerate(words):
            for t, j in self.postings.get(w, ()):
                begins[t].append((at - j, w))
        for t, found in begins.items():
            found.sort()
            starts = [b for b, _ in found]
            for b in dict.fromkeys(starts):
                near = found[bisect_left(starts, b - SLACK) : bisect_right(starts, b + SLACK)]
                if len({w for _, w in near}) >= AGREE:
                    yield t, b

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """label -> best weighted share of an accepted template."""
        out: dict[str, float] = {}
        for t, begin in self.candidates(words):
            mine, weights = self.words[t], self.weights[t]
            if out.get(self.labels[t]) == 1.0:
                continue
            window = b" %b " % b" ".join(words[max(0, begin - SLACK) : max(0, begin + len(mine) + SLACK)])
            if not all(p in window for p in self.needed[t]):
                continue
            held = sum(x for j, (w, x) in enumerate(zip(mine, weights, strict=True)) if w in words[max(0, begin + j - SLACK) : max(0, begin + j + SLACK + 1)])
            share = held / sum(weights)
            if share >= LEAST:
                out[self.labels[t]] = max(share, out.get(self.labels[t], 0.0))
        return out


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word place, label) of each place where a base phrase stands, overlaps included."""
    text, out = b" %b " % b" ".join(words), []
    for phrase, label in BASE:
        needle = b" %b " % phrase.encode()
        at, seen, before = text.find(needle), 0, 0
        while at >= 0:
            before += text.count(b" ", seen, at)
            seen = at
            out.append((before, label))
            at = text.find(needle, at + 1)
    return out


def scan_licenses(df: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each row of ``df``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.  ``labels``
    holds the base labels and those of accepted templates, ``score`` the best accepted share, or
    ``BASE_SCORE`` with base phrases only, else 0.

    Null texts count as empty: no words, null places, empty labels.  Repeated rows and null ids are judged
    each.  Long texts are scanned whole.  An empty table gives no rows; other columns are not read.
    """
    index = Index(*document_frequencies(df, text_col, templates), templates)

    def scan(ids, texts):
        out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for raw in texts:
            words = words_of(raw)
            base, found = base_places(words), index.matches(words)
            places, labels = [p for p, _ in base], {x for _, x in base}
            row = (len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | set(found))), max([*found.values(), BASE_SCORE if base else 0.0]))
            for c, v in zip(out, row, strict=True):
                out[c].append(v)
        return {"doc_id": ids} | out

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return map_rows(rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", scan, slice_rows=128)
