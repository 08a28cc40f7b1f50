"""Sparse text features that the classifiers share: hashed words and binned structure statistics."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose buckets a task remembers; the memo is emptied when it holds more.
MEMO_WORDS = 100_000
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SPACE = b" \t\n\r\x0b\x0c"
_STOP = b".,;:?'\"()-"
_MARKS = b"!#$%&*+/<=>@[\\]^_`{|}~"
STATS = ("upper", "digit", "marks", "stops", "space", "shout", "bars", "word_length", "distinct_words", "lines", "repeated_lines", "line_length", "length", "declared")
#: Levels of each statistic.
LEVELS = 12


class Buckets(dict):
    """word (bytes) -> bucket."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        b = self[word] = xxhash.xxh3_64_intdigest(word) % self.buckets
        return b


def _level(share: float) -> int:
    """Shares of 0 .. 1 on a scale that is finer near 0."""
    return min(LEVELS - 1, int(np.sqrt(max(0.0, share)) * LEVELS))


def _log_level(x: float, top: float) -> int:
    return min(LEVELS - 1, int(np.log1p(max(0.0, x)) / np.log1p(top) * LEVELS))


def structure(raw: bytes, words: list[bytes], declared: int | None) -> list[int]:
    """A level for each of STATS; ``declared`` is the metadata's character count."""
    n = max(1, len(raw))
    count = lambda chars: n - len(raw.translate(None, chars)) if raw else 0
    upper, marks, bars = count(_UPPER), count(_MARKS), raw.count(b"|")
    letters = upper + count(_LOWER)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(words))
    return [
        _level(upper / max(1, letters)),
        _level(count(_DIGIT) / n),
        _level(marks / n),
        _level(count(_STOP) / n),
        _level(count(_SPACE) / n),
        _level(raw.count(b"!") / k),
        _level(bars / k),
        _log_level(len(raw) / k, 40),
        _level(len(set(words)) / k),
        _log_level(len(lines), 1000),
        _level(1 - len(set(lines)) / max(1, len(lines))),
        _log_level(len(raw) / max(1, len(lines)), 5000),
        _log_level(len(raw), 200_000),
        LEVELS - 1 if declared is None else _level(min(1.0, abs(declared - len(raw)) / n)),
    ]


def word_list(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def structure_ids(raw: bytes, words: list[bytes], declared: int | None) -> np.ndarray:
    """One id for each statistic, 0 .. len(STATS) * LEVELS - 1."""
    return np.arange(len(STATS)) * LEVELS + np.array(structure(raw, words, declared))


def word_buckets(words: list[bytes], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.unique(np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=len(words)), return_counts=True)
