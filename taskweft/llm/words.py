"""Numbering of the words of large portions of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stands for a border in portions; it has number 0.
STOP = b"!"


class Words(dict):
    """Words and their numbers from 1; number 0 is the end of a piece."""

    def __init__(self):
        super().__init__({STOP: 0})
        self.raw: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.raw.append(word)
        self[word] = number = len(self.raw)
        return number

    def number(self, text: bytes) -> np.ndarray:
        """The numbers of a portion's words; Arrow cuts and groups them, so Python sees distinct words only, new ones at once."""
        text = text.replace(STOP, b" ! ").strip(b" ")
        if not text:
            return np.zeros(0, np.int64)
        whole = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(text)], np.int64)), pa.py_buffer(text)])
        found = pc.ascii_split_whitespace(whole).values.dictionary_encode()
        one = pa.LargeListArray.from_arrays(pa.array([0, len(found.dictionary)], pa.int64()), found.dictionary)
        distinct = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_buffer().to_pybytes().split(b" ")
        new = [word for word in distinct if word not in self]
        self.update(zip(new, range(len(self.raw) + 1, len(self.raw) + len(new) + 1), strict=True))
        self.raw += new
        return np.fromiter(map(self.__getitem__, distinct), np.int64, len(distinct))[found.indices.to_numpy()]
