"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice has one node for each boundary between characters and one arc for each piece that ends
there, so an arc reaches back ``max_piece`` characters at most.  For a model of merges the best path to a
boundary is the one whose last two pieces could stand side by side, that is, whose common border no merge
would have crossed first; exactly one arc into each boundary passes that test, and the path it closes is
the library's own segmentation of that prefix.  Only the last ``max_piece`` boundaries can still be
extended: when the backpointers of all of them meet in one boundary, everything before it is final, its
ids are committed, and the window starts anew.  Memory is bounded by the window, not by the text.

Words recur, so what the stream has committed for a stretch of letters, or of other characters, is
remembered (a bounded memo) with the marks before it.  No piece of the model joins letters to other
characters or holds a mark after either (checked as the model is read), so all paths meet at the boundaries
between such stretches; a model that has such pieces is streamed without the memo.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from taskweft.llm.common import map_batches, map_rows, per_task

MARK = "▁"
#: Words whose ids a worker remembers; the memo is emptied when it holds more.
MEMO_WORDS = 600_000
#: Longer stretches without white space are never remembered.
MEMO_LENGTH = 64
#: Characters between two looks at where the surviving paths meet.
LOOK_EVERY = 8
#: Texts that a normaliser or a piece taken before all merges would change.
PROBES = ("a  b", " a ", "\ufb01x \u2460", "e\u0301\u00e9", "\uff21\u3000b", "\ta\n\nb", "\u200bx", "\u00a0y")


def stretches(joined: str = "") -> re.Pattern:
    """Marks with the letters, or with the other characters, that follow them; ``joined`` count as others."""
    extra = re.escape(joined)
    return re.compile(rf"{MARK}*(?:[^\W\d_{extra}]+|(?:[\d_{extra}]|[^\w{MARK}])+)|{MARK}+")


def parts_of(text: str) -> Iterator[str]:
    """A text as a stream, with a look at the paths after each part."""
    return (text[at : at + LOOK_EVERY] for at in range(0, len(text), LOOK_EVERY))


class PieceModel:
    """Pieces, merge scores and byte ids of a SentencePiece merge model (identity normaliser, byte fallback)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        self.piece = [sp.id_to_piece(i) for i in ids]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.cost = {self.piece[i]: -sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.id))
        mixed = {c for p in self.id if not stretches().fullmatch(p) for c in p if re.match(r"[^\W\d_]", c)}
        self.cuts = stretches("".join(sorted(mixed))).findall
        self.by_stretch = len(mixed) < 100 and all(self.cuts(p) == [p] for p in self.id)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if sp.encode("a b") != sp.encode(" a b")[1:] and sp.encode("x", out_type=str)[0][:1] != MARK:
            raise ValueError("the model adds no mark before the text")
        #: The number of a boundary's last piece where it is none: the text's start, or a character without one.
        self.open, self.bare, self.base = len(self.piece), len(self.piece) + 1, len(self.piece) + 2
        self.raw = [bytes((self.id_byte[i],)) if i in self.id_byte else self.piece[i].encode() for i in ids]
        #: The pieces as a tree from their last characters on; "" holds a piece's id.
        self._ends: dict = {}
        for piece, i in self.id.items():
            node = self._ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i
        self._tree: dict[str, tuple[str, str] | None] = {}
        self._fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        first = sorted((p for p in plain if sp.get_score(p) >= 0), key=lambda p: len(self.piece[p]))[-64:]
        for probe in (*PROBES, *(f"x{self.piece[p].replace(MARK, ' ')}x" for p in first)):
            if self.encode(probe).tolist() != sp.encode(probe):
                raise ValueError(f"the model normalises texts or holds user-defined pieces: {probe!r}")

    # -- which pieces may stand side by side --------------------------------------------------------------

    def split(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes ``piece``; ("", "") for one character, None if merging never yields it."""
        if piece not in self._tree:
            parts, last = list(piece), ("", "")
            while len(parts) > 1:
                best = min(((self.cost[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.cost), default=None)
                if best is None:
                    break
                k = best[1]
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self._tree[piece] = last if len(parts) == 1 else None
        return self._tree[piece]

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """The pieces that touch one edge while ``piece`` grows, each with the cost of the merge that ends it."""
        grown, cost = [], float("inf")
        while piece:
            grown.append((piece, cost))
            cost = self.cost[piece]
            piece = self.split(piece)[side]
        return grown[::-1]

    def fits(self, left: int, right: int) -> bool:
        """No merge crosses the border: each time, the sides' own next merge comes before the crossing one.

        The start of the text and a character without a piece border on anything.
        """
        key = left * self.base + right
        if key not in self._fits:
            if len(self._fits) > 300_000:
                self._fits.clear()
            x = self.piece[right]
            self._fits[key] = self.split(x) is not None and (left >= self.open or self._holds(self.piece[left], x))
        return self._fits[key]

    def _holds(self, left: str, right: str) -> bool:
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_next), (y, y_next) = a[i], b[j]
            crossing = self.cost.get(x + y)
            if crossing is not None and crossing < x_next and crossing <= y_next:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if x_next <= y_next and i < len(a) - 1:
                i += 1
            else:
                j += 1

    # -- streaming Viterbi --------------------------------------------------------------------------------

    def _extend(self, text: str, last: list, back: list, start: int) -> None:
        """Boundaries after ``start``: the piece into each (-1 if no path ends there) and where it begins.

        Arcs are tried from the shortest on, down the tree of the pieces read from their ends.
        """
        fits, base = self._fits.get, self.base
        for end in range(start + 1, len(text) + 1):
            piece = at = -1
            node, begin = self._ends, end
            while begin:
                begin -= 1
                node = node.get(text[begin])
                if node is None:
                    break
                part = node.get("")
                if part is not None and (before := last[begin]) >= 0:
                    fit = fits(before * base + part)
                    if self.fits(before, part) if fit is None else fit:
                        piece, at = part, begin
                        break
            if piece < 0 and text[end - 1] not in self.id and last[end - 1] >= 0:
                piece, at = self.bare, end - 1  # its bytes; nothing merges with it
            last.append(piece)
            back.append(at)

    def commits(self, parts: Iterator[str]) -> Iterator[tuple[list[int], int, bool]]:
        """Ids of a stream of characters (marks in place of spaces), some at a time, as soon as they are final.

        Yields (ids, characters of the window before the commit, whether the surviving paths met; if not, the
        stream ended).
        """
        text, last, back = "", [self.open], [0]  # the window
        while True:
            more = next(parts, None)
            start, final = len(text), len(text)
            if more is not None:
                text, final = text + more, 0
                self._extend(text, last, back, start)
            if more is not None and len(text) >= self.longest:  # a shorter window may still be extended from its start
                alive = {p for p in range(len(text) - self.longest + 1, len(text) + 1) if last[p] >= 0}
                top = len(text)
                while len(alive) > 1:  # back along the paths that can still be extended, to where they meet
                    if top in alive:
                        alive.discard(top)
                        alive.add(back[top])
                    top -= 1
                final = alive.pop()
            if final:
                yield self._path(text, last, back, final), len(text), more is not None
                # the piece before the window stays, as the next border needs it
                text, last, back = text[final:], last[final:], [0, *(b - final if b >= 0 else -1 for b in back[final + 1 :])]
            if more is None:
                return

    def stream(self, parts: Iterator[str]) -> Iterator[int]:
        """The ids of ``commits``, one by one."""
        for ids, _, _ in self.commits(parts):
            yield from ids

    def _path(self, text: str, last: list, back: list, at: int) -> list[int]:
        ids = []
        while at > 0:
            if last[at] == self.bare:
                ids.extend(self.byte_id[b] for b in reversed(text[at - 1].encode()))
            else:
                ids.append(last[at])
            at = back[at]
        return ids[::-1]

    # -- texts --------------------------------------------------------------------------------------------

    def _stretch(self, chunk: str) -> bytes:
        """All that the stream commits for a stretch; all paths meet at its end, so it can be remembered."""
        found = array("i")
        for ids, _, _ in self.commits(parts_of(chunk)):
            found.extend(ids)
        ids = found.tobytes()
        if len(chunk) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids as 32-bit integers."""
        if not text:
            return np.empty(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        if not self.by_stretch:
            return np.fromiter(self.stream(parts_of(marked)), dtype=np.int32)
        memo, out = self.memo.get, []
        for chunk in self.cuts(marked):
            ids = memo(chunk)
            out.append(self._stretch(chunk) if ids is None else ids)
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text again; the mark itself decodes as a space, as in the library."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


@cache
def model(path: str) -> PieceModel:
    """One model for each worker process."""
    return PieceModel(path)


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.concatenate([np.empty(0, np.int32), *ids])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def encode_pieces(df: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "piece_ids", count_col: str = "n_pieces") -> DataFrame:
    """``df`` with the ids of each text (array<int>) and their number.

    Null and empty texts get an empty array.  Columns of ``df`` that bear a result's name are replaced.
    Other columns pass through as they are; repeated rows are encoded each; very long texts are streamed.
    """
    kept = [f for f in df.schema.fields if f.name.lower() not in (ids_col.lower(), count_col.lower())]
    names = [f.name for f in kept]
    at = names.index(text_col)
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(count_col, T.LongType())])

    def run(batches):
        encode = model(model_path).encode
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = id_lists([encode(t or "") for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, lists, lists.value_lengths().cast(pa.int64())], names=[*names, ids_col, count_col])

    return map_batches(df.select(*(F.col(f"`{n}`") for n in names)), run, schema)


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(doc_id, text), one row for each row of ``df``.

    Null and empty arrays decode as empty texts, a null id stays null, repeated rows are decoded each, very
    long arrays whole; an empty table gives no rows; other columns are not read.
    """

    @per_task
    def task():
        decode = model(model_path).decode
        return lambda doc_ids, ids: {"doc_id": doc_ids, "text": [decode(x or []) for x in ids]}

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), "doc_id long, text string", task)


def encode_and_check(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, piece_ids, round_trip): encoding, and whether decoding gives the text back.

    ``round_trip`` compares with the text after replacing the mark U+2581 by a space, which the model
    cannot tell apart.  Null and empty texts have no pieces and come back as empty; a null id stays null;
    repeated rows are encoded each; very long texts are streamed; an empty table gives no rows; other columns
    are not read.
    """

    @per_task
    def task():
        m = model(model_path)

        def work(doc_ids, texts):
            ids = [m.encode(t or "") for t in texts]
            same = [m.decode(i.tolist()) == (t or "").replace(MARK, " ") for i, t in zip(ids, texts, strict=True)]
            return {"doc_id": doc_ids, "n_pieces": [len(i) for i in ids], "piece_ids": id_lists(ids), "round_trip": same}

        return work

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, n_pieces long, piece_ids array<int>, round_trip boolean", task, slice_rows=128)
