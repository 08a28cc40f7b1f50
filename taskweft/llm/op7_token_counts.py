"""Token counts without token ids.

Texts are cut at ASCII white space into pre-tokens.  The tokenizer drops white space and none of its
pieces spans it, so a text's count is the sum over its distinct pre-tokens of frequency times pieces.  In
each slice of documents the pieces of every distinct pre-token are counted once, by the library itself,
and joined to the per-document frequencies; a bounded memo carries the counts between slices of a task.

The join stays inside the task.  As a shuffled join it would move one row for each document and distinct
word (about 95 million rows for 0.5 GB of Parquet, twice the input), to save only repeated piece counts
of the words that several tasks share.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskweft.llm.common import map_rows, per_task

#: Pre-tokens whose counts a task remembers; the memo is emptied when it holds more.
MEMO_WORDS = 300_000


def piece_counter(tokenizer_path: str):
    """words (bytes) -> pieces of each, by the library, in one batch call."""
    if tokenizer_path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path)
        return lambda words: [len(x) for x in sp.encode([w.decode() for w in words], num_threads=1)]
    import os

    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    t = Tokenizer.from_file(tokenizer_path)
    t.no_truncation()
    t.no_padding()
    return lambda words: [len(x.ids) for x in t.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


def count_tokens(df: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``df``.

    The tokenizer must drop white space and never join across it (``word_bpe``); ``ValueError`` otherwise.
    Null texts count as empty: 0 bytes, 0 tokens.  Repeated rows are counted each; a null id stays null;
    other columns are not read.  Very long texts are processed whole, in their own slice memory.
    """
    check_tokenizer(tokenizer_path)

    @per_task
    def task():
        count, memo = piece_counter(tokenizer_path), {}

        def work(ids, texts):
            raw = [(t or "").encode() for t in texts]
            freq = [Counter(r.split()) for r in raw]
            distinct = list(dict.fromkeys(chain.from_iterable(freq)))
            new = [w for w in distinct if w not in memo]
            if len(memo) + len(new) > MEMO_WORDS:
                memo.clear()
                new = distinct
            for at in range(0, len(new), 20_000):
                memo.update(zip(new[at : at + 20_000], count(new[at : at + 20_000]), strict=True))
            totals = [sum(map(int.__mul__, map(memo.__getitem__, f), f.values())) for f in freq]
            return {
                "doc_id": ids,
                "n_bytes": [len(r) for r in raw],
                "n_tokens": pa.array(np.asarray(totals, dtype=np.int64)),
                "over_limit": [n > limit for n in totals],
            }

        return work

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", task)


def check_tokenizer(tokenizer_path: str) -> None:
    """White space must leave no piece and join nothing."""
    if tokenizer_path.endswith(".model"):
        raise ValueError("sentencepiece models keep white space in their pieces; use the encoding operator")
    count = piece_counter(tokenizer_path)
    if count([b" ", b"\n\t"]) != [0, 0] or count([b"a b"])[0] != sum(count([b"a", b"b"])):
        raise ValueError("this tokenizer keeps white space; pre-tokens cannot be cut there")
