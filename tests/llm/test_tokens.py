import random

import pytest

from taskweft.llm import op7_token_counts as counts, op8_pieces as pieces
from taskweft.llm.queries import PIECE_MODEL, WORD_TOKENIZER, tokenizer_path

TEXTS = ["", " ", "a  b", "It's 'S n't 1234 don't", "<|endoftext|> x<|startoftext|>y", "É é ΑΣ ǅ İ", "tab\tnew\nline\x0b\x1c\x85\xa0x", "漢字😀é", "x" * 3000, "▁a ▁", "1" * 50, "  lead and trail  ", "²", "²."]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    alphabet = list("abcdeé 's,.!ΣİA1漢▁\n\t") + ["  ", "<|endoftext|>", "token", "ing", "²."]
    return TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)]


def test_counts_equal_the_library(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in counts.count_tokens(df, tokenizer_path(WORD_TOKENIZER), limit=20).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want[i] > 20) for i, t in enumerate(texts))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        counts.check_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        counts.check_tokenizer(tokenizer_path(PIECE_MODEL))


def test_odd_rows_count(spark, odd, clash, none):
    path = tokenizer_path(WORD_TOKENIZER)
    got = sorted(map(tuple, counts.count_tokens(odd, path).collect()), key=repr)
    assert got == sorted(map(tuple, counts.count_tokens(clash, path).collect()), key=repr) and len(got) == 10
    assert (2, 0, 0, False) in got and (3, 0, 0, False) in got and (7, 199_999, 40_000, True) in got
    assert counts.count_tokens(none, path).count() == 0


def test_memo_is_bounded(spark, texts, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 5)
    m = pieces.PieceModel(tokenizer_path(PIECE_MODEL))
    for t in texts:
        m.encode(t)
    assert len(m.memo) <= 5


def test_pieces_equal_the_library(texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    m = pieces.PieceModel(tokenizer_path(PIECE_MODEL))
    for t in texts:
        want = sp.encode(t)
        assert m.encode(t).tolist() == want, t
        assert not t or list(m.stream(iter("▁" + t.replace(" ", "▁")))) == list(m.stream(pieces.parts_of("▁" + t.replace(" ", "▁")))) == want
        assert m.decode(want) == t.replace("▁", " ")


def test_stream_commits_early():
    m = pieces.PieceModel(tokenizer_path(PIECE_MODEL))
    taken = 0

    def chars():
        nonlocal taken
        for c in "▁the▁quick" * 2000:
            taken += 1
            yield c

    ids = m.stream(chars())
    next(ids)
    assert taken <= 4 * pieces.LOOK_EVERY


def test_most_ids_are_committed_where_paths_meet(spark, sf):
    """Over real texts, without the memo: the window stays small and nearly no id waits for the end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    m = pieces.PieceModel(tokenizer_path(PIECE_MODEL))
    met = ended = widest = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect():
        ids = []
        for part, window, early in m.commits(pieces.parts_of(pieces.MARK + r.text.replace(" ", pieces.MARK))):
            ids += part
            met, ended, widest = met + early * len(part), ended + (not early) * len(part), max(widest, window)
        assert ids == sp.encode(r.text)
    assert met > 0.95 * (met + ended) and widest <= 4 * m.longest + pieces.LOOK_EVERY


def test_models_that_change_texts_are_refused(monkeypatch):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda sp, text, **how: plain(sp, text.replace("  ", " ") if isinstance(text, str) else text, **how))
    with pytest.raises(ValueError, match="normalises"):
        pieces.PieceModel(tokenizer_path(PIECE_MODEL))


def test_odd_rows_encode(spark, odd, clash, none):
    path = tokenizer_path(PIECE_MODEL)
    got = pieces.encode_pieces(odd, path)
    assert got.columns == [*odd.columns, "piece_ids", "n_pieces"] and got.count() == 10
    assert {r.doc_id: r.n_pieces for r in got.collect()}[2] == 0
    again = pieces.encode_pieces(clash, path)
    assert sorted(again.columns) == sorted(clash.columns) and again.where("key = 'extra'").count() == 10
    back = {r.doc_id: r.text for r in pieces.decode_pieces(got, path).collect()}
    assert back[2] == "" and back[7] == odd.where("doc_id = 7").first().text
    assert all(r.round_trip for r in pieces.encode_and_check(odd, path).collect())
    assert pieces.encode_pieces(none, path).count() == 0
