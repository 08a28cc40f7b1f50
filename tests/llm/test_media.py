import hashlib
import struct
import time
import zlib

import numpy as np

from taskweft.llm import op9_media as o


def png(w=3, h=2):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x11\xff\x00\x22\xff\xd9"
PDF = b"%PDF-1.4 x startxref 0 %%EOF"


def zipped():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


def test_formats():
    finder = o.automaton()
    for kind, data in (("image/png", png()), ("image/gif", GIF), ("image/bmp", BMP), ("image/jpeg", JPEG), ("application/pdf", PDF), ("audio/wav", o.as_wav(b"\1\2" * 5)), ("application/zip", zipped())):
        assert o.sniff(data, finder) == [(kind, 0, len(data))], kind
        assert o.sniff(b"junk" + data + b"tail", finder)[0] == (kind, 4, len(data))
        assert not any(n == len(data) for _, _, n in o.sniff(data[:-1], finder)), kind
    for broken in (b"BM", b"RIFF", b"GIF89a", b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"fLaC", png()[:-6] + b"xxxxxx", b"BMP is a word", b"\xff" * 600):
        assert o.sniff(broken, finder) == [], broken


def test_updated_pdf_and_many_marks():
    finder = o.automaton()
    updated = PDF + b"\n9 0 obj startxref 7 %%EOF"
    assert o.sniff(updated + PDF, finder) == [("application/pdf", 0, len(updated)), ("application/pdf", len(updated), len(PDF))]
    started = time.time()
    assert o.sniff(b"%PDF-1 x" * 40_000, finder) == [] and o.sniff(b"PK\x03\x04ab" * 40_000, finder) == []
    assert o.sniff(b"PK\x03\x04ab" * 20_000 + zipped(), finder) == [("application/zip", 120_000, len(zipped()))]
    assert time.time() - started < 5
    flac = b"fLaC\x80\0\0\x22" + struct.pack(">HH", 4096, 4096) + b"\0" * 6 + bytes.fromhex("0ac442") + b"\0" * 21 + b"\xff\xf8data"
    assert o.sniff(flac, finder) == [("audio/flac", 0, len(flac))] and o.sniff(flac.replace(b"\x0a\xc4\x42", b"\0\0\x02"), finder) == []


def test_odd_media(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", PDF, "x"), (None, None, None), ("z", b"z" * 3_000_000 + GIF, None)], "id string, b binary, said string")
    clash = df.withColumns({c: F.lit("extra") for c in ("kind", "declared", "items", "n_bytes", "corrected", "content")})
    got = [sorted(map(repr, o.sniff_media(x, "id", "b", "said").collect())) for x in (df, clash)]
    assert got[0] == got[1] and len(got[0]) == 3 and o.sniff_media(df.limit(0), "id", "b").count() == 0


def test_carving(spark):
    rows = [("a", png() + b"xx" + GIF, "image/jpeg"), ("b", None, None), ("c", b"", "image/png"), ("d", b"text " + BMP, None), ("a", png() + b"xx" + GIF, "image/png")]
    got = o.sniff_media(spark.createDataFrame(rows, "id string, b binary, said string"), "id", "b", "said").collect()
    assert [(r.id, r.kind, r.corrected, len(r["items"])) for r in got] == [("a", "image/png", True, 2), ("b", "application/octet-stream", False, 0), ("c", "application/octet-stream", True, 0), ("d", "application/octet-stream", False, 1), ("a", "image/png", False, 2)]
    assert bytes(got[0]["items"][1].content) == GIF


def test_texts(spark, odd, clash, none):
    out = lambda df: sorted(map(tuple, o.media_features(o.store_texts(df)).collect()), key=repr)
    got = out(odd)
    assert got == out(clash) and len(got) == 10 and out(none) == []
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for doc_id, n_bytes, payload_bytes, sha, tail, media_bytes, media_sha, feature in got:
        raw = texts[doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = o.as_wav(payload)
        assert (n_bytes, payload_bytes, sha, tail) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (media_bytes, media_sha) == (len(stored), hashlib.sha256(stored).hexdigest()) and feature.startswith("audio/wav;corrected=1;")


def test_quoted_file_is_found(spark):
    text = "see " + PDF.decode() + " end"
    row = o.media_features(o.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row.feature.endswith(f"inner=application/pdf@4+{len(PDF)}")


def test_random_bytes_do_not_crash():
    finder, rng = o.automaton(), np.random.default_rng(2)
    magics = [m for ms in o.MAGIC.values() for m, _ in ms]
    for _ in range(3000):
        o.sniff(b"".join(magics[rng.integers(len(magics))] + rng.bytes(rng.integers(0, 40)) for _ in range(3)), finder)
