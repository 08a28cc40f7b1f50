"""Media columns: find what stored bytes really are.

An Aho-Corasick automaton finds every magic number of the known formats in one pass.  At each hit a
validator walks the format's own structure (chunk lengths, checksums, trailers) and gives the exact
length, or rejects the hit.  The first valid item at offset 0 corrects the declared type; items further
in are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from taskweft.llm.common import map_rows, per_task

# Magic numbers and the offset at which they stand.
MAGIC = {
    "image/png": [(b"\x89PNG\r\n\x1a\n", 0)],
    "image/jpeg": [(b"\xff\xd8\xff", 0)],
    "image/gif": [(b"GIF87a", 0), (b"GIF89a", 0)],
    "image/bmp": [(b"BM", 0)],
    "audio/wav": [(b"RIFF", 0)],
    "audio/flac": [(b"fLaC", 0)],
    "application/pdf": [(b"%PDF-", 0)],
    "application/zip": [(b"PK\x03\x04", 0)],
}


def _png(b: bytes, at: int) -> int | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, pos)
        kind = b[pos + 4 : pos + 8]
        if (first and (kind != b"IHDR" or n != 13)) or pos + 12 + n > len(b):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return pos - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos, scan = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        kind = b[pos + 1]
        if kind == 0xFF:
            pos += 1
            continue
        if kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            return None
        (n,) = struct.unpack_from(">H", b, pos + 2)
        if n < 2 or pos + 2 + n > len(b):
            return None
        pos += 2 + n
        if kind == 0xDA:
            scan = True
            while True:  # entropy-coded data end at the next marker that is neither stuffing nor a restart
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return None
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
            if b[pos + 1] == 0xD9:
                return pos + 2 - at if scan else None
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(pos: int) -> int | None:
        while pos < len(b):
            n = b[pos]
            pos += 1 + n
            if n == 0:
                return pos
        return None

    seen = False
    while pos is not None and pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at if seen else None
        if kind == 0x21:
            pos = blocks(pos + 2)
        elif kind == 0x2C and pos + 10 < len(b):
            flags, seen = b[pos + 9], True
            pos = blocks(pos + 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1)
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or header not in (40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0:
        return None
    if offset < 14 + header or offset > size or at + size > len(b):
        return None
    packed = b[at + 30 : at + 34] == b"\0\0\0\0"
    return size if not packed or size >= offset + ((width * bits + 31) // 32 * 4) * abs(height) else None


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, kinds = at + 12, []
    if end > len(b):
        return None
    while pos + 8 <= end:
        kinds.append(b[pos : pos + 4])
        n = struct.unpack_from("<I", b, pos + 4)[0]
        pos += 8 + n + (n & 1)
    return end - at if pos == end and kinds[:1] == [b"fmt "] and b"data" in kinds else None


def _flac(b: bytes, at: int) -> int | None:
    """Frames carry no lengths: valid if the metadata chain is; it then runs to the end of the bytes."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        last, kind, n = b[pos] >> 7, b[pos] & 127, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if (first and (kind != 0 or n != 34)) or pos + 4 + n > len(b):
            return None
        if first:  # block sizes, then 20 bits of sample rate
            least, most = struct.unpack_from(">HH", b, pos + 4)
            if not 16 <= least <= most or not int.from_bytes(b[pos + 14 : pos + 17], "big") >> 4:
                return None
        pos, first = pos + 4 + n, False
        if last:
            return len(b) - at if b[pos : pos + 2] in (b"\xff\xf8", b"\xff\xf9") else None
    return None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before the next header: each update of a document adds a part with a mark of its own."""
    after = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, after if after >= 0 else len(b))
    return end + 5 - at if end > 0 and b[at + 5 : at + 6].isdigit() and b.find(b"startxref", at, end) > 0 else None


def zip_lengths(b: bytes) -> dict[int, int]:
    """Start -> length of each archive, from the end records: they tell where the archive must start.

    One pass over the bytes, however many entries or broken marks they hold.
    """
    out: dict[int, int] = {}
    end = b.find(b"PK\x05\x06")
    while end >= 0 and end + 22 <= len(b):
        size, offset, note = struct.unpack_from("<IIH", b, end + 12)
        at = end - offset - size
        if at >= 0 and (size == 0 or b[at + offset : at + offset + 4] == b"PK\x01\x02") and end + 22 + note <= len(b):
            out.setdefault(at, end + 22 + note - at)
        end = b.find(b"PK\x05\x06", end + 1)
    return out


VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "audio/flac": _flac, "application/pdf": _pdf}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for magic, offset in magics:
            out.add_word(magic.decode("latin-1"), (kind, len(magic) + offset))
    out.make_automaton()
    return out


def sniff(b: bytes, finder: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(type, offset, length) of each valid item, leftmost first, none inside another."""
    found, free, zips = [], 0, None
    for end, (kind, n) in finder.iter(b.decode("latin-1")):
        at = end + 1 - n
        if at < free:
            continue
        if kind == "application/zip":
            zips = zip_lengths(b) if zips is None else zips
            length = zips.get(at)
        else:
            length = VALID[kind](b, at)
        if length:
            found.append((kind, at, length))
            free = at + length
    return found


def sniff_media(df: DataFrame, id_col: str, bytes_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, declared, kind, corrected, n_bytes, items) for each row; ``items`` has kind, offset, length and the carved bytes.

    ``kind`` is the valid item at offset 0, or ``application/octet-stream``; ``corrected`` tells that it
    differs from the declared type.  Null bytes count as empty: no item; a null id or declared type stays
    null.  Repeated rows are judged each; very long bytes are searched whole; an empty table gives no rows;
    other columns are not read, whatever their names.
    """
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(bytes_col).cast("binary").alias("b"), (F.col(declared_col).cast("string") if declared_col else F.lit(None).cast("string")).alias("declared"))

    @per_task
    def task():
        finder = automaton()

        def work(ids, blobs, declared):
            out = {k: [] for k in ("kind", "corrected", "n_bytes", "items")}
            for b, said in zip(blobs, declared, strict=True):
                b = b or b""
                items = sniff(b, finder)
                kind = items[0][0] if items and items[0][1] == 0 else "application/octet-stream"
                out["kind"].append(kind)
                out["corrected"].append(said is not None and said != kind)
                out["n_bytes"].append(len(b))
                out["items"].append([{"kind": k, "offset": at, "length": n, "content": b[at : at + n]} for k, at, n in items])
            return out | {"id": ids, "declared": declared}

        return work

    return map_rows(source, "id string, declared string, kind string, corrected boolean, n_bytes long, items array<struct<kind:string,offset:long,length:long,content:binary>>", task, slice_rows=64)


# -- text as media -----------------------------------------------------------------------------------------

BLOCK = 576
#: The declared type is wrong on purpose; sniffing has to correct it.
DECLARED = "application/octet-stream"


def as_wav(payload: bytes) -> bytes:
    """8-bit mono samples at 8 kHz; the payload's length is even."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def wav_samples(stored: bytes) -> bytes:
    pos = 12
    while pos + 8 <= len(stored):
        n = struct.unpack_from("<I", stored, pos + 4)[0]
        if stored[pos : pos + 4] == b"data":
            return stored[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, media), one row for each row of ``df``: each text as the samples of a WAV file.

    Null and empty texts are one block of padding; a null id stays null; repeated rows are stored each; very
    long texts whole (up to the format's 4 GB); an empty table gives no rows; other columns are not read.
    """

    def work(ids, texts):
        raw = [(t or "").encode() for t in texts]
        padded = [r + b"\xff" * (-len(r) % BLOCK if r else BLOCK) for r in raw]
        return {"doc_id": ids, "n_bytes": [len(r) for r in raw], "declared": [DECLARED] * len(raw), "media": [as_wav(p) for p in padded]}

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, n_bytes long, declared string, media binary", work, slice_rows=128)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests of what is read back from (doc_id, n_bytes, declared, media).

    Each row's bytes are sniffed; the payload is the samples of the WAV carved at offset 0.  The feature
    names the sniffed type, whether it corrects the declared one, the carved length, and each further
    item found inside the payload (a text may quote another file).  Bytes that are no WAV have a null
    payload.  Null ids stay null and repeated rows are digested each; an empty table gives no rows; other
    columns are not read.
    """

    @per_task
    def task():
        finder = automaton()

        def work(ids, n_bytes, declared, media):
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
            out = {k: [] for k in names}
            for said, b in zip(declared, media, strict=True):
                b = b or b""
                items = sniff(b, finder)
                kind, _, n = items[0] if items and items[0][1] == 0 else ("application/octet-stream", 0, 0)
                payload = wav_samples(b[:n]) if kind == "audio/wav" else None
                inner = sniff(payload, finder) if payload else []
                feature = f"{kind};corrected={int(said != kind)};length={n};inner=" + "|".join(f"{k}@{at}+{m}" for k, at, m in inner)
                row = (None if payload is None else len(payload), None if payload is None else hashlib.sha256(payload).hexdigest(), None if payload is None else zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature)
                for k, v in zip(names, row, strict=True):
                    out[k].append(v)
            return out | {"doc_id": ids, "n_bytes": n_bytes}

        return work

    return map_rows(stored, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", task, slice_rows=128)
