"""Media columns: signature sniffing, type correction and carving.

A media column holds bytes and a declared type. One Aho-Corasick pass finds the magic bytes of
every format at once; a validator per format then reads the structure at that place and its
length. A file that is valid from its first byte corrects the declared type; valid files
further in are embedded and can be carved. Magic bytes without a valid structure are nothing.

Numbers, formats and chunk names below are those of the public format specifications.

Defined results: null or empty bytes have no type and nothing embedded; the declared type stays
when nothing valid starts at byte 0. Of places inside an embedded file that was found, none is
reported again (the outermost file counts). A PDF reaches to its last end marker before the next
PDF's header. Very long values are scanned whole, in time by their length; equal values give equal
rows. `sniff_media` keeps all other columns (those named actual or embedded get underscores behind
their names), `texts_as_media` reads the id and the text alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.columns import free_name, named, packed
from larder.session import staged

# Magic bytes and where, from a file's start, they stand.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n", 0),
    "image/gif": (b"GIF8", 0),
    "image/jpeg": (b"\xff\xd8\xff", 0),
    "audio/wav": (b"WAVE", 8),
    "image/webp": (b"WEBP", 8),
    "application/pdf": (b"%PDF-", 0),
    "application/zip": (b"PK\x03\x04", 0),
    "application/gzip": (b"\x1f\x8b\x08", 0),
    "audio/flac": (b"fLaC", 0),
    "application/ogg": (b"OggS", 0),
    "video/mp4": (b"ftyp", 4),
}
SAMPLES = 576  # payloads are filled up to a multiple of this
RATE = 8000
PIECE = 65536  # bytes given to a decompressor at once


class Value:
    """The bytes of one value, and what was already found in them: magic bytes may be many, and each end
    marker is looked for once, each chain of chunks is walked once."""

    def __init__(self, data: bytes):
        self.data, self._next, self._ends = data, {}, {}

    def __len__(self) -> int:
        return len(self.data)

    def number(self, at: int, size: int, order: str) -> int:
        return int.from_bytes(self.data[at : at + size], order)

    def next(self, marker: bytes, at: int, use: str = "") -> int:
        """The first place from `at` on where the marker is, -1 if none. Uses that look at places of their own order
        remember apart; bytes that were looked through for one are not looked through again."""
        since, place = self._next.get((marker, use), (at + 1, None))
        if place is None or 0 <= place < at:
            place = self.data.find(marker, at)
        elif at < since:
            before = self.data.find(marker, at, since + len(marker) - 1)
            place = before if before >= 0 else place
        else:
            return place
        self._next[marker, use] = at, place
        return place

    def follow(self, kind: str, at: int, step) -> int:
        """Where the chain from `at` leads: step(p) gives the next place and None, or None and the answer."""
        known, path = self._ends.setdefault(kind, {}), []
        while at not in known:
            path.append(at)
            at, answer = step(at)
            if at is None:
                break
        else:
            answer = known[at]
        known.update(dict.fromkeys(path, answer))
        return answer


def _riff(v: Value, at: int, kind: bytes, first: bytes) -> int:
    if v.data[at : at + 4] != b"RIFF" or v.data[at + 8 : at + 12] != kind or v.data[at + 12 : at + 12 + len(first)] != first:
        return 0
    size = 8 + v.number(at + 4, 4, "little")
    if at + size > len(v):
        return 0
    p, chunks = at + 12, 0
    while p + 8 <= at + size:  # chunks fill the file exactly
        p += 8 + (n := v.number(p + 4, 4, "little")) + n % 2
        chunks += 1
    return size if chunks and p in (at + size, at + size + 1) else 0


def _wav(v, at):
    return _riff(v, at, b"WAVE", b"fmt ")


def _webp(v, at):
    return _riff(v, at, b"WEBP", b"VP8")


def _png(v, at):
    def chunk(p):
        n, kind = v.number(p, 4, "big"), v.data[p + 4 : p + 8]
        if p + 12 + n > len(v) or zlib.crc32(v.data[p + 4 : p + 8 + n]) != v.number(p + 8 + n, 4, "big"):
            return None, 0
        return (None, p + 12 + n) if kind == b"IEND" else (p + 12 + n, None)

    if v.number(at + 8, 4, "big") != 13 or v.data[at + 12 : at + 16] != b"IHDR":
        return 0
    return max(v.follow("png", at + 8, chunk) - at, 0)


def _gif(v, at):
    data = v.data
    if data[at : at + 6] not in (b"GIF87a", b"GIF89a") or len(v) < at + 13:
        return 0

    def table(flags):
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def sub(p):
        return (p + data[p] + 1, None) if p < len(data) and data[p] else (None, p + 1)

    def part(p):
        if p >= len(data):
            return None, 0
        if data[p] == 0x3B:
            return None, p + 1
        if data[p] == 0x21:
            return v.follow("gif blocks", p + 2, sub), None
        if data[p] == 0x2C and p + 10 < len(data):
            return v.follow("gif blocks", p + 10 + table(data[p + 9]) + 1, sub), None
        return None, 0

    return max(v.follow("gif", at + 13 + table(data[at + 10]), part) - at, 0)


def _jpeg(v, at):
    def segment(p):
        if p + 4 > len(v) or v.data[p] != 0xFF:
            return None, 0
        kind, n = v.data[p + 1], v.number(p + 2, 2, "big")
        if kind in (0x00, 0xFF, 0xD8, 0xD9) or n < 2:
            return None, 0
        if kind == 0xDA:  # entropy-coded data to the end marker
            return None, v.next(b"\xff\xd9", p + 2 + n) + 2
        return p + 2 + n, None

    return max(v.follow("jpeg", at + 2, segment) - at, 0)


def _pdf(v, at):
    # a file may end several times, as updates are appended; the next file's header ends the search
    if not v.data[at + 5 : at + 6].isdigit():
        return 0
    stop = v.next(b"%PDF-", at + 5)
    end = v.data.rfind(b"%%EOF", at, len(v) if stop < 0 else stop)
    return end + 5 - at if end > 0 else 0


def _zip(v, at):
    end = v.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(v):
        return 0
    size, start = struct.unpack("<II", v.data[end + 12 : end + 20])
    return end - at + 22 + v.number(end + 20, 2, "little") if start + size == end - at else 0


def _gzip(v, at):
    def member(p):
        unzip, q, crc, n = zlib.decompressobj(-15), p, 0, 0
        try:
            while q < len(v) and not unzip.eof:
                rest = v.data[q : q + PIECE]
                q += len(rest)
                while rest and not unzip.eof:
                    out = unzip.decompress(rest, 1 << 20)
                    crc, n = zlib.crc32(out, crc), n + len(out)
                    rest = unzip.unconsumed_tail
        except zlib.error:
            return None, 0
        end = q - len(unzip.unused_data)
        return None, end + 8 if unzip.eof and v.data[end : end + 8] == struct.pack("<II", crc, n & 0xFFFFFFFF) else 0

    # the header is read here, as zlib would look for the end of its name anew for each of many headers; headers that
    # end at one place share what follows
    if at + 18 > len(v) or (flags := v.data[at + 3]) & 0xE0:
        return 0
    p = at + 10
    if flags & 4:
        p += 2 + v.number(p, 2, "little")
    for bit, field in ((8, "gzip name"), (16, "gzip comment")):
        if flags & bit:
            p = v.next(b"\0", p, field) + 1
            if not p:
                return 0
    p += flags & 2
    end = v.follow("gzip", p, member)
    if end and flags & 2 and zlib.crc32(v.data[at : p - 2]) & 0xFFFF != v.number(p - 2, 2, "little"):
        return 0
    return max(end - at, 0)


def _flac(v, at):
    # STREAMINFO comes first and has 34 bytes; the length of a stream isn't stated, it takes the rest
    return len(v) - at if len(v) >= at + 42 and v.data[at + 4] & 0x7F == 0 and v.number(at + 5, 3, "big") == 34 else 0


def _ogg(v, at):
    def page(p):
        if p + 27 > len(v) or v.data[p : p + 4] != b"OggS" or v.data[p + 4] != 0:
            return None, p  # no further page
        n = v.data[p + 26]
        size = 27 + n + sum(v.data[p + 27 : p + 27 + n])
        if p + size > len(v):
            return None, 0
        return (None, p + size) if v.data[p + 5] & 4 else (p + size, None)

    return max(v.follow("ogg", at, page) - at, 0)


def _mp4(v, at):
    def box(p):
        """The kind of the box at p and its end; none where no box is."""
        n, kind = v.number(p, 4, "big"), v.data[p + 4 : p + 8]
        if n == 1 and p + 16 <= len(v):
            n = v.number(p + 8, 8, "big")
        return (kind, p + n) if p + 8 <= len(v) and n >= 8 and p + n <= len(v) and kind.isalnum() else (b"", 0)

    def after(p):
        kind, end = box(p)
        return (end, None) if kind else (None, p)

    def has_moov(p):
        kind, end = box(p)
        return (None, int(kind == b"moov")) if not kind or kind == b"moov" else (end, None)

    return v.follow("mp4", at, after) - at if box(at)[0] == b"ftyp" and v.follow("moov", at, has_moov) else 0


VALID = {"image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "audio/wav": _wav, "image/webp": _webp, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "application/ogg": _ogg, "video/mp4": _mp4}


@lru_cache(maxsize=1)
def _automaton():
    a = ahocorasick.Automaton()
    for kind, (magic, offset) in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic) - 1 + offset))
    a.make_automaton()
    return a


def sniff(data: bytes | None) -> list[tuple[int, int, str]]:
    """(start, length, type) of the valid files in data: the one at 0 and the outermost inside."""
    if not data:
        return []
    value, found, inside = Value(data), [], 0
    for end, (kind, back) in _automaton().iter(data.decode("latin-1")):
        start = end - back
        if start < inside or start < 0:
            continue
        if n := VALID[kind](value, start):
            found.append((start, n, kind))
            # the file at 0 is the column's own; what it holds is embedded
            inside = start + n if start else 0
    return found


_INSIDE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))


def identify(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """The actual types and what is embedded, of a batch with the columns media and declared."""
    actual, embedded = [], []
    for data, declared in zip(batch.column("media").to_pylist(), batch.column("declared").to_pylist(), strict=True):
        found = sniff(data)
        own = next((k for s, _, k in found if s == 0), None)
        actual.append(own or declared)
        embedded.append([{"start": s, "length": n, "type": k} for s, n, k in found if s])
    return pa.array(actual, pa.string()), pa.array(embedded, _INSIDE)


def _identified(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("own"), *identify(batch)], ["own", "actual", "embedded"])


def sniff_media(media: DataFrame, content: str = "media", declared: str = "declared") -> DataFrame:
    """All columns, `actual` (the corrected type) and `embedded` (array of start, length, type;
    carve with substring(media, start + 1, length)); underscores follow a name that the input has."""
    rows = packed(media, named(content).alias("media"), named(declared).alias("declared"))
    out = rows.select("own", F.lit(None).cast("string").alias("actual"), F.lit(None).cast("array<struct<start:bigint,length:bigint,type:string>>").alias("embedded"))
    found = rows.mapInArrow(_identified, out.schema)
    return found.select("own.*", *(F.col(c).alias(free_name(c, media.columns)) for c in ("actual", "embedded")))


def to_wav(payload: bytes) -> bytes:
    """The payload as 8-bit mono samples; its length is even, so that no chunk needs filling."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def filled(text: bytes | None) -> bytes:
    """The bytes, and 255 up to a positive multiple of SAMPLES."""
    text = text or b""
    return text + b"\xff" * (max(1, -(-len(text) // SAMPLES)) * SAMPLES - len(text))


def _store(batches):
    for batch in batches:
        texts = [t or b"" for t in batch.column("__text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(["application/octet-stream"] * len(texts)), pa.array([to_wav(filled(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "declared", "media"])


def samples_of(wav: bytes) -> bytes:
    """The samples of the data chunk, found by walking the chunks."""
    p = 12
    while p + 8 <= len(wav):
        n = int.from_bytes(wav[p + 4 : p + 8], "little")
        if wav[p : p + 4] == b"data":
            return wav[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def _features(batches):
    for batch in batches:
        kinds, insides = identify(batch)
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data, kind, inside in zip(batch.column("media").to_pylist(), kinds.to_pylist(), insides.to_pylist(), strict=True):
            if kind != "audio/wav":
                raise ValueError(f"stored as audio/wav, read back as {kind}")
            payload = samples_of(data)
            level = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
            share = level[level > 0] / len(payload)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            parts = ",".join(f"{e['type']}@{e['start']}+{e['length']}" for e in inside)
            out["feature"].append(f"{kind};samples={len(payload)};mean={float(level @ np.arange(256)) / len(payload):.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};embedded=[{parts}]")
        longs = ("payload_bytes", "tail_crc32", "media_bytes")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, pa.int64() if k in longs else pa.string()) for k, v in out.items()), batch.column("declared"), kinds], ["doc_id", "n_bytes", *out, "declared_type", "actual_type"])


def texts_as_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every whole text as samples in a media table of the shared folder, read the table
    back, sniff and carve, and describe what was read."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("__text"))
    kept = own.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit("").alias("declared"), F.lit(b"").alias("media"))
    stored = staged(own.mapInArrow(_store, kept.schema), "media", "zstd")
    out = kept.select("doc_id", "n_bytes", *(F.lit(0).cast("long").alias(c) if c in ("payload_bytes", "tail_crc32", "media_bytes") else F.lit("").alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")), F.lit("").alias("declared_type"), F.lit("").alias("actual_type"))
    return stored.mapInArrow(_features, out.schema)
