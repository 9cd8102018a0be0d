import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

from larder.llm import media


def png(n=1):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", n, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (n + 1))) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x03x\x01\x02\x03\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\ntrailer\n%%EOF"
OGG = b"OggS\x00\x06" + b"\0" * 20 + b"\x01\x03abc"
MP4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov"
FLAC = b"fLaC\x80\x00\x00\x22" + b"\0" * 34


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "b")
    return out.getvalue()


FILES = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "application/ogg": OGG, "video/mp4": MP4, "audio/flac": FLAC, "application/zip": zipped(), "application/gzip": gzip.compress(b"abc" * 99), "audio/wav": media.to_wav(b"\x01" * 576), "image/webp": b"RIFF" + struct.pack("<I", 14) + b"WEBPVP8 \x02\0\0\0ab"}


def test_each_format_is_known_alone_and_embedded():
    for kind, data in FILES.items():
        assert media.sniff(data) == [(0, len(data), kind)], kind
        if kind != "audio/flac":  # its length is not stated: it takes the rest
            assert (7, len(data), kind) in media.sniff(b"garbage" + data + b"tail"), kind
        assert all(k != kind for _, _, k in media.sniff(data[: len(data) - 3])) or kind in ("audio/flac", "application/pdf", "image/jpeg"), kind
    assert media.sniff(None) == media.sniff(b"") == media.sniff(b"RIFF PNG GIF89a PK\x03\x04") == []


def test_columns(spark):
    rows = [(1, png(), "text/plain", "x"), (2, b"no", "text/plain", "x"), (3, None, None, None), (4, media.to_wav(b"ab" + GIF + b"\0"), None, "")]
    df = spark.createDataFrame(rows, "id int, media binary, declared string, actual_was string")
    out = {r.id: r for r in media.sniff_media(df).collect()}
    assert [out[i].actual for i in range(1, 5)] == ["image/png", "text/plain", None, "audio/wav"]
    found = out[4].embedded[0]
    assert bytes(out[4].media)[found.start : found.start + found.length] == GIF
    assert out[1].actual_was == "x" and out[3].embedded == []


def test_texts(spark):
    texts = [None, "", "x", "é" * 288, "y" * 577, "GIF89a RIFF", "z" * 200_000, "x"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    out = {r.doc_id: r for r in media.texts_as_media(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = out[i if i else None]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_bytes == len(payload) + 44
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest()
        assert (r.declared_type, r.actual_type) == ("application/octet-stream", "audio/wav")
    assert out[2].feature == out[7].feature and out[2].media_sha256 == out[7].media_sha256
    assert media.texts_as_media(df.where("false")).collect() == []


def test_two_files_of_each_format_are_two():
    for kind, data in FILES.items():
        if kind != "audio/flac":
            whole = b"garbage" + data + b" between " + data + b"tail"
            assert media.sniff(whole) == [(7, len(data), kind), (16 + len(data), len(data), kind)], kind
    updated = PDF + b"\n2 0 obj\nendobj\n%%EOF"
    assert media.sniff(b"ab" + updated + b"between" + PDF) == [(2, len(updated), "application/pdf"), (9 + len(updated), len(PDF), "application/pdf")]


def test_many_magic_bytes_take_time_by_their_length():
    page = b"OggS\x00\x00" + b"\0" * 20 + b"\x01\x03abc"
    segment = b"\xff\xe0\x00\x05\xff\xd8\xff"
    box = struct.pack(">I", 16) + b"ftypisom\0\0\0\0"
    units = [b"%PDF-1", b"PK\x03\x04", b"\x1f\x8b\x08\x00", b"\xff\xd8\xff", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"RIFFxxxxWAVE", b"fLaC", b"OggS", b"\0\0\0\x08ftyp", page, segment, box, b"GIF89a\x01\x00\x01\x00\x00\x00\x00!\x01\x01"]
    for unit in units:
        started = time.process_time()
        media.sniff(b"x" + unit * (1_000_000 // len(unit)) + b"OggS\x00\x00" + b"\0" * 20 + b"\xff")
        assert time.process_time() - started < 8, unit
    started = time.process_time()
    media.sniff(b"".join(units) * (10_000_000 // sum(map(len, units))))
    assert time.process_time() - started < 60


def test_gzip_headers_take_time_by_their_length():
    for unit in (b"\x1f\x8b\x08", b"\x1f\x8b\x08\x08abcdef", b"\x1f\x8b\x08\x18abcdef", b"\x1f\x8b\x08\x1c" + b"a" * 6 + b"\xff\xff" + b"\x1f\x8b\x08\x1c" + b"a" * 6 + b"\x01\x01"):
        for end in (b"", b"\0", b"\0a\0"):
            started = time.process_time()
            assert media.sniff(b"x" + unit * (1_000_000 // len(unit)) + end) == []
            assert time.process_time() - started < 8, unit


def test_gzip_header_fields():
    body = zlib.compress(b"abc" * 99, wbits=-15) + struct.pack("<II", zlib.crc32(b"abc" * 99), 297)
    fields = {4: b"\x03\0x\0y", 8: b"name\0", 16: b"said\0"}
    for flags in range(32):
        head = b"\x1f\x8b\x08" + bytes([flags]) + b"\0" * 6 + b"".join(f for bit, f in fields.items() if flags & bit)
        data = head + (struct.pack("<H", zlib.crc32(head) & 0xFFFF) if flags & 2 else b"") + body
        assert gzip.decompress(data) == b"abc" * 99
        assert media.sniff(b"before" + data + b"\0after") == [(6, len(data), "application/gzip")], flags
        for wrong in (data[:3] + bytes([flags | 0x20]) + data[4:], data[:-1] + b"\x07", data[:-1]):
            assert media.sniff(b"before" + wrong) == [], flags
        if flags & 2:
            assert media.sniff(head + b"\0\0" + body) == []
    long = gzip.compress(bytes(5_000_000))
    assert media.sniff(b"x" + long + b"tail") == [(1, len(long), "application/gzip")]


def test_columns_of_our_names_stay(spark):
    df = spark.createDataFrame([(1, png(), "text/plain", "a", "e", "m")], "id int, bytes binary, kind string, actual string, embedded string, media string")
    out = media.sniff_media(df, "bytes", "kind")
    assert out.columns == ["id", "bytes", "kind", "actual", "embedded", "media", "actual_", "embedded_"]
    assert tuple(out.first())[3:] == ("a", "e", "m", "image/png", [])
