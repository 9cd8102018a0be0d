"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent zstd frames, each with up to `FRAME` bytes of whole records,
closed by the seek table of the seekable format (a skippable frame with each frame's
compressed and plain size, and a footer). An index maps a record to its bundle, frame and place
in the plain frame, so that one record costs one frame to read.

Rows meet their payload's response by an equi-join on the digest; both sides are written or
read tables, so adaptive execution can split the digest that a third of all pages share. The
payload moves once; a revisit record carries no payload.

Defined results: a null payload is the empty one; of equal payloads the largest page_id is the
response (rows repeating that id are responses too), a page without an id is a response only
where no page with its payload has an id; payloads under `least` bytes are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import staged

FRAME = 256 * 1024  # plain bytes at which a frame closes
BUNDLE = 8 * 1024 * 1024  # compressed bytes at which a bundle closes
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
CRLF = b"\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, response: bool) -> bytes:
    kind = b"response" if response else b"revisit"
    head = [b"WARC/1.1", b"WARC-Type: " + kind, b"WARC-Payload-Digest: sha1:" + digest.encode(), b"WARC-Payload-Length: %d" % len(payload)]
    if page_id is not None:
        head.append(b"WARC-Record-ID: <urn:page:%d>" % page_id)
    if url is not None:
        head.append(b"WARC-Target-URI: " + "".join(url.split()).encode("utf-8", "surrogatepass"))
    if refers_to is not None and not response:
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
    body = payload if response else b""
    head.append(b"Content-Length: %d" % len(body))
    return CRLF.join(head) + CRLF + CRLF + body + CRLF + CRLF


def parse_records(plain: bytes):
    """(place, length, headers, body) of each record."""
    at = 0
    while at < len(plain):
        end = plain.index(CRLF + CRLF, at)
        head = dict(line.split(b": ", 1) for line in plain[at:end].split(CRLF)[1:])
        start = end + 4
        body = plain[start : start + int(head[b"Content-Length"])]
        stop = start + len(body) + 4
        yield at, stop - at, head, body
        at = stop


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", *x) for x in sizes)
    footer = struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the bundle's footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table, at, out = bundle[-9 - n * width : -9], 0, []
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(bundle: bytes, k: int) -> bytes:
    at, packed, plain = frames_of(bundle)[k]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=plain)


class Bundler:
    """Collects records; closed bundles come out of add and close."""

    def __init__(self):
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self._open()

    def _open(self):
        self.frames, self.sizes, self.plain, self.length, self.records = [], [], [], 0, 0

    def _frame(self):
        if self.plain:
            plain = b"".join(self.plain)
            self.frames.append(self.packer.compress(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.plain, self.length = [], 0

    def add(self, record: bytes):
        self.plain.append(record)
        self.length += len(record)
        self.records += 1
        if self.length >= FRAME:
            self._frame()
            if sum(map(len, self.frames)) >= BUNDLE:
                yield from self.close()

    def close(self):
        self._frame()
        if self.frames:
            yield b"".join([*self.frames, seek_table(self.sizes)]), len(self.frames), self.records
        self._open()


def _bundles(batches):
    from pyspark import TaskContext

    bundler, made, part = Bundler(), 0, TaskContext.get().partitionId()

    def row(found):
        nonlocal made
        content, frames, records = found
        made += 1
        return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{made - 1:05d}.warc.zst"]), pa.array([frames], pa.int32()), pa.array([records], pa.int64()), pa.array([content], pa.binary())], ["bundle", "frames", "records", "content"])

    for batch in batches:
        names = ("page_id", "url", "payload", "digest", "refers_to", "response")
        for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            for found in bundler.add(record_bytes(*r)):
                yield row(found)
    for found in bundler.close():
        yield row(found)


def _number(head: dict, key: bytes) -> int | None:
    return int(head[key][len(b"<urn:page:") : -1]) if key in head else None


def _read(batches):
    for batch in batches:
        for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content").to_pylist(), strict=True):
            for k in range(len(frames_of(content))):
                rows = [(_number(h, b"WARC-Record-ID"), int(h[b"WARC-Payload-Length"]), h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), h[b"WARC-Type"].decode(), _number(h, b"WARC-Refers-To"), name, k, at, n, digest32(b) if h[b"WARC-Type"] == b"response" else None) for at, n, h, b in parse_records(read_frame(content, k))]
                for r in rows:
                    if r[9] not in (None, r[2]):
                        raise ValueError(f"damaged payload in {name}, frame {k}")
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "place", "record_bytes"])


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, place long, record_bytes long"


def write_bundles(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """bundle, frames, records and content (the archive's bytes) of the archives of all rows,
    kept as a table in the shared folder."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"))
    best = staged(rows.groupBy("sha1").agg(F.max("page_id").alias("best")), "warc-digests")
    met = rows.join(best, "sha1")
    # null-safe: where every equal payload lacks an id, best is null and all are responses
    response = F.col("page_id").eqNullSafe(F.col("best")) | (F.length("payload") < least)
    named = met.select("page_id", "url", "payload", "sha1", response.alias("response"), F.when(~response, F.col("best")).alias("refers_to"))
    return staged(named.select("page_id", "url", "payload", _base32("sha1").alias("digest"), "refers_to", "response").mapInArrow(_bundles, "bundle string, frames int, records long, content binary"), "warc-bundles", "uncompressed")


def _base32(sha1_hex: str):
    """Hex digits to RFC 4648 digits: 20 bits, four digits, at a time."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(sha1_hex, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    return F.concat(*[F.substring(F.lit(alphabet), F.shiftright(g, s).bitwiseAND(31) + 1, 1) for g in groups for s in (15, 10, 5, 0)])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """The records of all bundles with their places: also the index by page_id."""
    return bundles.select("bundle", "content").mapInArrow(_read, READ)


def fetch_payloads(bundles: DataFrame, index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """page_id and payload of the asked pages, a revisit by the record it refers to: only the
    frames that the index names are read."""

    def run(batches):
        for batch in batches:
            ids, payloads = batch.column("page_id").to_pylist(), []
            for content, k, at, n in zip(*(batch.column(c).to_pylist() for c in ("content", "frame", "place", "record_bytes")), strict=True):
                payloads.append(next(parse_records(read_frame(content, k)[at : at + n]))[3])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], ["page_id", "payload"])

    asked = index.join(page_ids.select("page_id").distinct(), "page_id").select("page_id", F.coalesce("refers_to", "page_id").alias("at"))
    places = index.where("record_type = 'response'").select(F.col("page_id").alias("at"), "bundle", "frame", "place", "record_bytes").dropDuplicates(["at"])
    return asked.join(places, "at").join(bundles.select("bundle", "content"), "bundle").select("page_id", "content", "frame", "place", "record_bytes").mapInArrow(run, "page_id long, payload binary")
