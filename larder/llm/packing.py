"""Packing along a space-filling curve.

A document's token counts are hashed into `HASHED` columns, normalized and projected onto
`DIMS` fixed orthonormal directions; the cell of a 2**CELL_BITS grid that the projection falls
in has a place on the Hilbert curve, and documents are laid out in that order, so that a
sequence holds neighbours. The whole corpus is one gapless run of tokens along the curve, cut
every `LENGTH` tokens: only the last sequence can need padding.

Work: (1) tokenize once, into a written table; (2) sort the small (key, length) rows by range
and turn lengths into offsets with one running sum per partition and the partitions' totals;
(3) join offsets back to the tokens by row number and cut. Equal documents have equal keys: the
low bits of the key come from the row number, so a group of copies spreads over ranges.

Ids are those of the `tokenizers` library. Plain texts (common characters, no special token's name, no
very long run with or without blanks) go through the same vocabulary's ranks in `tiktoken`, which
gives the same ids at four times the speed; of other texts the uncommon chunks, or where runs are
very long the whole text, go through `tokenizers` itself. A chunk starts at a blank that a non-blank
follows, which is always the start of a pre-token.

Defined results: null is the empty text, which has the one id 0; rows with equal or null ids
are rows of their own; an empty table packs into no piece.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import staged

LENGTH = 1024
HASHED = 256
DIMS = 4
CELL_BITS = 12
TIE_BITS = 63 - DIMS * CELL_BITS
LONG_RUN = 2000
SEED = 64
#: Basic Latin to Latin Extended-A and common punctuation: classes on which all libraries agree.
_CHARS = "\t\n\r\\x20-\\x7e\\xa1-\\xac\\xae-\u017f\u2010-\u2027\u20ac"
_COMMON = re.compile(f"[{_CHARS}]*")
#: Runs that a backtracking pattern or a merge loop should not meet.
_RUNS = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")


def has_long_run(text: str) -> bool:
    """Whether a run of LONG_RUN characters has no blank or nothing but blanks. Such a run covers an
    aligned window of half that length, so only texts with an odd window are searched."""
    half = LONG_RUN // 2
    if len(text) < LONG_RUN:
        return False
    odd = any(text.find(" ", k, k + half) < 0 or text[k : k + half].isspace() for k in range(0, len(text), half))
    return odd and _RUNS.search(text) is not None


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others, in order, for
    characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Texts to ids as little-endian 16-bit numbers."""

    def __init__(self, path: str, pattern: str):
        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.special = sorted(special)
        self.ranks = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _exact(self, texts: list[str]) -> list[bytes]:
        if self._whole is None:
            self._whole = tokenizers.Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u2").tobytes() for e in self._whole.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        ids = array("H", self.ranks.encode_ordinary(text))  # half the time of a NumPy array
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or has_long_run(text):
            return self._exact([text])[0]
        if _COMMON.fullmatch(text):
            return self._plain(text)
        return b"".join([self._plain(c) if _COMMON.fullmatch(c) else self._exact([c])[0] for c in chunks_of(text)])


def chunks_of(text: str) -> list[str]:
    """Pieces that start at a blank with a non-blank behind it; together the text."""
    return re.split(r"(?= \S)", text)


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> ByteTokenizer:
    return ByteTokenizer(path, pattern)


@lru_cache(maxsize=1)
def _projection() -> tuple[np.ndarray, np.ndarray]:
    """A column for each id, and the directions."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, HASHED, 1 << 16).astype(np.int64), np.linalg.qr(rng.normal(size=(HASHED, DIMS)))[0]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (rows x dims, below 2**bits): the
    axes are turned and flipped from the highest bit down, Gray-decoded, and interleaved."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_places(ids: list[bytes]) -> np.ndarray:
    columns, directions = _projection()
    counts = np.stack([np.bincount(columns[np.frombuffer(b, "<u2")], minlength=HASHED) for b in ids]).astype(np.float64)
    roots = np.sqrt(counts)
    unit = roots / np.maximum(np.linalg.norm(roots, axis=1, keepdims=True), 1e-12)
    cells = np.clip(((unit @ directions + 1) / 2 * (1 << CELL_BITS)).astype(np.int64), 0, (1 << CELL_BITS) - 1)
    return hilbert(cells, CELL_BITS)


def _tokenized(path: str, pattern: str):
    def run(batches):
        own = _tokenizer(path, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [b + b"\0\0" for b in (own.encode(t or "") for t in part.column("__text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(curve_places(ids)), pa.array(ids, pa.binary())], ["doc_id", "doc_tokens", "place", "ids"])

    return run


def _running(batches):
    """Sorted rows to their offset in the partition, with the partition's number."""
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("doc_tokens").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), batch.column("doc_tokens")], ["row", "part", "local", "doc_tokens"])
        at = int(ends[-1]) if len(ends) else at


def _cut(length: int):
    def run(batches):
        for batch in batches:
            doc, start, size, crc, whole, seq, offset = [], [], [], [], [], [], []
            for d, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "ids", "at")), strict=True):
                numbers, k = np.frombuffer(ids, "<u2").astype("<u4").tobytes(), 0
                while k < n:
                    take = min(n - k, length - (at + k) % length)
                    doc.append(d)
                    start.append(k)
                    size.append(take)
                    crc.append(zlib.crc32(numbers[4 * k : 4 * (k + take)]))
                    whole.append(n)
                    seq.append((at + k) // length)
                    offset.append((at + k) % length)
                    k += take
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("doc_id").type), *(pa.array(x, pa.int64()) for x in (start, size, crc, whole, seq, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, pattern: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    schema = own.select("doc_id", F.lit(0).cast("long").alias("doc_tokens"), F.lit(0).cast("long").alias("place"), F.lit(b"").alias("ids")).schema
    tokens = staged(own.mapInArrow(_tokenized(tokenizer, pattern), schema).withColumn("row", F.monotonically_increasing_id()), "packing-tokens", "zstd")
    # equal documents differ in the low bits, so that ranges can cut through a group of copies
    key = F.shiftleft("place", TIE_BITS).bitwiseOR(F.pmod(F.xxhash64("row"), F.lit(1 << TIE_BITS)))
    sizes = tokens.select("row", "doc_tokens", key.alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = sizes.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row")
    local = staged(ordered.mapInArrow(_running, "row long, part int, local long, doc_tokens long"), "packing-offsets")
    # one row per partition
    totals = local.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = local.join(F.broadcast(base), "part").select("row", (F.col("base") + F.col("local")).alias("at"))
    met = tokens.select("row", "doc_id", "doc_tokens", "ids").join(placed.hint("shuffle_hash"), "row")
    out = own.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))).schema
    return met.select("doc_id", "doc_tokens", "ids", "at").mapInArrow(_cut(length), out)
