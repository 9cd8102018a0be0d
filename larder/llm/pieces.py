"""SentencePiece encoding and decoding through a table of distinct chunks.

In the vocabulary no piece holds a whitespace marker after another character, so no merge
crosses the place before a marker that follows other text: a text falls into marked chunks
(markers, then the word) that are segmented on their own. Each task keeps a table from chunk
to ids and decoded text; a chunk is segmented when it first comes, and the ids of a text are
its chunks' rows joined by position. The table is dropped when it reaches `TABLE_ROWS` or
`TABLE_CHARS`, which bounds its memory and changes no result; chunks over `LONG` characters
are never kept.

`check_model` proves the premise from the model's pieces. A model whose pieces do cross
markers is refused.

Defined results: null is the empty text, which has no ids and decodes to the empty text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_ROWS = 400_000
TABLE_CHARS = 8_000_000
LONG = 200


def check_model(model: sentencepiece.SentencePieceProcessor) -> None:
    crossing = [p for p in map(model.id_to_piece, range(model.vocab_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross whitespace markers: {crossing[:5]}")
    # one marker goes in front, and blanks stay as they are
    if model.encode(" a  b\t", out_type=str) and "".join(model.encode(" a  b\t", out_type=str)) != f"{MARK}{MARK}a{MARK}{MARK}b\t".replace("\t", "<0x09>"):
        raise ValueError("the model normalizes blanks")


class ChunkTable:
    """Chunks to (ids as text, number of ids, decoded text)."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        lone = self.model.piece_to_id(MARK)  # the chunk of a last marker with nothing behind it
        self.start = {"": (str(lone), 1, "")}
        self.rows, self.chars = dict(self.start), 0

    def _segment(self, chunks: list[str]) -> dict[str, tuple[str, int, str]]:
        """chunks: each as the library takes it, that is without its first marker."""
        ids = self.model.encode(chunks, num_threads=1)
        texts = self.model.decode(ids, num_threads=1) if ids else []
        return {c: (",".join(map(str, i)), len(i), c if t == c else t) for c, i, t in zip(chunks, ids, texts, strict=True)}

    def lookup(self, texts: list[list[str]]) -> dict[str, tuple[str, int, str]]:
        """A table that has every chunk of texts."""
        if len(self.rows) > TABLE_ROWS or self.chars > TABLE_CHARS:
            self.rows, self.chars = dict(self.start), 0
        new = {c for chunks in texts for c in set(chunks).difference(self.rows)}
        made = self._segment(sorted(new))
        kept = {c: row for c, row in made.items() if len(c) <= LONG}
        self.rows.update(kept)
        self.chars += sum(map(len, kept))
        return self.rows if len(kept) == len(made) else _Two(made, self.rows)

    def encode(self, texts: list[str]) -> list[list[tuple[str, int, str]]]:
        """Of each text the rows of its chunks, in order."""
        split = [chunks_of(t) for t in texts]
        at = self.lookup(split).__getitem__
        return [[at(c) for c in chunks] for chunks in split]


class _Two(dict):
    """first, and what it lacks from second."""

    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key):
        return self.second[key]


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker, further markers as blanks."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    out, lead = [], 0  # an empty part is a marker that the next chunk begins with
    for part in parts[:-1]:
        if part:
            out.append(" " * lead + part)
            lead = 0
        else:
            lead += 1
    return [*out, " " * lead + parts[-1]]


@lru_cache(maxsize=2)
def _table(path: str) -> ChunkTable:
    return ChunkTable(path)


def _digests(path: str):
    def run(batches):
        table = _table(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            counts, ids, decoded = [], [], []
            for k in range(0, len(texts), 256):
                for rows in table.encode(texts[k : k + 256]):
                    counts.append(sum([r[1] for r in rows]))
                    ids.append(hashlib.sha256(",".join([r[0] for r in rows]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join([r[2] for r in rows]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str):
    def run(batches):
        table = _table(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            rows = [r for k in range(0, len(texts), 256) for r in table.encode(texts[k : k + 256])]
            ids = pa.array([[int(i) for c in r for i in c[0].split(",")] for r in rows], pa.list_(pa.int32()))
            decoded = pa.array([" ".join([c[2] for c in r]) for r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    return run


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of each row; `model` is the file's path on
    every executor."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return own.mapInArrow(_encoded(model), own.drop("__text").withColumns({"ids": F.array().cast("array<int>"), "decoded": F.lit("")}).schema)


def piece_digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As encode_pieces, with the count and digests in place of ids and text."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    return own.mapInArrow(_digests(model), own.drop("__text").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema)
