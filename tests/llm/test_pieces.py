import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece

from larder.llm import pieces

PATH = P.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = [" ", "  ", "▁", "a", "hello", "\n", "\t", "é", "漢", "🙂", "<s>", "</s>", "<unk>", "<0x0A>", "\r", ";\r", "\x00", " ", "　", "...", "ﬁ", "​", "﻿", "�"]


def test_equals_the_library():
    rng, table = random.Random(5), pieces.ChunkTable(PATH)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", "x" * 3000 + " y", " " * 500, "a  b " * 2000]
    for text, rows in zip(texts, table.encode(texts), strict=True):
        ids = [int(i) for r in rows for i in r[0].split(",")]
        assert ids == MODEL.encode(text)
        assert " ".join(r[2] for r in rows) == MODEL.decode(ids)


def test_a_full_table_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_ROWS", 3)
    table = pieces.ChunkTable(PATH)
    for text in ("one two three four five", "six seven one two", "one " + "z" * 400):
        ids = [int(i) for r in table.encode([text])[0] for i in r[0].split(",")]
        assert ids == MODEL.encode(text)


def test_digests(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, None), (-1, ""), (-2, "word " * 40_000), (-3, "x"), (-3, "x")], "doc_id long, text string")
    df = docs.unionByName(more)
    want = sorted(((d, len(i := MODEL.encode(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(MODEL.decode(i).encode()).hexdigest()) for d, t in map(tuple, df.collect())), key=str)
    got = sorted(map(tuple, pieces.piece_digests(df, PATH).collect()), key=str)
    assert got == want
    row = pieces.encode_pieces(df.where("doc_id = -3"), PATH).first()
    assert row.ids == MODEL.encode("x") and row.decoded == "x"
    assert pieces.piece_digests(df.where("false"), PATH).collect() == []


def test_refuses_models_that_cross_markers():
    class Crossing:
        def vocab_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    with pytest.raises(ValueError, match="cross"):
        pieces.check_model(Crossing())
