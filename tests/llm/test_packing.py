import zlib

import numpy as np
import public_tokenizers as P
import tokenizers

from larder.llm import packing

PATH, PATTERN = P.path("byte_bpe_50k.json"), P.PATTERN


def run(spark, rows, schema="doc_id long, text string, row string, at string"):
    df = spark.createDataFrame(rows, schema).repartition(4)
    return packing.pack(df, PATH, PATTERN)


def check(spark, rows):
    """Each id in one piece, gapless sequences, one padded sequence at most."""
    whole = tokenizers.Tokenizer.from_file(PATH)
    got = run(spark, rows).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    wanted: dict = {}
    for d, text, *_ in rows:
        wanted.setdefault(d, []).append(whole.encode(text or "", add_special_tokens=False).ids + [0])
    assert set(by_doc) == set(wanted)
    for d, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == sum(map(len, wanted[d]))
        if len(wanted[d]) == 1:
            ids = wanted[d][0]
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = []
    for spans in sequences.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        ends.append(at)
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(e != packing.LENGTH for e in ends) <= 1 and max(ends, default=0) <= packing.LENGTH
    return got


def test_cases(spark):
    rows = [(1, "hello world", "x", "y"), (2, None, None, None), (3, "", "", ""), (4, "word " * 30_000, "", ""), (5, "a" * 20_000, "", ""), (None, "no id", "", ""), (6, "<|endoftext|> naïve 漢字 🙂", "", ""), (7, "hello world", "", ""), (7, "hello world", "", "")]
    rows += [(100 + i, "the same text again", "", "") for i in range(400)]
    check(spark, rows)


def test_empty(spark):
    assert run(spark, []).collect() == []


def test_documents(spark):
    rows = [(r.doc_id, r.text, "", "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_hilbert_is_a_curve():
    """All cells of a grid, in order of their key, are neighbours and come once."""
    bits, n = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), axis=-1).reshape(-1, n)
    keys = packing.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_share_sequences(spark):
    """Texts of two vocabularies lie apart on the curve."""
    rows = [(i, " ".join((("alpha beta gamma delta" if i % 2 else "uno dos tres cuatro").split()) * 20), "", "") for i in range(60)]
    order = [r.doc_id % 2 for r in sorted(run(spark, rows).collect(), key=lambda r: (r.sequence_id, r.offset))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == 1
