"""Periodic runs against comparing every word with every one behind it."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from larder.llm import queries, runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(w: list) -> list:
    out: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - b >= max(6, 4 * q):
                out.setdefault((b, i + q), q)
    return sorted(((b, e - b, q) for (b, e), q in out.items()), key=lambda r: (r[0], r[2]))


def nested(rng: random.Random) -> str:
    w = [str(rng.randrange(rng.choice([1, 2, 3, 50]))) for _ in range(rng.randint(0, 200))]
    for _ in range(rng.randint(0, 3)):
        if w:
            p, s = rng.randint(1, max(1, len(w) // 3)), rng.randrange(len(w))
            w = (w[:s] + w[s : s + p] * rng.randint(2, 7) + w[s:])[:500]
    return " ".join(w)


def test_equal_to_brute_force_in_any_company():
    rng = random.Random(5)
    for _ in range(400):
        texts = [nested(rng) for _ in range(rng.randint(1, 6))]
        found, kept = runs._of_texts([t.encode() for t in texts])
        for t, own, c in zip(texts, found, kept):
            want = slow(t.split())
            assert [(r["start"], r["length"], r["period"]) for r in own] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert c == " ".join(w for i, w in enumerate(t.split()) if i not in gone)


@pytest.mark.parametrize("p", [1, 7, 8, 9, 15, 16, 17, 31, 64, 100, 255, 1000])
def test_every_period_at_every_edge(p):
    """Exactly four periods count, a word less does not; the run at the start, inside and at the end of a text."""
    base = [f"b{i}" for i in range(p)]
    for before, behind in ((0, 0), (3, 0), (0, 3), (40, 40)):
        for short in (0, 1):
            w = [f"x{i}" for i in range(before)] + (base * 7)[: max(6, 4 * p) - short] + [f"y{i}" for i in range(behind)]
            found, _ = runs._of_texts([" ".join(w).encode()])
            assert [tuple(r.values()) for r in found[0]] == ([] if short else [(before, max(6, 4 * p), p)])


def test_periodic_regions_do_not_fill_the_sets():
    """A period of long blocks that are themselves periodic: both are found."""
    block = ["a"] * 40 + ["b"] + ["c", "d"] * 30
    w = block * 6
    found, _ = runs._of_texts([" ".join(w).encode()])
    got = {tuple(r.values()) for r in found[0]}
    assert (0, len(w), len(block)) in got and (0, 40, 1) in got and (41, 60, 2) in got
    assert sorted(got) == sorted(slow(w))


def test_columns_nulls_empty_and_odd_texts(spark):
    rows = [(1, None, "k", 7), (2, "", "k", 7), (3, " \t\n", "z", 7), (4, "é é é é é é é", "k", 7), (5, "a\u00a0b a\u00a0b " * 4, "k", 7), (6, "x " * 5, "k", 7)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, runs string, `a.b` int")
    got = runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "a.b", "runs_", "collapsed"]
    out = {(r.doc_id, r.text, r["runs"], r["a.b"]): ([tuple(x) for x in r.runs_], r.collapsed) for r in got.collect()}
    assert len(out) == 6 and got.count() == 12
    assert [out[r] for r in rows] == [([], ""), ([], ""), ([], ""), ([(0, 7, 1)], "é"), ([(0, 8, 1)], "a\u00a0b"), ([], "x x x x x")]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 9973}" for i in range(60_000)) + " " + "z " * 100_000
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(0, 60_000, 9973), (60_000, 100_000, 1)]
    assert len(row.collapsed.split()) == 9974


def wanted(doc_id, text) -> tuple:
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow(w)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [nested(rng) for _ in range(150)] + [None, "", "  ", "one", "a\u2003a a\u2003a a\u2003a a\u2003a a\u2003a a\u2003a", "t\x1ct " * 6, "q\x00 " * 7]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a a a a a a a b", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {wanted(i, t) for i, t, *_ in rows}
    assert sum(r[1] > 0 for r in got) > 50
