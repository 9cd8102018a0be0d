"""Hard negatives against sorting every anchor's scores."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from larder.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int"


def slow(rows: dict, anchors: set) -> list:
    """rows: id to (label, whole numbers)."""
    out = []
    for a in sorted(anchors & rows.keys()):
        label, v = rows[a]
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), i, k == label) for i, (k, w) in rows.items() if i != a))
        positives = [(i, -s) for s, i, same in scored if same][:5]
        for p, top in positives:
            inside = [(i, -s) for s, i, same in scored if not same and 80 * top <= -100 * s <= 100 * top][:5]
            out += [(a, p, k, i, top, s) for k, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def whole(v) -> list:
    return [math.floor(256 * x) for x in v]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1) for i, k, v in rows], SCHEMA)


def mined(df, anchors=None):
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(df, anchors).collect())


def test_equal_to_brute_force_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 40)
    rng = random.Random(2)
    # few values: many ties; one label holds half of the rows, one is alone
    rows = [(i, 0 if i % 2 else (i % 5 if i != 4 else 99), [float(rng.choice([-0.5, 0, 0.25, 0.5, 1])) for _ in range(6)]) for i in range(300)]
    want = slow({i: (k, whole(v)) for i, k, v in rows}, {i for i in range(300) if i % 10 == 0})
    assert mined(frame(spark, rows), F.col("id") % 10 == 0) == want and len(want) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, 1, [1.0, 0.0]), (2, 1, [1.0]), (3, 2, [0.9, 0.5]), (4, 2, [0.9]), (5, 3, []), (6, 1, [-1.0, 0.0]), (7, 2, [1.0, 0.0, 3.0]), (8, 3, [0.0, 0.0])]
    bad = [(9, None, [1.0]), (10, 1, None), (11, 1, [nan]), (12, 2, [inf]), (13, 2, [1.0, None]), (None, 1, [1.0])]
    df = frame(spark, good + bad + good[:2])
    want = slow({i: (k, whole(v) + [0] * (3 - len(v))) for i, k, v in good}, set(range(1, 9)))
    assert mined(df) == want and any(r[4] == 0 for r in want)
    assert mined(frame(spark, []), F.col("id") % 10 == 0) == []
    assert mined(df.where("label = 3")) == [] == mined(df, F.lit(False))


def test_of_one_id_the_least_row_counts(spark):
    rows = [(1, 1, [1.0]), (2, 1, [1.0]), (3, 2, [1.0]), (2, 1, [0.5]), (2, 3, [0.9])]
    assert mined(frame(spark, rows), F.col("id") == 1) == []  # 2 counts with 0.5: 3 scores above the window
    assert mined(frame(spark, [*rows, (4, 5, [0.5])]), F.col("id") == 1) == [(1, 2, 1, 4, 32768, 32768)]


def test_large_numbers_are_exact(spark):
    big = float(2**22)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 1.0]), (2, 2, [big, 0.99609375]), (3, 2, [big, -1.0])]
    got = mined(frame(spark, rows), F.col("id") == 0)
    assert got == slow({i: (k, whole(v)) for i, k, v in rows}, {0}) and len(got) == 2


def test_one_very_common_vector(spark):
    rows = [(i, 0 if i < 200 else 1, [0.5, 0.5]) for i in range(400)]
    want = slow({i: (k, whole(v)) for i, k, v in rows}, set(range(0, 400, 100)))
    assert mined(frame(spark, rows), F.col("id") % 100 == 0) == want
