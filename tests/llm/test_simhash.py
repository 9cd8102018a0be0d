import random

import numpy as np
import xxhash

from larder.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string"


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def want(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=str)


def got(df):
    return sorted(map(tuple, simhash.simhash_components(df).collect()), key=str)


def near_copies(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, i = [], 0
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(600)]
        for _ in range(rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(600)] = rng.choice(vocabulary)
            rows.append((i, " ".join(own), ""))
            i += 1
    return rows


def test_equals_brute_force(spark):
    rows = near_copies() + [(900, None, ""), (901, "", ""), (902, " \t\n", ""), (903, "One", ""), (904, "one", ""), (905, "ÀB ç", ""), (None, "one", ""), (None, "alone here", ""), (906, "a b c d e f g " * 3000, ""), (3, "repeated id", ""), (3, "repeated id", ""), (907, "nbsp stays one word x", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    result = got(df)
    assert result == want(rows)
    assert len({c for _, _, c in result}) < len(rows) - 20  # there are links to find


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert simhash.drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_pair_within_the_distance_is_found(spark):
    """Fingerprints around common ones: thresholds differ by row, pairs do not go missing."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = set(base.tolist())
    for b in base:
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(int(np.bitwise_xor.reduce([np.int64(b), *[np.int64(np.uint64(1) << np.uint64(f)) for f in flips]])))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "__fp long")
    found = {(r.a, r.b) for r in simhash.links(df).collect()}
    exact = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert found == exact and len(exact) > 500


def test_allocation_is_the_best_one():
    from itertools import product

    rng = np.random.default_rng(3)
    costs = np.cumsum(rng.random((4, 30, 4)), axis=2)
    costs[:, :, 0] = 0
    chosen = simhash.allocate(costs, 1)
    for r in range(30):
        own = sum(costs[i, r, e + 1] for i, e in enumerate(chosen[r]))
        best = min(sum(costs[i, r, e + 1] for i, e in enumerate(c)) for c in product(range(-1, 3), repeat=4) if sum(c) == 1)
        assert chosen[r].sum() == 1 and abs(own - best) < 1e-9


def test_kept_rows(spark):
    rows = near_copies(4) + [(None, "w1 w2", ""), (5000, "w1 w2", ""), (5001, "w9 w8", "x"), (5001, "w9 w8", "x"), (None, None, ""), (None, None, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {c for _, f, c in want(rows) if c is not None}
    assert sorted(i for i in ids if i is not None) == sorted(groups) and ids.count(None) == 1


def test_larger_distances(spark):
    """Every pair up to the largest distance that the thresholds reach; an error beyond."""
    import pytest

    rng = np.random.default_rng(4)
    fps = set()
    for b in rng.integers(0, 2**63, 20, dtype=np.int64):
        for _ in range(10):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            fps.add(int(np.bitwise_xor.reduce([np.int64(b), *[np.int64(np.uint64(1) << np.uint64(f)) for f in flips]])))
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "__fp long")
    exact = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= simhash.MOST_BITS}
    assert {(r.a, r.b) for r in simhash.links(df, simhash.MOST_BITS).collect()} == exact and exact
    with pytest.raises(ValueError):
        simhash.links(df, simhash.MOST_BITS + 1)
