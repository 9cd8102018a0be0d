"""Substring search by pieces against holding everything against everything."""

from __future__ import annotations

import random

from larder.operators import substrings


def test_equal_to_plain_search(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abÄß %_.é") for _ in range(n))
    texts = [("hot" if i % 3 else f"u{i % 5}", word(rng.randint(0, 9))) for i in range(600)] + [(None, "abc"), ("hot", None), ("hot", "İstanbul")]
    asked = [("hot" if i % 2 else f"u{i % 7}", word(rng.randint(0, 4))) for i in range(300)] + [(None, "a"), ("hot", None), ("hot", "i"), ("hot", "STAN"), ("hot", "zzz")]
    t = spark.createDataFrame(texts, "user_id string, tag string").repartition(4)
    q = spark.createDataFrame(asked, "user_id string, q string")
    got = sorted(map(tuple, substrings.holding(q, substrings.postings(t, "user_id", "tag"), "user_id", "tag", "q").collect()))
    want = sorted({(u, a, b) for u, a in asked if u and a for v, b in texts if v == u and b and a.lower() in b.lower()})
    assert got == want and len(want) > 500 and ("hot", "STAN", "İstanbul") in want


def test_a_query_meets_only_what_shares_its_rarest_piece(spark):
    """A common ending costs nothing: 2,000 tags end in 'ing', the query's own piece is in one."""
    texts = spark.range(2_000).selectExpr("'u' AS user_id", "id || 'ing' AS tag").union(spark.createDataFrame([("u", "xyzing")], "user_id string, tag string"))
    posted = substrings.postings(texts, "user_id", "tag")
    asked = spark.createDataFrame([("u", "yzing")], "user_id string, q string")
    assert [r.tag for r in substrings.holding(asked, posted, "user_id", "tag", "q").collect()] == ["xyzing"]
    assert posted.where("gram = 'yzi'").count() == 1 and posted.where("gram = 'ing'").count() == 2_001


def test_pieces_of_a_long_query_are_taken_once(spark):
    """Beside each of a query's pieces no step takes all of them anew, which made 1,600 texts of some 230 characters last two minutes."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    asked = [("u", text(400)) for _ in range(40)]
    tags = [("u", q[7:390]) for _, q in asked] + [("u", q) for _, q in asked[:20]] + [("u", asked[0][1].upper() + "!")]
    q, t = spark.createDataFrame(asked, "user_id string, q string"), spark.createDataFrame(tags, "user_id string, tag string")
    found = substrings.holding(q, substrings.postings(t, "user_id", "tag"), "user_id", "tag", "q")
    steps = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "array_distinct" in line]
    assert steps and all("Generate explode" in line for line in steps)
    assert sorted(map(tuple, found.collect())) == sorted([("u", q, q) for _, q in asked[:20]] + [("u", asked[0][1], asked[0][1].upper() + "!")])
