import random
import zlib

import numpy as np

from larder.llm import toxicity

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scores = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in scores if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scores)
    assert len(held) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)
    positive, negative = ([r.score for r in held if r.toxic == t] for t in (1, 0))
    auc = np.mean([[p > n for n in negative] for p in positive])
    assert auc > 0.95
    assert sum(r.predicted for r in held if r.toxic == 0) <= 0.01 * len(negative)
    assert sum(r.predicted for r in held if r.toxic == 1) >= 0.7 * len(positive)


def pair_corpus(n, seed):
    """Toxic exactly where an insult meets a group's name: neither tells alone."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"filler{rng.randrange(50)}" for _ in range(12)] + ["insult"] * a + ["groupname"] * b
        rng.shuffle(words)
        rows.append((" ".join(words), int(a and b)))
    return rows


def test_pairwise_terms_learn_what_weights_miss():
    terms = toxicity.Terms()
    rows = pair_corpus(4000, 1)
    m = toxicity.train([terms.of(t) for t, _ in rows], np.array([y for _, y in rows], float))
    test = pair_corpus(800, 2)
    right = np.mean([(m.margin(terms.of(t)) > 0) == bool(y) for t, y in test])
    assert right > 0.97
    i, g = (int(terms.of(w)[0]) for w in ("insult", "groupname"))
    assert float(m.factors[i] @ m.factors[g]) > 0.5


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "a b", "x"), (4, "w " * 50_000, "x"), (4, "again", "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    out = toxicity.toxicity_scores(docs, none).collect()
    assert len(out) == 6 and all(r.score == 0.0 and r.predicted == 0 for r in out)
    labels = spark.createDataFrame([(1, 1, None), (4, 0, 1), (4, None, 1), (None, 1, 1), (7, 1, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity_scores(docs, labels).count() == 6
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6
    assert toxicity.toxicity_scores(docs.where("false"), labels).collect() == []


def test_labels_of_the_held_out_fold_are_not_used(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_pairs_whose_members_tell_nothing_alone():
    """Toxic where both or neither of two words occur: each word alone is as frequent in both classes."""
    rng = random.Random(5)

    def corpus(n):
        rows = []
        for _ in range(n):
            a, b = rng.random() < 0.5, rng.random() < 0.5
            words = [f"filler{rng.randrange(50)}" for _ in range(12)] + ["insult"] * a + ["groupname"] * b
            rows.append((" ".join(words), int(a == b)))
        return rows

    terms, rows = toxicity.Terms(), corpus(4000)
    m = toxicity.train([terms.of(t) for t, _ in rows], np.array([y for _, y in rows], float))
    assert np.mean([(m.margin(terms.of(t)) > 0) == bool(y) for t, y in corpus(800)]) > 0.95


def test_scores_equal_plain_loops(spark):
    """The score of every row from the fitted numbers, pair by pair."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    m, terms = toxicity.fit(docs, labels), toxicity.Terms()
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = [d for d, t in texts.items() if len(t) < 1500][:150]
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    for d in short:
        own = [int(t) for t in terms.of(texts[d]) if m.weights[t] != 0]
        z = m.bias + sum(float(m.weights[t]) for t in own)
        for i, a in enumerate(own):
            z += sum(float(np.dot(m.factors[a].astype(float), m.factors[b].astype(float))) for b in own[i + 1 :])
        assert abs(got[d] - 1 / (1 + np.exp(-z))) < 1e-4


def test_the_sample_is_bounded_in_rows_and_terms(spark, monkeypatch):
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, toxic: seen.append(rows))
    docs = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, " ".join(f"w{i}" for i in range(40_000)))], "doc_id long, text string"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.fit(docs, labels, sample=100_000)
    assert len(seen[0]) <= 1002 and max(map(len, seen[0])) <= toxicity.MOST_TERMS
    toxicity.fit(docs, labels, sample=50)
    assert len(seen[1]) <= 50


def test_long_rows_keep_the_terms_that_many_rows_have(spark, monkeypatch):
    import hashlib

    import xxhash

    seen = []
    monkeypatch.setattr(toxicity, "train", lambda rows, toxic: seen.append(list(rows)))
    words = lambda k: " ".join(hashlib.md5(f"{k} {i}".encode()).hexdigest()[:9] for i in range(20_000))
    ids = [i for i in range(1, 9) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"{words(i)} zygote{i} never{i}x") for i in ids] + [(i, "") for i in range(100, 110)], "doc_id long, text string")
    toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in [*ids, *range(100, 110)]], "doc_id long, toxic int"))
    starts = {toxicity.HALF + (xxhash.xxh32_intdigest(w) >> (33 - toxicity.BITS)) for w in (b"zygo", b"zygot", b"zygote", b"neve", b"never")}
    long = [set(r.tolist()) for r in seen[0] if len(r)]
    assert len(long) == len(ids) and all(starts <= r for r in long)
    assert max(map(len, long)) <= toxicity.MOST_TERMS and all((r[1:] > r[:-1]).all() for r in seen[0])
    assert len(seen[0]) == len(ids) + sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(100, 110))


def test_columns_of_our_names_stay(spark):
    df = spark.createDataFrame([(1, "a b", "o", "s", "x.y", "t")], "doc_id long, text string, own string, score string, `a.b` string, __text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    out = toxicity.drop_toxic(df, labels)
    assert out.columns == df.columns and out.collect() == df.collect()
