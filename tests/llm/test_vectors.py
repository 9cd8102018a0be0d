import numpy as np
import pytest

from larder.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row long, v string"


def brute(rows, cosine):
    own = [(i, v, l) for i, (_, v, l, *_) in enumerate(rows) if v and l is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {}
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            (i, x, l), (j, y, m) = own[a], own[b]
            if l == m and len(x) == len(y):
                x, y = np.float32(x).astype(float), np.float32(y).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links.setdefault(i, set()).add(j)
                    links.setdefault(j, set()).add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((r[0], len(links.get(i, ())), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [7, 50, 4096])
def test_equals_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(30, 64))
    rows = []
    for i in range(220):
        v = centres[rng.integers(30)] + rng.normal(size=64) * rng.choice([0.05, 0.2, 0.3])
        rows.append((i, [float(c) for c in v], int(rng.integers(3)) if i % 11 else None, 0, ""))
    rows += [(300, rows[4][1], rows[4][2], 0, ""), (301, None, 1, 0, ""), (302, [0.0] * 64, 1, 0, ""), (303, [float("nan")] * 64, 1, 0, ""), (304, [None] * 64, 1, 0, ""), (305, [], 1, 0, ""), (306, [1.0, 0.0], 1, 0, ""), (307, [1.0, 0.001], 1, 0, ""), (None, rows[5][1], rows[5][2], 0, ""), (5, rows[5][1], rows[5][2], 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in vectors.near_vectors(df, tile=tile).collect()), key=str)
    assert got == brute(rows, vectors.COSINE)


def test_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_the_count_misses_no_link():
    """Pairs at the threshold, the hardest ones, all reach the count."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(400, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = 0.9300001 * x + np.sqrt(1 - 0.9300001**2) * y
    i, j = vectors.colliding_pairs(x, near, 0.93)
    assert set(range(400)) <= {a for a, b in zip(i, j, strict=True) if a == b}


def test_few_pairs_meet_and_hardly_a_link_is_missed(spark):
    """The shape of sf0.1: of all pairs of a label under a tenth meets in a table; of links planted at the threshold all but a few in 10,000 do."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("label is not null and embedding is not null").collect()
    by_label = {}
    for r in rows:
        by_label.setdefault(r.label, []).append(r.embedding)
    largest = max(map(len, by_label.values()))
    bits, tables = vectors.plan(largest, vectors.COSINE)

    def codes(x):
        above = (vectors.unit_rows(x) @ vectors._directions(x.shape[1], bits * tables) >= 0).reshape(len(x), tables, bits)
        return above @ (1 << np.arange(bits))

    met = pairs = 0
    for own in by_label.values():
        c = codes(np.array(own))
        met += sum((c[i] == c[i + 1 :]).any(axis=1).sum() for i in range(len(c) - 1))
        pairs += len(c) * (len(c) - 1) // 2
    assert met / pairs < 0.1, met / pairs
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    together = (codes(x) == codes(0.93 * x + np.sqrt(1 - 0.93**2) * y)).any(axis=1)
    assert together.mean() > 1 - 10 * vectors.MISSED
    for n in (10**5, 10**7, 10**9):  # buckets stay of a size
        assert n / 2 ** vectors.plan(n, 0.93)[0] <= vectors.BUCKET


def test_the_query_on_a_table_with_links(spark, tmp_path):
    """Near copies, exact copies, a crowd of one vector: the query against its SQL."""
    import duckdb

    from larder.llm.queries import ORACLE_SQL, op2_collision_counting

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng, next_id = np.random.default_rng(8), 10**6
    for vec_id, v, label in rows[:200]:
        for noise in rng.choice([0.0, 0.05, 0.25, 0.35, 0.4], 2):
            u, d = np.array(v) / np.linalg.norm(v), rng.normal(size=len(v))
            rows.append((next_id, [float(np.float32(c)) for c in u + noise * d / np.linalg.norm(d)], label))
            next_id += 1
    rows += [(next_id + i, rows[0][1], rows[0][2]) for i in range(300)]
    schema = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").schema
    spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in op2_collision_counting(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["op2_collision_counting"]).fetchall())
    assert sum(r[1] > 0 for r in got) > 500
