"""E1-E12, K1, K2 over documents, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import embed, frames
from larder.plans.base import Plans, view

plan = Plans()
DIM = 256


@plan(f"""WITH t AS (SELECT doc_id, lower(' ' || text || ' ') AS t FROM documents),
    g AS (SELECT doc_id, substr(t, CAST(i AS BIGINT), n) AS g FROM (SELECT doc_id, t, n, unnest(range(1, length(t) - n + 2)) AS i FROM t, (VALUES (3), (4), (5)) v(n))),
    b AS (SELECT doc_id, CAST(('0x' || md5(g))::UHUGEINT % {DIM} AS BIGINT) AS b, count(*) AS n FROM g GROUP BY ALL),
    s AS (SELECT doc_id, count(*) AS n_buckets, min(b) FILTER (WHERE n = m) AS top_bucket, round(max(n) / sqrt(sum(n * n)), 5) AS top_weight FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM b) GROUP BY doc_id)
    SELECT doc_id, CAST(n_buckets AS INTEGER) AS n_buckets, top_bucket, top_weight FROM s""")
def e1_hash_embed(spark, sf_dir):
    e = embed.hash_embed(view(spark, sf_dir, "documents"), "doc_id", "text", DIM)
    top = F.array_max("embedding")
    return e.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_buckets"), (F.array_position("embedding", top) - 1).alias("top_bucket"), F.round(top.cast("double"), 5).alias("top_weight"))


@plan("SELECT doc_id, length(text) AS n, length(text) - length(replace(text, 'a', '')) AS n_a FROM documents")
def e2_apply_provider(spark, sf_dir):
    """A provider that measures texts stands in for a model."""
    d = view(spark, sf_dir, "documents").select("doc_id", "text")
    measured = embed.apply_provider(d, lambda: lambda f: [[len(t), t.count("a")] for t in f["text"]], ["text"], "m", "array<bigint>", 2)
    return measured.select("doc_id", F.col("m")[0].alias("n"), F.col("m")[1].alias("n_a"))


@plan("SELECT count(*) AS n, count(*) FILTER (WHERE embedding IS NULL) AS n_null, count(*) FILTER (WHERE len(embedding) <> 64) AS n_wrong_dim FROM embeddings")
def e3_check_vectors(spark, sf_dir):
    return embed.check_vectors(view(spark, sf_dir, "embeddings"), "embedding", 64)


@plan("""SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / n, 6)) AS unit FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def e4_l2_normalize(spark, sf_dir):
    u = embed.l2_normalize(view(spark, sf_dir, "embeddings"), "embedding", "unit")
    # rounded as SQL rounds: what is less than zero stays so by its sign
    return u.select("vec_id", F.transform("unit", lambda x: F.abs(F.round(x, 6)) * F.signum(x)).alias("unit"))


_MEDIA = "SELECT event_id AS media_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE cast(event_id % 700 AS double) / 4 END AS duration_s FROM events"
_UNIFORM = f"SELECT media_id, CAST(i AS INTEGER) AS i, CASE WHEN duration_s > 0 THEN CAST(trunc(i * duration_s / 12 * 1000) AS INTEGER) ELSE 0 END AS timestamp_ms FROM (SELECT *, unnest(range(12)) AS i FROM ({_MEDIA}))"
_CUTS = "SELECT cast(floor(event_id / 20) AS bigint) AS media_id, cast(event_id % 20 * 977 + event_id % 7 * 50 AS int) AS timestamp_ms FROM events"
_KEPT = f"SELECT c.* FROM ({_CUTS}) c WHERE NOT EXISTS (SELECT 1 FROM ({_UNIFORM}) u WHERE u.media_id = c.media_id AND abs(c.timestamp_ms - u.timestamp_ms) <= 150)"


def _media(spark, sf_dir, text):
    view(spark, sf_dir, "captures_v")
    return spark.sql(text)


@plan(_UNIFORM)
def e5_uniform_timestamps(spark, sf_dir):
    return frames.uniform_timestamps(_media(spark, sf_dir, _MEDIA), 12)


def _sub(rows: str, key: str, order: str, cap: int) -> str:
    return f"SELECT * EXCLUDE (place, n) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS place, count(*) OVER (PARTITION BY {key}) AS n FROM ({rows})) WHERE n <= {cap} OR list_contains(list_transform(range({cap}), lambda i: CAST(floor(i * n / CAST({cap} AS DOUBLE)) AS BIGINT)), place)"


@plan(_sub("SELECT user_id, event_id FROM events", "user_id", "event_id", 24))
def e6_even_subsample(spark, sf_dir):
    return frames.even_subsample(view(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 24)


@plan("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 10 OR list_contains(list_transform(range(10), lambda i: CAST(round_even(i * (n - 1) / CAST(9 AS DOUBLE), 0) AS BIGINT)), place)")
def e6_rounded_subsample(spark, sf_dir):
    return frames.even_subsample(view(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"], 10, rounded=True)


@plan(_KEPT)
def e7_dedupe_cuts(spark, sf_dir):
    return frames.dedupe_cuts(_media(spark, sf_dir, _CUTS), frames.uniform_timestamps(_media(spark, sf_dir, _MEDIA), 12))


_PHOTOS = "SELECT -vec_id - 1 AS media_id FROM embeddings"
_SELECTED = f"SELECT media_id, timestamp_ms, 'uniform' AS selection FROM ({_UNIFORM}) UNION ALL SELECT media_id, timestamp_ms, 'scene' FROM ({_sub(_KEPT, 'media_id', 'timestamp_ms', 12)}) UNION ALL SELECT media_id, 0, 'photo' FROM ({_PHOTOS})"


def _selected(spark, sf_dir):
    photos = view(spark, sf_dir, "embeddings").select((-F.col("vec_id") - 1).alias("media_id"))
    return frames.select_frames(frames.uniform_timestamps(_media(spark, sf_dir, _MEDIA), 12), _media(spark, sf_dir, _CUTS), photos)


@plan(_SELECTED)
def e8_select_frames(spark, sf_dir):
    return _selected(spark, sf_dir)


@plan(f"SELECT *, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY coalesce(album_index, -1), timestamp_ms, selection, media_id) - 1 AS INTEGER) AS frame_index FROM (SELECT *, media_id // 3 AS memory_id, CASE WHEN media_id % 2 = 0 THEN CAST(media_id % 3 AS INTEGER) END AS album_index FROM ({_SELECTED}) WHERE media_id >= 0)")
def e9_assign_frame_index(spark, sf_dir):
    f = _selected(spark, sf_dir).where("media_id >= 0").withColumns({"memory_id": F.expr("media_id div 3"), "album_index": F.expr("CASE WHEN media_id % 2 = 0 THEN cast(media_id % 3 AS int) END")})
    return frames.assign_frame_index(f)


_PROBES = "SELECT event_id, value * 10 AS duration_s, event_id % 5 <> 0 AS has_video, event_id % 3 <> 0 AS has_audio FROM events"


@plan(f"SELECT event_id, CASE WHEN NOT has_video THEN 'no_video' WHEN duration_s > 600 THEN 'too_long' WHEN NOT has_audio THEN 'ok_no_transcript' ELSE 'ok' END AS decision FROM ({_PROBES})")
def e10_media_policy(spark, sf_dir):
    return frames.media_policy(_media(spark, sf_dir, _PROBES)).select("event_id", "decision")


_OWNED = "SELECT memory_id, CASE memory_id % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'web' ELSE 'youtube' END AS platform, 'f' || cast(memory_id AS string) AS platform_item_id FROM memories_v"
_STORED = "SELECT CASE WHEN doc_id % 4 = 0 THEN '.f' WHEN doc_id % 4 = 1 THEN 'f' ELSE 'x' END || cast(doc_id AS string) || '.mp4' AS name FROM documents"


@plan(f"""WITH i AS ({_OWNED}), n AS (SELECT memory_id, count(*) AS n FROM frames_v GROUP BY memory_id), s AS (SELECT DISTINCT regexp_extract(name, '^([^.]+)[.]', 1) AS id FROM ({_STORED}) WHERE name NOT LIKE '.%')
    SELECT i.memory_id, CASE WHEN n > 0 THEN 'READY' WHEN platform = 'upload' AND s.id IS NOT NULL THEN 'BACKFILL_AVAILABLE' ELSE 'SOURCE_UNAVAILABLE' END AS state, coalesce(n, 0) AS n_frames FROM i LEFT JOIN n USING (memory_id) LEFT JOIN s ON s.id = i.platform_item_id""")
def e11_visual_coverage(spark, sf_dir):
    view(spark, sf_dir, "memories_v").createOrReplaceTempView("memories_v")
    return frames.visual_coverage(spark.sql(_OWNED), view(spark, sf_dir, "frames_v"), spark.sql(_STORED))


# the stated query set: every vector whose id is divisible by 20, against all
_DISTANCE = "SELECT q.vec_id AS query_id, e.vec_id AS {key}, round(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0"


def vector_queries(spark, sf_dir):
    return view(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@plan(f"SELECT query_id, segment_id, distance, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, segment_id) AS r FROM ({_DISTANCE.format(key='segment_id')})) WHERE r <= 10")
def k1_knn(spark, sf_dir):
    corpus = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), "embedding")
    return embed.knn(vector_queries(spark, sf_dir), corpus, 10)


@plan()
def k2_ann(spark, sf_dir):
    corpus = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), "embedding")
    return embed.ann(vector_queries(spark, sf_dir), corpus, 10)


@plan(f"SELECT count(*) AS neighbours, true AS recall_reached, true AS fifth_compared FROM (SELECT row_number() OVER (PARTITION BY query_id ORDER BY distance, segment_id) AS r FROM ({_DISTANCE.format(key='segment_id')})) WHERE r <= 10")
def k2_recall(spark, sf_dir):
    """Of the exact neighbours of all queries, whether K2 finds nine in ten, and whether it compares a fifth of the rows or
    fewer with each query. The settings come from other vectors than the queries."""
    corpus = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), "embedding")
    queries, exact = vector_queries(spark, sf_dir), k1_knn(spark, sf_dir)
    index = embed.build_vector_index(corpus)
    probes, rerank = embed.calibrated(index, queries, 10, 0.95, 500)
    found = embed.search_index(index, queries, 10, probes, rerank).select("query_id", "segment_id", F.lit(True).alias("hit"))
    met = exact.join(found, ["query_id", "segment_id"], "left")
    counted = met.agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))
    return counted.withColumn("fifth_compared", F.lit(rerank <= 0.2 * corpus.count()))


@plan(f"""WITH near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, frame_id) AS r FROM ({_DISTANCE.format(key='frame_id')})),
    best AS (SELECT query_id, frame_id // 5 AS memory_id, round(max(1 - distance), 6) AS similarity FROM near WHERE r <= 50 GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS INTEGER) AS rank FROM best""")
def e12_max_sim_rank(spark, sf_dir):
    return embed.max_sim_rank(vector_queries(spark, sf_dir), view(spark, sf_dir, "frames_v"), 50)
