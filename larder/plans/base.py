"""A registry of queries and the views that bind operators to the driver tables.

View texts are plain SQL that both engines read alike; they hold no backslashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.session import spread

#: name: (tables it reads, text)
VIEWS = {
    "captures_v": (["events"], "SELECT event_id AS capture_id, user_id, ts AS captured_at, CASE event_id % 3 WHEN 0 THEN 'instagram' WHEN 1 THEN 'youtube' ELSE 'web' END AS platform, regexp_extract(props, '[0-9]+', 0) AS platform_item_id, event_type AS capture_source FROM events"),
    "usage_v": (["events"], "SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'capture' WHEN 'click' THEN 'ask' WHEN 'purchase' THEN 'ask_verify' END AS action FROM events WHERE event_type IN ('view', 'click', 'purchase')"),
    "attempts_v": (["events"], "SELECT event_id, ts, user_id % 7 AS ip, user_id AS account, event_type = 'signup' AS success FROM events WHERE event_type IN ('error', 'signup')"),
    "status_log_v": (["events"], "SELECT event_id, user_id AS memory_id, ts, CASE cast(regexp_extract(props, '[0-9]+', 0) AS int) % 16 WHEN 0 THEN 'CAPTURED' WHEN 1 THEN 'QUEUED' WHEN 2 THEN 'RESOLVING_SOURCE' WHEN 3 THEN 'MEDIA_READY' WHEN 4 THEN 'TRANSCRIBING' WHEN 5 THEN 'ANALYZING_VISUALS' WHEN 6 THEN 'RUNNING_OCR' WHEN 7 THEN 'GENERATING_MEMORY' WHEN 8 THEN 'INDEXING' WHEN 9 THEN 'READY' WHEN 10 THEN 'METADATA_ONLY' WHEN 11 THEN 'SOURCE_UNAVAILABLE' WHEN 12 THEN 'SOURCE_REQUIRES_ACCESS' WHEN 13 THEN 'FAILED_RETRYABLE' WHEN 14 THEN 'FAILED_PERMANENT' ELSE 'DELETED' END AS status FROM events"),
    "jobs_v": (["events"], "SELECT event_id AS job_id, user_id AS memory_id, ts AS started_at, CASE cast(regexp_extract(props, '[0-9]+', 0) AS int) % 4 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE' ELSE 'FAILED' END AS status, event_type AS stage, cast(event_id % 4 AS int) AS attempt_count, CASE event_id % 6 WHEN 0 THEN 'SOURCE_RATE_LIMITED' WHEN 1 THEN 'SOURCE_DELETED' WHEN 2 THEN 'VISION_FAILED' WHEN 3 THEN 'INVALID_URL' WHEN 4 THEN 'DATABASE_FAILED' ELSE 'MEDIA_DECODE_FAILED' END AS failure_code FROM events"),
    "memories_v": (["documents"], "SELECT doc_id AS memory_id, source AS user_id, CASE doc_id % 6 WHEN 0 THEN 'READY' WHEN 1 THEN 'METADATA_ONLY' WHEN 2 THEN 'READY' WHEN 3 THEN 'FAILED_PERMANENT' WHEN 4 THEN 'QUEUED' ELSE 'READY' END AS status, CASE doc_id % 4 WHEN 0 THEN 'video' WHEN 1 THEN 'image' WHEN 2 THEN 'album' ELSE 'article' END AS media_kind, substring(text, 1, 60) AS title, cast(doc_id % 3 AS int) AS version, n_chars FROM documents"),
    "segments_v": (["documents"], "SELECT doc_id AS segment_id, cast(floor(doc_id / 5) AS bigint) AS memory_id, source AS user_id, CASE doc_id % 6 WHEN 0 THEN 'speech' WHEN 1 THEN 'visual' WHEN 2 THEN 'ocr' WHEN 3 THEN 'caption' WHEN 4 THEN 'article' ELSE 'summary' END AS modality, cast((doc_id % 5) * 1000 AS int) AS start_ms, cast((doc_id % 5) * 1000 + (doc_id % 2) * 900 AS int) AS end_ms, text AS content FROM documents"),
    "frames_v": (["embeddings"], "SELECT vec_id AS frame_id, cast(floor(vec_id / 5) AS bigint) AS memory_id, cast(vec_id % 5 AS int) AS frame_index, cast((vec_id % 5) * 1000 AS int) AS timestamp_ms, CASE WHEN vec_id % 7 = 0 THEN cast(vec_id % 3 AS int) END AS album_index, embedding, label FROM embeddings"),
    "tags_v": (["documents"], "SELECT cast(floor(doc_id / 5) AS bigint) AS memory_id, source AS user_id, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS tag, 0.5 AS confidence FROM documents WHERE regexp_extract(text, '[A-Za-z]+', 0) <> ''"),
    "shared_v": (["pages"], "SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'https://www.instagram.com/reel' || CASE WHEN page_id % 4 = 1 THEN 's' ELSE '' END || '/sc_' || cast(page_id AS string) || '/?igsh=abc' WHEN 2 THEN 'youtu.be/vid-' || cast(100 + page_id AS string) || '?si=x' WHEN 3 THEN 'https://m.youtube.com/watch?t=9&v=v' || cast(100000 + page_id AS string) WHEN 4 THEN '  ' || replace(url, 'http://', 'https://') WHEN 5 THEN CASE WHEN page_id % 5 = 0 THEN 'https://instagram.com/user/' || cast(page_id AS string) WHEN page_id % 5 = 1 THEN 'ftp://instagram.com/p/abc' WHEN page_id % 5 = 2 THEN 'https://user:pw@example.com/a' WHEN page_id % 5 = 3 THEN '' ELSE 'https://bad_host..example/' END ELSE url END AS url FROM pages"),
}

TEXTS = ("documents", "pages")  # heavy per row

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a bound view."""
    if name not in VIEWS:
        return _read(spark, sf_dir, name)
    tables, text = VIEWS[name]
    for t in tables:
        _read(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(text)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def with_views(sql: str) -> str:
    """The SQL with the views it names in front."""
    used = [v for v in VIEWS if v in sql]
    head = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in used)
    if not used:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


class Plans:
    """Collects queries by name and, where SQL can say the same, the SQL."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = with_views(sql)
            return f

        return add
