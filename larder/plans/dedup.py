"""D1-D9 over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import dedup
from larder.plans.base import Plans, view

plan = Plans()

_CAPTURES = "SELECT *, 'https://x.example/' || platform || '/' || platform_item_id || '?c=' || cast(capture_id AS string) AS original_url FROM captures_v"
_ITEM = "user_id, platform, platform_item_id"
_FOLD = f"SELECT {_ITEM}, min(captured_at) AS first_saved_at, max(captured_at) AS last_saved_at, count(*) AS save_count, arg_min(original_url, (captured_at, capture_id)) AS original_url"


def _captures(spark, sf_dir):
    return view(spark, sf_dir, "captures_v").withColumn("original_url", F.expr("'https://x.example/' || platform || '/' || platform_item_id || '?c=' || cast(capture_id AS string)"))


@plan(f"WITH c AS ({_CAPTURES}) {_FOLD} FROM c GROUP BY {_ITEM}")
def d1_fold_captures(spark, sf_dir):
    return dedup.fold_captures(_captures(spark, sf_dir))


@plan(f"WITH c AS ({_CAPTURES}) {_FOLD} FROM c GROUP BY {_ITEM}")
def d2_merge_captures(spark, sf_dir):
    """Two halves, folded and merged, are the whole, folded."""
    c = _captures(spark, sf_dir)
    return dedup.merge_captures(dedup.fold_captures(c.where("capture_id % 3 <> 1 OR user_id % 2 = 0")), c.where("NOT (capture_id % 3 <> 1 OR user_id % 2 = 0)"))


@plan("""WITH latest AS (SELECT memory_id, arg_max(status, (started_at, job_id)) AS js FROM jobs_v GROUP BY memory_id)
    SELECT c.capture_id, c.user_id AS memory_id,
        CASE WHEN m.status IS NULL THEN 'new' WHEN m.status = 'READY' AND m.version = 1 AND NOT (c.capture_id % 10 = 0) THEN 'duplicate' WHEN js IN ('QUEUED', 'RUNNING') THEN 'already_queued' ELSE 'requeue' END AS decision,
        coalesce(m.version <> 1 OR m.status IN ('FAILED_PERMANENT', 'SOURCE_UNAVAILABLE', 'SOURCE_REQUIRES_ACCESS') OR c.capture_id % 10 = 0, true) AS reprocess
    FROM captures_v c LEFT JOIN memories_v m ON m.memory_id = c.user_id LEFT JOIN latest l ON l.memory_id = c.user_id""")
def d3_decide_processing(spark, sf_dir):
    c = view(spark, sf_dir, "captures_v").select("capture_id", F.col("user_id").alias("memory_id"), (F.col("capture_id") % 10 == 0).alias("explicit"))
    return dedup.decide_processing(c, view(spark, sf_dir, "memories_v"), view(spark, sf_dir, "jobs_v"), 1)


@plan(f"SELECT DISTINCT {_ITEM} FROM captures_v WHERE capture_source = 'click' EXCEPT SELECT {_ITEM} FROM captures_v WHERE capture_source <> 'click'")
def d4_new_items(spark, sf_dir):
    c = view(spark, sf_dir, "captures_v")
    return dedup.new_items(c.where("capture_source = 'click'"), c.where("capture_source <> 'click'"))


@plan("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS kept_key FROM documents")
def d5_content_dedupe(spark, sf_dir):
    return dedup.content_dedupe(view(spark, sf_dir, "documents"), "doc_id", "text")


@plan("SELECT cast(floor(doc_id / 7) AS bigint) AS album_id, sha256(string_agg(sha256(text), ':' ORDER BY sha256(text))) AS identity FROM documents GROUP BY 1")
def d6_album_identity(spark, sf_dir):
    files = view(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).alias("album_id"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return dedup.album_identity(files)


_FILES = "SELECT cast(floor(doc_id / (1 + doc_id % 9)) AS bigint) AS album_id, CASE WHEN doc_id % 4 = 0 THEN 'video' ELSE 'image' END AS kind, n_chars * 20000 AS bytes FROM documents"


@plan(f"""SELECT album_id, CASE WHEN n NOT BETWEEN 2 AND 30 THEN 'ALBUM_FILE_COUNT' WHEN v > 1 THEN 'ALBUM_TOO_MANY_VIDEOS' WHEN m > 209715200 THEN 'UPLOAD_TOO_LARGE' WHEN s > 419430400 THEN 'ALBUM_TOO_LARGE' ELSE 'ACCEPTED' END AS result
    FROM (SELECT album_id, count(*) AS n, count(*) FILTER (WHERE kind = 'video') AS v, max(bytes) AS m, sum(bytes) AS s FROM ({_FILES}) GROUP BY album_id)""")
def d7_validate_albums(spark, sf_dir):
    view(spark, sf_dir, "memories_v")
    return dedup.validate_albums(spark.sql(_FILES))


_NAMES = "SELECT sha2_album || '.' || lpad(cast(doc_id % 10 AS string), 2, '0') || '.' || sha2_file || CASE WHEN doc_id % 11 = 3 THEN '.tmp!' ELSE '.jpg' END AS name FROM (SELECT doc_id, {h}(cast(cast(floor(doc_id / 10) AS bigint) AS string){n}) AS sha2_album, {h}(text{n}) AS sha2_file FROM documents)"


@plan("SELECT regexp_extract(name, '^([0-9a-f]{64})', 1) AS album, list(name ORDER BY name) AS files FROM (" + _NAMES.format(h="sha256", n="") + ") WHERE regexp_full_match(name, '[0-9a-f]{64}[.][0-9]{2}[.][0-9a-f]{64}[.][a-z0-9]+') GROUP BY 1")
def d8_album_files(spark, sf_dir):
    view(spark, sf_dir, "memories_v")
    return dedup.album_files(spark.sql(_NAMES.format(h="sha2", n=", 256")))


@plan(f"SELECT {_ITEM}, max(capture_id) FILTER (WHERE r = 1) AS capture_id, max(captured_at) FILTER (WHERE r = 1) AS captured_at, max(capture_source) FILTER (WHERE r = 1) AS capture_source FROM (SELECT *, row_number() OVER (PARTITION BY {_ITEM} ORDER BY captured_at DESC, capture_id DESC) AS r FROM captures_v) GROUP BY {_ITEM}")
def d9_latest_capture(spark, sf_dir):
    return dedup.latest_capture(view(spark, sf_dir, "captures_v"))
