"""ST1-ST6 and IO1, IO3, IO4 over events, documents and pages."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from larder.operators import usage
from larder.plans.base import VIEWS, Plans, view
from larder.plans.taxonomy import RULES
from larder.session import shared_folder
from larder.sources import library_io
from larder.sources.bucket_table import BucketTable
from larder.streaming import streams

plan = Plans()


def _folder(spark, name):
    return f"{shared_folder(spark)}/larder-stream-{name}-{uuid4().hex}"


def _stream(spark, sf_dir, name):
    """A bound view over the events as a stream."""
    streams.read_stream(spark, f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    return spark.sql(VIEWS[name][1])


@plan("SELECT DISTINCT user_id, platform, platform_item_id FROM captures_v")
def st1_first_captures(spark, sf_dir):
    out = streams.first_captures(_stream(spark, sf_dir, "captures_v"), "60 days")
    return streams.drain(out, _folder(spark, "captures")).select(*streams.ITEM)


@plan("SELECT user_id, platform, platform_item_id, min(captured_at) AS first_saved_at, max(captured_at) AS last_saved_at, count(*) AS save_count FROM captures_v GROUP BY ALL")
def st2_upsert_items(spark, sf_dir):
    captures = _stream(spark, sf_dir, "captures_v").withColumn("original_url", F.lit(""))
    return streams.upsert_items(captures, _folder(spark, "items")).drop("original_url")


@plan("""WITH u AS (SELECT *, unnest(CASE action WHEN 'capture' THEN ['captures'] WHEN 'ask' THEN ['questions'] ELSE ['questions', 'verifications'] END) AS bucket FROM usage_v)
    SELECT * FROM (SELECT CAST(ts AS DATE) AS day, user_id, bucket, count(*) AS n FROM u GROUP BY 1, 2, 3) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM usage_v) - INTERVAL 1 DAY""")
def st3_daily_usage(spark, sf_dir):
    return streams.drain(streams.daily_usage(_stream(spark, sf_dir, "usage_v")), _folder(spark, "usage"))


@plan("""WITH w AS (SELECT a.*, time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 1 MINUTE * k AS window_start FROM attempts_v a, range(10) r(k))
    SELECT window_start, ip, count(*) AS attempts, count(*) FILTER (WHERE NOT success) AS failures FROM w GROUP BY ALL HAVING window_start + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM attempts_v) - INTERVAL 10 MINUTE""")
def st4_sliding_failures(spark, sf_dir):
    out = streams.drain(streams.sliding_failures(_stream(spark, sf_dir, "attempts_v"), "ip"), _folder(spark, "failures"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@plan("""WITH s AS (SELECT memory_id, status, ts, lead(ts) OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS nxt, (SELECT max(ts) FROM status_log_v) - INTERVAL 1 HOUR AS mark FROM status_log_v)
    SELECT memory_id, status, epoch_us(ts) / 1e6 AS since_s FROM s WHERE status IN ('RESOLVING_SOURCE', 'MEDIA_READY', 'TRANSCRIBING', 'ANALYZING_VISUALS', 'RUNNING_OCR', 'GENERATING_MEMORY', 'INDEXING') AND (epoch_us(nxt) - epoch_us(ts) > 3600000000 OR (nxt IS NULL AND ts + INTERVAL 1 HOUR < mark))""")
def st5_stuck_jobs(spark, sf_dir):
    return streams.drain(streams.stuck_jobs(_stream(spark, sf_dir, "status_log_v")), _folder(spark, "jobs"))


@plan("SELECT count(*) AS attempts, 0::BIGINT AS differing FROM attempts_v")
def st5_throttle_stream(spark, sf_dir):
    """The stream's decisions against those of the whole table at once: how many differ."""
    whole = usage.login_throttle(view(spark, sf_dir, "attempts_v"), 20, 8, 36_000).withColumnsRenamed({"allowed": "a", "retry_after": "r"})
    found = streams.throttle_stream(_stream(spark, sf_dir, "attempts_v"), _folder(spark, "throttle"), 20, 8, 36_000, delay_s=60.0, flush=True)
    met = whole.join(found, "event_id", "full")
    return met.agg(F.count("*").alias("attempts"), F.count_if(~(F.col("a").eqNullSafe(F.col("allowed")) & F.col("r").eqNullSafe(F.col("retry_after")))).alias("differing"))


@plan()
def st6_classify_stream(spark, sf_dir):
    docs = streams.read_stream(spark, f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "memory_id")
    return streams.classify_stream(docs, "text", RULES, _folder(spark, "classes"))


@plan("SELECT page_id, url, length(html) AS n FROM pages")
def io1_load(spark, sf_dir):
    return library_io.load(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("long").alias("n"))


_ITEMS = """SELECT page_id, CASE WHEN page_id % 9 = 4 THEN '{"error": "not_found", "errorDescription": "Post does not exist"}' WHEN page_id % 9 = 5 THEN '{"error": "private_page"}' WHEN page_id % 9 = 6 THEN '{"error": "x", "errorDescription": "Timed out"}' ELSE '{"ownerUsername": "u' || cast(page_id AS string) || '", "caption": "' || CASE WHEN page_id % 2 = 0 THEN '' ELSE url END || '", "timestamp": "' || CASE WHEN page_id % 7 = 0 THEN 'yesterday' ELSE '2024-01-02T03:04:0' || cast(page_id % 10 AS string) || '.000Z' END || '", "displayUrl": "https://i/' || cast(page_id AS string) || '"}' END AS item FROM pages"""


@plan(f"""WITH i AS ({_ITEMS}), j AS (SELECT page_id, nullif(json_extract_string(item, '$.ownerUsername'), '') AS creator, nullif(json_extract_string(item, '$.caption'), '') AS caption, json_extract_string(item, '$.timestamp') AS t, json_extract_string(item, '$.displayUrl') AS thumbnail, page_id % 9 AS k FROM i)
    SELECT page_id, creator, caption, strftime(TRY_CAST(replace(t, 'Z', '') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS published_at, thumbnail, CASE k WHEN 4 THEN 'unavailable' WHEN 5 THEN 'private' WHEN 6 THEN 'retryable' END AS problem FROM j""")
def io3_normalize_items(spark, sf_dir):
    view(spark, sf_dir, "shared_v")
    out = library_io.normalize_items(spark.sql(_ITEMS), "page_id", "item", "instagram")
    return out.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


@plan("SELECT memory_id, count(*) AS n, CAST(max(length(content)) AS BIGINT) AS longest FROM (SELECT memory_id, CASE WHEN memory_id % 2 = 0 THEN 'new ' || content ELSE content END AS content FROM segments_v) GROUP BY memory_id")
def io4_replace_rows(spark, sf_dir):
    """Everything is written, then the even memories again with other contents."""
    s, table = view(spark, sf_dir, "segments_v"), BucketTable(spark, _folder(spark, "table"), ["memory_id"])
    table.replace(s, "memory_id")
    table.replace(s.where("memory_id % 2 = 0").withColumn("content", F.concat(F.lit("new "), "content")), "memory_id")
    return table.read().groupBy("memory_id").agg(F.count("*").alias("n"), F.max(F.length("content")).cast("long").alias("longest"))


@plan("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN NULL ELSE text END AS text, item_id % 3 = 0 AS flagged FROM benchmark")
def io5_bench_round_trip(spark, sf_dir):
    """Benchmark rows written as JSON lines, nulls included, and read back."""
    rows = view(spark, sf_dir, "benchmark").selectExpr("item_id", "CASE WHEN item_id % 5 = 0 THEN NULL ELSE text END AS text", "item_id % 3 = 0 AS flagged")
    folder = _folder(spark, "bench")
    library_io.write_bench(rows, folder)
    return library_io.read_bench(spark, folder, "item_id long, text string, flagged boolean")


_KIND = "CASE doc_id % 3 WHEN 0 THEN 'mp4' WHEN 1 THEN 'JPG' ELSE 'bin' END"


@plan(f"""WITH m AS (SELECT DISTINCT sha256(text) AS h, {_KIND} AS e, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text <> '')
    SELECT h || '.' || e AS name, h AS stated_hash, h AS content_hash, bytes, CASE e WHEN 'mp4' THEN 'video' WHEN 'JPG' THEN 'image' ELSE 'unknown' END AS kind, true AS intact FROM m""")
def io2_media_round_trip(spark, sf_dir):
    """Every text stored as a media file under its hash, then the folder read back and every file hashed again."""
    folder = _folder(spark, "media")
    media = view(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.expr(_KIND).alias("extension"))
    library_io.store_media(media, "doc_id", "content", "extension", folder)
    return library_io.media_inventory(spark, folder)
