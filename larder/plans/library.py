"""L1-L7 and J1-J8 over documents, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import jobs, library
from larder.plans.base import Plans, view

plan = Plans()

_SAVED = "SELECT memory_id, user_id, status, media_kind, title, n_chars AS saved_at FROM memories_v"


def _memories(spark, sf_dir):
    return view(spark, sf_dir, "memories_v").withColumnRenamed("n_chars", "saved_at").select("memory_id", "user_id", "status", "media_kind", "title", "saved_at")


@plan(f"SELECT *, CAST(r AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY saved_at DESC, memory_id DESC) AS r FROM ({_SAVED}) WHERE media_kind = 'article' OR status = 'METADATA_ONLY') WHERE r > 5 AND r <= 15".replace("SELECT *, CAST(r AS INTEGER)", "SELECT * EXCLUDE (r), CAST(r AS INTEGER)"))
def l1_library_page(spark, sf_dir):
    return library.library_page(_memories(spark, sf_dir), 10, 5, "links")


@plan("SELECT user_id, count(*) AS n_all, count(*) FILTER (WHERE status = 'READY') AS n_ready, count(*) FILTER (WHERE media_kind = 'video') AS n_videos, count(*) FILTER (WHERE media_kind IN ('image', 'album')) AS n_images, count(*) FILTER (WHERE media_kind = 'article' OR status = 'METADATA_ONLY') AS n_links FROM memories_v GROUP BY user_id")
def l1_kind_counts(spark, sf_dir):
    return library.kind_counts(_memories(spark, sf_dir))


_ASSIGNED = "SELECT memory_id, CASE k WHEN 0 THEN 'A/' || user_id ELSE 'B' || cast(k AS string) END AS path, k = memory_id % 3 AS is_primary FROM (SELECT memory_id, user_id, explode(array(0, 1, 2)) AS k FROM memories_v)"
_ASSIGNED_DUCK = _ASSIGNED.replace("explode(array(0, 1, 2))", "unnest([0, 1, 2])")


def _assigned(spark, sf_dir):
    view(spark, sf_dir, "memories_v").createOrReplaceTempView("memories_v")
    return spark.sql(_ASSIGNED)


@plan(f"""WITH a AS ({_ASSIGNED_DUCK}), t AS (SELECT memory_id, list(DISTINCT tag ORDER BY tag) AS tags FROM tags_v GROUP BY memory_id),
    s AS (SELECT memory_id, string_agg(CAST(segment_id AS VARCHAR) || modality, ',' ORDER BY start_ms NULLS LAST, segment_id) AS segments FROM (SELECT * REPLACE (CASE WHEN segment_id % 3 > 0 THEN start_ms END AS start_ms) FROM segments_v) GROUP BY memory_id),
    c AS (SELECT memory_id, string_agg(path, ',' ORDER BY NOT is_primary, path) AS categories FROM a GROUP BY memory_id)
    SELECT m.memory_id, array_to_string(tags, ',') AS tags, segments, categories FROM memories_v m LEFT JOIN t USING (memory_id) LEFT JOIN s USING (memory_id) LEFT JOIN c USING (memory_id)""")
def l2_memory_detail(spark, sf_dir):
    s = view(spark, sf_dir, "segments_v").withColumn("start_ms", F.expr("CASE WHEN segment_id % 3 > 0 THEN start_ms END"))
    d = library.memory_detail(_memories(spark, sf_dir).select("memory_id"), view(spark, sf_dir, "tags_v"), s, _assigned(spark, sf_dir))
    return d.select("memory_id", F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("segments", lambda x: F.concat(x["segment_id"].cast("string"), x["modality"])), ",").alias("segments"), F.array_join("categories", ",").alias("categories"))


@plan("""SELECT m.memory_id, j.job_id, j.status AS job_status, j.stage, j.attempt_count, j.failure_code FROM memories_v m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY started_at DESC, job_id DESC) AS r FROM jobs_v) j ON j.memory_id = m.memory_id AND j.r = 1""")
def l3_job_status(spark, sf_dir):
    return library.job_status(_memories(spark, sf_dir), view(spark, sf_dir, "jobs_v"))


@plan("""WITH gone AS (SELECT memory_id FROM memories_v WHERE status = 'FAILED_PERMANENT')
    SELECT 'segments' AS name, memory_id, count(*) AS n FROM segments_v WHERE memory_id NOT IN (SELECT memory_id FROM gone) GROUP BY ALL
    UNION ALL SELECT 'frames', memory_id, count(*) FROM frames_v WHERE memory_id NOT IN (SELECT memory_id FROM gone) GROUP BY ALL
    UNION ALL SELECT 'jobs', memory_id, count(*) FROM jobs_v WHERE memory_id NOT IN (SELECT memory_id FROM gone) GROUP BY ALL""")
def l4_cascade_delete(spark, sf_dir):
    names = {"segments": "segments_v", "frames": "frames_v", "jobs": "jobs_v"}
    gone = _memories(spark, sf_dir).where("status = 'FAILED_PERMANENT'").select("memory_id")
    left = library.cascade_delete({k: view(spark, sf_dir, v) for k, v in names.items()}, dict.fromkeys(names, "memory_id"), gone)
    counts = [df.groupBy(F.lit(k).alias("name"), "memory_id").agg(F.count("*").alias("n")) for k, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_N = ", ".join(f"CAST(count(*) FILTER (WHERE modality = '{m}') AS BIGINT) AS n_{m}" for m in library.MODALITIES)


@plan(f"WITH s AS (SELECT segment_id % 40 AS memory_id, modality, content FROM segments_v) SELECT memory_id, {_N}, CAST(count(*) - count(DISTINCT (modality, content)) AS BIGINT) AS duplicates FROM s GROUP BY memory_id")
def l5_segment_quality(spark, sf_dir):
    return library.segment_quality(view(spark, sf_dir, "segments_v").withColumn("memory_id", F.col("segment_id") % 40))


@plan(f"""WITH a AS ({_ASSIGNED_DUCK}), m AS (SELECT memory_id FROM memories_v WHERE status <> 'QUEUED'), s AS (SELECT memory_id, CASE WHEN segment_id % 9 = 0 THEN 'smell' ELSE modality END AS modality FROM segments_v),
    f AS (SELECT memory_id, frame_index + CASE WHEN memory_id % 4 = 0 THEN 1 ELSE 0 END AS frame_index, CASE WHEN frame_id % 8 = 0 THEN 'odd' ELSE 'scene' END AS selection FROM frames_v),
    n AS (SELECT DISTINCT path, CASE WHEN path LIKE 'A%' THEN 0 ELSE -1 END AS depth FROM a WHERE path <> 'B2'),
    r AS (SELECT 'segment without memory' AS problem, count(*) AS n FROM s WHERE memory_id NOT IN (SELECT memory_id FROM m)
        UNION ALL SELECT 'frame without memory', count(*) FROM f WHERE memory_id NOT IN (SELECT memory_id FROM m)
        UNION ALL SELECT 'assignment without category', count(*) FROM a WHERE path NOT IN (SELECT path FROM n)
        UNION ALL SELECT 'several primary categories', count(*) FROM (SELECT memory_id FROM a WHERE is_primary GROUP BY memory_id HAVING count(*) > 1)
        UNION ALL SELECT 'unknown modality', count(*) FROM s WHERE modality = 'smell'
        UNION ALL SELECT 'unknown selection', count(*) FROM f WHERE selection = 'odd'
        UNION ALL SELECT 'negative depth', count(*) FROM n WHERE depth < 0
        UNION ALL SELECT 'frame_index not dense', count(*) FROM (SELECT memory_id FROM f GROUP BY memory_id HAVING min(frame_index) <> 0 OR max(frame_index) <> count(*) - 1 OR count(DISTINCT frame_index) <> count(*)))
    SELECT * FROM r WHERE n > 0""")
def l6_integrity_report(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    s = view(spark, sf_dir, "segments_v").withColumn("modality", F.expr("CASE WHEN segment_id % 9 = 0 THEN 'smell' ELSE modality END"))
    f = view(spark, sf_dir, "frames_v").withColumns({"frame_index": F.expr("frame_index + CASE WHEN memory_id % 4 = 0 THEN 1 ELSE 0 END"), "selection": F.expr("CASE WHEN frame_id % 8 = 0 THEN 'odd' ELSE 'scene' END")})
    nodes = a.where("path <> 'B2'").select("path", F.expr("CASE WHEN path LIKE 'A%' THEN 0 ELSE -1 END").alias("depth")).distinct()
    return library.integrity_report(_memories(spark, sf_dir).where("status <> 'QUEUED'"), s, f, a, nodes)


_STATES = "SELECT event_id AS memory_id, memory_id AS user_id, status FROM status_log_v"


@plan(f"SELECT user_id, count(*) FILTER (WHERE status = 'READY') AS READY, count(*) FILTER (WHERE status = 'METADATA_ONLY') AS METADATA_ONLY, count(*) FILTER (WHERE status NOT IN ('READY', 'METADATA_ONLY', 'FAILED_PERMANENT', 'SOURCE_UNAVAILABLE')) AS PROCESSING, count(*) FILTER (WHERE status IN ('FAILED_PERMANENT', 'SOURCE_UNAVAILABLE')) AS FAILED FROM ({_STATES}) GROUP BY user_id")
def l7_route_counts(spark, sf_dir):
    view(spark, sf_dir, "status_log_v").createOrReplaceTempView("status_log_v")
    return library.route_counts(spark.sql(_STATES))


_LEGAL = ", ".join(f"('{a}', '{b}')" for a, to in jobs.TRANSITIONS.items() for b in to)


@plan(f"SELECT from_status, to_status, count(*) AS n FROM (SELECT lag(status) OVER (PARTITION BY memory_id ORDER BY ts, event_id) AS from_status, status AS to_status FROM status_log_v) WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN ({_LEGAL}) GROUP BY ALL")
def j1_audit_transitions(spark, sf_dir):
    return jobs.audit_transitions(view(spark, sf_dir, "status_log_v"))


@plan("SELECT stage, count(*) AS n, round(avg(s), 3) AS mean_s, round(quantile_cont(s, 0.5), 3) AS p50_s, round(quantile_cont(s, 0.95), 3) AS p95_s FROM (SELECT status AS stage, (epoch_us(lead(ts) OVER (PARTITION BY memory_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS s FROM status_log_v) WHERE s IS NOT NULL GROUP BY stage")
def j2_stage_durations(spark, sf_dir):
    return jobs.stage_durations(view(spark, sf_dir, "status_log_v"))


_CODES = ", ".join(f"'{c}'" for c in jobs.RETRYABLE)


@plan(f"SELECT failure_code, failure_code IN ({_CODES}) AS retryable, n, attempts, round(n / sum(n) OVER (), 6) AS rate FROM (SELECT failure_code, count(*) AS n, CAST(sum(attempt_count) AS BIGINT) AS attempts FROM jobs_v WHERE status = 'FAILED' GROUP BY failure_code)")
def j3_failure_report(spark, sf_dir):
    return jobs.failure_report(view(spark, sf_dir, "jobs_v"))


@plan(f"SELECT job_id, attempt_count < 3 AND failure_code IN ({_CODES}) AND stage <> 'signup' AS retry, CASE WHEN attempt_count < 3 AND failure_code IN ({_CODES}) AND stage <> 'signup' THEN least(pow(2.0, attempt_count), 60.0) END AS wait_s FROM jobs_v WHERE status = 'FAILED'")
def j4_retry_plan(spark, sf_dir):
    failed = view(spark, sf_dir, "jobs_v").where("status = 'FAILED'")
    return jobs.retry_plan(failed, F.col("stage") != "signup").select("job_id", "retry", "wait_s")


_TERMINAL = "'READY', 'METADATA_ONLY', 'SOURCE_UNAVAILABLE', 'SOURCE_REQUIRES_ACCESS', 'FAILED_PERMANENT', 'DELETED'"


@plan(f"""WITH j AS (SELECT j.job_id, j.memory_id, attempt_count, m.status AS m FROM (SELECT * REPLACE (CASE WHEN job_id % 13 = 0 THEN NULL ELSE started_at END AS started_at) FROM jobs_v) j JOIN memories_v m USING (memory_id)
        WHERE j.status = 'RUNNING' AND job_id % 10 <> 3 AND (started_at IS NULL OR epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(started_at) >= 3600000000))
    SELECT job_id, memory_id, CASE WHEN m IN ({_TERMINAL}) THEN 'close' WHEN attempt_count >= 3 THEN 'fail' ELSE 'requeue' END AS action,
        CASE WHEN m = 'FAILED_PERMANENT' THEN 'FAILED' WHEN m IN ({_TERMINAL}) THEN 'DONE' WHEN attempt_count >= 3 THEN 'FAILED' ELSE 'QUEUED' END AS job_status,
        CASE WHEN m IN ({_TERMINAL}) THEN m WHEN attempt_count >= 3 THEN 'FAILED_PERMANENT' ELSE 'QUEUED' END AS memory_status,
        CASE WHEN m IN ({_TERMINAL}) THEN NULL WHEN attempt_count >= 3 THEN 'WORKER_LOST_JOB' WHEN m NOT IN ('CAPTURED', 'QUEUED', 'FAILED_RETRYABLE') THEN 'WORKER_RECOVERED' END AS code FROM j""")
def j5_recover_jobs(spark, sf_dir):
    j = view(spark, sf_dir, "jobs_v").withColumn("started_at", F.expr("CASE WHEN job_id % 13 = 0 THEN NULL ELSE started_at END"))
    return jobs.recover_jobs(j, view(spark, sf_dir, "memories_v"), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), j.where("job_id % 10 = 3"))


@plan("""WITH q AS (SELECT memory_id FROM jobs_v WHERE status = 'QUEUED' AND failure_code = 'VISION_FAILED') SELECT 'segments' AS name, count(*) AS n FROM segments_v WHERE memory_id NOT IN (SELECT memory_id FROM q) UNION ALL SELECT 'frames', count(*) FROM frames_v WHERE memory_id NOT IN (SELECT memory_id FROM q)""")
def j6_purge_partial(spark, sf_dir):
    q = view(spark, sf_dir, "jobs_v").where("status = 'QUEUED' AND failure_code = 'VISION_FAILED'")
    left = jobs.purge_partial({"segments": view(spark, sf_dir, "segments_v"), "frames": view(spark, sf_dir, "frames_v")}, q)
    s, f = (df.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, df in left.items())
    return s.unionByName(f)


@plan("SELECT memory_id, status IN ('READY', 'METADATA_ONLY', 'SOURCE_UNAVAILABLE', 'SOURCE_REQUIRES_ACCESS', 'FAILED_PERMANENT') AS reprocessable FROM memories_v")
def j7_reprocessable(spark, sf_dir):
    return jobs.reprocessable(_memories(spark, sf_dir)).select("memory_id", "reprocessable")


_RESULTS = "SELECT event_id AS result_id, event_type AS approach, CASE WHEN event_id % 12 = 0 THEN 'EXC' WHEN event_id % 5 = 0 THEN '302' ELSE '200' END AS status, value / 10 AS latency_s, event_id % 4 <> 0 AS parsed, event_id % 9 = 0 AS media, event_id % 3 = 0 AS creator, event_id % 2 = 0 AS caption FROM events"


@plan(f"""SELECT approach, count(*) AS requests, count(*) FILTER (WHERE status = '200') AS http_200, count(*) FILTER (WHERE parsed) AS parsed, round(avg(CAST(media AS INT)), 6) AS media_rate, round(avg(CAST(creator AS INT)), 6) AS creator_rate, round(avg(CAST(caption AS INT)), 6) AS caption_rate,
    round(quantile_cont(latency_s, 0.5), 6) AS p50_s, round(max(latency_s) FILTER (WHERE i = least(n - 1, CAST(floor(n * 0.95) AS BIGINT))), 6) AS p95_s, round(max(latency_s), 6) AS max_s
    FROM (SELECT *, count(*) OVER (PARTITION BY approach) AS n, row_number() OVER (PARTITION BY approach ORDER BY latency_s, result_id) - 1 AS i FROM ({_RESULTS})) GROUP BY approach""")
def j8_acquisition_report(spark, sf_dir):
    view(spark, sf_dir, "captures_v")
    return jobs.acquisition_report(spark.sql(_RESULTS))
