"""Job states, failures, recovery and acquisition reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.orderstats import low_place, median, order_statistics

# The legal transitions, the settled states, the failures that may be tried again.
FAILS = ("FAILED_RETRYABLE", "FAILED_PERMANENT")
TRANSITIONS = {
    "CAPTURED": ("QUEUED",),
    "QUEUED": ("RESOLVING_SOURCE", "DELETED", "QUEUED"),
    "RESOLVING_SOURCE": ("MEDIA_READY", "GENERATING_MEMORY", "METADATA_ONLY", "SOURCE_UNAVAILABLE", "SOURCE_REQUIRES_ACCESS", *FAILS),
    "MEDIA_READY": ("TRANSCRIBING", "ANALYZING_VISUALS", *FAILS),
    "TRANSCRIBING": ("ANALYZING_VISUALS", *FAILS),
    "ANALYZING_VISUALS": ("RUNNING_OCR", *FAILS),
    "RUNNING_OCR": ("GENERATING_MEMORY", *FAILS),
    "GENERATING_MEMORY": ("INDEXING", *FAILS),
    "INDEXING": ("READY", *FAILS),
    "FAILED_RETRYABLE": ("QUEUED", "DELETED"),
    "READY": ("QUEUED", "DELETED"),
    "METADATA_ONLY": ("QUEUED", "DELETED"),
    "SOURCE_UNAVAILABLE": ("QUEUED", "DELETED"),
    "SOURCE_REQUIRES_ACCESS": ("QUEUED", "DELETED"),
    "FAILED_PERMANENT": ("QUEUED", "DELETED"),
}
SETTLED = ("READY", "METADATA_ONLY", "SOURCE_UNAVAILABLE", "SOURCE_REQUIRES_ACCESS", "FAILED_PERMANENT")
TERMINAL = (*SETTLED, "DELETED")
RETRYABLE = ("SOURCE_RATE_LIMITED", "SOURCE_RESOLUTION_FAILED", "MEDIA_DOWNLOAD_FAILED", "TRANSCRIPTION_FAILED", "VISION_FAILED", "OCR_FAILED", "EMBEDDING_FAILED", "VISUAL_INDEX_FAILED", "DATABASE_FAILED", "INDEXING_FAILED")
MAX_ATTEMPTS, BACKOFF_CAP_S, STALE_S = 3, 60, 3600


def transitions(spark: SparkSession) -> DataFrame:
    """(from_status, to_status): a table of fixed size."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_status string, to_status string")


def _order() -> Window:
    return Window.partitionBy("memory_id").orderBy("ts", "event_id")


def audit_transitions(log: DataFrame) -> DataFrame:
    """(from_status, to_status, n) of the illegal steps of a status log."""
    steps = log.select(F.lag("status").over(_order()).alias("from_status"), F.col("status").alias("to_status")).where("from_status is not null")
    counts = steps.groupBy("from_status", "to_status").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(transitions(log.sparkSession)), ["from_status", "to_status"], "left_anti")


def stage_durations(log: DataFrame) -> DataFrame:
    """(stage, n, mean_s, p50_s, p95_s) of the time spent in each status until the next."""
    seconds = lambda c: F.unix_micros(F.to_timestamp(c)) / 1e6
    own = log.select(F.col("status").alias("stage"), (seconds(F.lead("ts").over(_order())) - seconds(F.col("ts"))).alias("s")).where("s is not null")
    placed = order_statistics(own, "stage", "s", {"p50_s": median(), "p95_s": (F.col("n") - 1) * 0.95})
    means = own.groupBy(F.col("stage").alias("a")).agg(F.round(F.avg("s"), 3).alias("mean_s"))
    met = placed.join(means, F.col("stage").eqNullSafe(F.col("a")))
    return met.select("stage", "n", "mean_s", F.round("p50_s", 3).alias("p50_s"), F.round("p95_s", 3).alias("p95_s"))


def retryable(code: Column) -> Column:
    return code.isin(*RETRYABLE)


def failure_report(jobs: DataFrame) -> DataFrame:
    """(failure_code, retryable, n, attempts, rate): failed jobs by code, their attempts, their share of all failed."""
    g = jobs.where("status = 'FAILED'").groupBy("failure_code").agg(F.count("*").alias("n"), F.sum("attempt_count").alias("attempts"))
    return g.select("failure_code", retryable(F.col("failure_code")).alias("retryable"), "n", "attempts", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("rate"))


def retry_plan(failures: DataFrame, configured: Column | None = None) -> DataFrame:
    """Failures with `retry` and `wait_s`: under three attempts and a retryable code (and a configured provider)
    wait min(2^attempts, 60) seconds; else the failure is permanent and wait_s null."""
    again = (F.col("attempt_count") < MAX_ATTEMPTS) & retryable(F.col("failure_code"))
    again = F.coalesce(again if configured is None else again & configured, F.lit(False))
    wait = F.least(F.pow(F.lit(2.0), F.col("attempt_count")), F.lit(float(BACKOFF_CAP_S)))
    return failures.withColumns({"retry": again, "wait_s": F.when(again, wait)})


def recover_jobs(jobs: DataFrame, memories: DataFrame, now: Column, claimed: DataFrame) -> DataFrame:
    """(job_id, memory_id, action, job_status, memory_status, code) for jobs left RUNNING without an owner, stale or
    without a start: closed as their settled memory is, failed when the attempts are spent, else queued again."""
    own = jobs.where("status = 'RUNNING'").join(claimed.select("job_id"), "job_id", "left_anti")
    stale = own.where(F.col("started_at").isNull() | (F.unix_micros(F.to_timestamp(now)) - F.unix_micros(F.to_timestamp("started_at")) >= STALE_S * 1_000_000))
    met = stale.join(memories.select("memory_id", F.col("status").alias("m")), "memory_id")
    settled, spent = F.col("m").isin(*TERMINAL), F.coalesce("attempt_count", F.lit(0)) >= MAX_ATTEMPTS
    action = F.when(settled, "close").when(spent, "fail").otherwise("requeue")
    job = F.when(settled, F.when(F.col("m") == "FAILED_PERMANENT", "FAILED").otherwise("DONE")).when(spent, "FAILED").otherwise("QUEUED")
    memory = F.when(settled, F.col("m")).when(spent, "FAILED_PERMANENT").otherwise("QUEUED")
    early = F.col("m").isin("CAPTURED", "QUEUED", "FAILED_RETRYABLE")
    code = F.when(settled, F.lit(None)).when(spent, "WORKER_LOST_JOB").when(~early, "WORKER_RECOVERED")
    return met.select("job_id", "memory_id", action.alias("action"), job.alias("job_status"), memory.alias("memory_status"), code.alias("code"))


def purge_partial(tables: dict[str, DataFrame], requeued: DataFrame) -> dict[str, DataFrame]:
    """Evidence tables without the rows of memories that are queued again; captions and articles, which come from
    the source and not from a run, go too."""
    gone = requeued.select("memory_id").distinct()
    return {name: df.join(gone, "memory_id", "left_anti") for name, df in tables.items()}


def reprocessable(memories: DataFrame) -> DataFrame:
    """`reprocessable`: settled and not deleted."""
    return memories.withColumn("reprocessable", F.col("status").isin(*SETTLED))


def acquisition_report(results: DataFrame) -> DataFrame:
    """Per approach: requests, HTTP 200s, parsed, media and field shares, median, floor-index p95 and largest
    latency. results: approach, status (text), latency_s, parsed, media, creator, caption."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate")
    g = results.groupBy("approach").agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "200").alias("http_200"), F.count_if("parsed").alias("parsed"), share("media"), share("creator"), share("caption"), F.round(F.max("latency_s"), 6).alias("max_s"))
    placed = order_statistics(results, "approach", "latency_s", {"p50_s": median(), "p95_s": low_place(0.95)}).withColumnRenamed("approach", "a").drop("n")
    met = g.join(placed, F.col("approach").eqNullSafe(F.col("a")), "left").drop("a")
    return met.withColumns({"p50_s": F.round("p50_s", 6), "p95_s": F.round("p95_s", 6)})
