"""Identity of captures, items, files and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["user_id", "platform", "platform_item_id"]
#: The states whose memory is processed again when shared again.
REPROCESSED = ("FAILED_PERMANENT", "SOURCE_UNAVAILABLE", "SOURCE_REQUIRES_ACCESS")
MB = 1024 * 1024


def fold_captures(captures: DataFrame) -> DataFrame:
    """One row per (user, platform, item); the first capture's id and url stay. Aggregates
    combine before the shuffle, so a viral item costs a row per task."""
    first = F.min(F.struct("captured_at", "capture_id", "original_url"))
    return captures.groupBy(*ITEM).agg(F.min("captured_at").alias("first_saved_at"), F.max("captured_at").alias("last_saved_at"), F.count("*").alias("save_count"), first.alias("f")).select(*ITEM, "first_saved_at", "last_saved_at", "save_count", F.col("f.original_url").alias("original_url"))


def merge_captures(items: DataFrame, batch: DataFrame) -> DataFrame:
    """Folded items with a new batch folded in: counts add, times extend, the earlier url stays."""
    both = items.unionByName(fold_captures(batch))
    url = F.min(F.struct("first_saved_at", "original_url"))
    return both.groupBy(*ITEM).agg(F.min("first_saved_at").alias("first_saved_at"), F.max("last_saved_at").alias("last_saved_at"), F.sum("save_count").alias("save_count"), url.alias("f")).select(*ITEM, "first_saved_at", "last_saved_at", "save_count", F.col("f.original_url").alias("original_url"))


def decide_processing(captures: DataFrame, memories: DataFrame, jobs: DataFrame, version: int) -> DataFrame:
    """D3: `decision` per capture (capture_id, memory_id, explicit): new (no memory), duplicate (READY
    at this version), already_queued (the latest job is open), requeue (it is closed, or
    the state, the version or the user asks for it)."""
    latest = jobs.groupBy("memory_id").agg(F.max_by("status", F.struct("started_at", "job_id")).alias("job_status"))
    met = captures.join(memories.select("memory_id", F.col("status").alias("memory_status"), F.col("version").alias("memory_version")), "memory_id", "left").join(latest, "memory_id", "left")
    same = F.col("memory_version") == version
    decision = (
        F.when(F.col("memory_status").isNull(), "new")
        .when((F.col("memory_status") == "READY") & same & ~F.col("explicit"), "duplicate")
        .when(F.col("job_status").isin("QUEUED", "RUNNING"), "already_queued")
        .otherwise("requeue")
    )
    again = ~same | F.col("memory_status").isin(*REPROCESSED) | F.col("explicit")
    return met.select("capture_id", "memory_id", decision.alias("decision"), F.coalesce(again, F.lit(True)).alias("reprocess"))


def new_items(batch: DataFrame, items: DataFrame) -> DataFrame:
    """The distinct items of a batch that are not known."""
    return batch.select(*ITEM).distinct().join(items.select(*ITEM), ITEM, "left_anti")


def content_dedupe(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, content_hash, kept_key): equal contents point to the least key."""
    hashed = df.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("content_hash"))
    kept = hashed.groupBy("content_hash").agg(F.min(key).alias("kept_key"))
    return hashed.join(kept, "content_hash").select(key, "content_hash", "kept_key")


def album_identity(files: DataFrame) -> DataFrame:
    """(album_id, identity): a hash over the sorted hashes of an album's files (30 at most)."""
    return files.groupBy("album_id").agg(F.sha2(F.concat_ws(":", F.sort_array(F.collect_list("file_hash"))).cast("binary"), 256).alias("identity"))


def validate_albums(files: DataFrame) -> DataFrame:
    """(album_id, result): ACCEPTED or the first rule broken: number of files, videos, the size of
    a file, the size of all."""
    rules = files.groupBy("album_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "video").alias("videos"), F.max("bytes").alias("largest"), F.sum("bytes").alias("total"))
    result = (
        F.when(~F.col("n").between(2, 30), "ALBUM_FILE_COUNT")
        .when(F.col("videos") > 1, "ALBUM_TOO_MANY_VIDEOS")
        .when(F.col("largest") > 200 * MB, "UPLOAD_TOO_LARGE")
        .when(F.col("total") > 400 * MB, "ALBUM_TOO_LARGE")
        .otherwise("ACCEPTED")
    )
    return rules.select("album_id", result.alias("result"))


def album_files(names: DataFrame, name: str = "name") -> DataFrame:
    """(album, files): the names of each album in order of their number; other names are left out."""
    form = "^([0-9a-f]{64})\\.([0-9]{2})\\.([0-9a-f]{64})\\.([a-z0-9]+)$"
    own = names.where(F.col(name).rlike(form)).select(F.regexp_extract(name, form, 1).alias("album"), F.regexp_extract(name, form, 2).cast("int").alias("i"), F.col(name).alias("name"))
    return own.groupBy("album").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("files"))


def latest_capture(captures: DataFrame) -> DataFrame:
    """The latest capture of each item; of equal times the larger id."""
    best = captures.groupBy(*ITEM).agg(F.max(F.struct("captured_at", "capture_id", "capture_source")).alias("c"))
    return best.select(*ITEM, "c.capture_id", "c.captured_at", "c.capture_source")


def dedupe_by_rank(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
