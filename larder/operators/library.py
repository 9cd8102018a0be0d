"""Library pages, details, deletion and quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"ready": "status = 'READY'", "videos": "media_kind = 'video'", "images": "media_kind in ('image', 'album')", "links": "media_kind = 'article' or status = 'METADATA_ONLY'"}
MODALITIES = ("speech", "visual", "ocr", "caption", "article", "summary")
SELECTIONS = ("uniform", "scene", "photo")


def library_page(memories: DataFrame, limit: int, offset: int = 0, kind: str | None = None, order: str = "saved_at") -> DataFrame:
    """L1: per user the memories offset+1 to offset+limit, newest first, ties by id. The place filter lets Spark drop
    rows beyond the page inside each task."""
    own = memories.where("status <> 'DELETED'")
    own = own.where(KINDS[kind]) if kind else own
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(order), F.desc("memory_id")))
    return own.withColumn("place", place).where(F.col("place") <= offset + limit).where(F.col("place") > offset)


def kind_counts(memories: DataFrame) -> DataFrame:
    """L1: (user_id, n_all and one count per kind filter)."""
    own = memories.where("status <> 'DELETED'")
    return own.groupBy("user_id").agg(F.count("*").alias("n_all"), *[F.count_if(F.expr(e)).alias(f"n_{k}") for k, e in KINDS.items()])


def memory_detail(memories: DataFrame, tags: DataFrame, segments: DataFrame, assignments: DataFrame) -> DataFrame:
    """L2: memories with tags (sorted), segments (by start, nulls last) and categories (primary first) as arrays."""
    t = tags.groupBy("memory_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    s = segments.groupBy("memory_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start_ms").isNull().alias("last"), "start_ms", "segment_id", "modality"))).alias("s"))
    s = s.select("memory_id", F.transform("s", lambda x: F.struct(x["segment_id"].alias("segment_id"), x["modality"].alias("modality"), x["start_ms"].alias("start_ms"))).alias("segments"))
    c = assignments.groupBy("memory_id").agg(F.transform(F.sort_array(F.collect_set(F.struct((~F.col("is_primary")).alias("later"), "path"))), lambda x: x["path"]).alias("categories"))
    return memories.join(t, "memory_id", "left").join(s, "memory_id", "left").join(c, "memory_id", "left")


def job_status(memories: DataFrame, jobs: DataFrame) -> DataFrame:
    """L3: (memory_id, job_id, job_status, stage, attempt_count, failure_code) of the latest job, by start, then id."""
    latest = jobs.groupBy("memory_id").agg(F.max_by(F.struct("job_id", F.col("status").alias("job_status"), "stage", "attempt_count", "failure_code"), F.struct("started_at", "job_id")).alias("j"))
    return memories.select("memory_id").join(latest, "memory_id", "left").select("memory_id", "j.*")


def cascade_delete(tables: dict[str, DataFrame], keys: dict[str, str], ids: DataFrame, small: bool = False) -> dict[str, DataFrame]:
    """L4: the tables without the rows of the given memories: keys names each table's column. `small` says that the ids
    are known to be few, and broadcasts them."""
    gone = F.broadcast(ids) if small else ids
    return {name: df.join(gone.select(F.col("memory_id").alias(keys[name])), keys[name], "left_anti") for name, df in tables.items()}


def segment_quality(segments: DataFrame) -> DataFrame:
    """(memory_id, a count per modality, duplicates): duplicates are rows beyond the first of equal modality and
    content."""
    counts = segments.groupBy("memory_id", "modality", F.sha2(F.col("content").cast("binary"), 256).alias("h")).agg(F.count("*").alias("n"))
    per = [F.coalesce(F.sum(F.when(F.col("modality") == m, F.col("n"))), F.lit(0)).alias(f"n_{m}") for m in MODALITIES]
    return counts.groupBy("memory_id").agg(*per, F.sum(F.col("n") - 1).alias("duplicates"))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """(problem, n): rows of child whose key is in no row of parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti").agg(F.lit(name).alias("problem"), F.count("*").alias("n"))


def integrity_report(memories: DataFrame, segments: DataFrame, frames: DataFrame, assignments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, n) of the checks that find anything."""
    many = assignments.where("is_primary").groupBy("memory_id").agg(F.count("*").alias("n")).where("n > 1")
    gaps = frames.groupBy("memory_id").agg(F.count("*").alias("n"), F.countDistinct("frame_index").alias("d"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi")).where("lo <> 0 or hi <> n - 1 or d <> n")
    one = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    checks = [
        orphans(segments, memories, "memory_id", "memory_id", "segment without memory"),
        orphans(frames, memories, "memory_id", "memory_id", "frame without memory"),
        orphans(assignments, nodes, "path", "path", "assignment without category"),
        one(many, "several primary categories"),
        one(segments.where(~F.col("modality").isin(*MODALITIES)), "unknown modality"),
        one(frames.where(~F.col("selection").isin(*SELECTIONS)), "unknown selection"),
        one(nodes.where("depth < 0"), "negative depth"),
        one(gaps, "frame_index not dense"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.where("n > 0")


def detail_route(memories: DataFrame) -> DataFrame:
    """Memories with `route`: READY, METADATA_ONLY, FAILED, else PROCESSING (which retries on their own are)."""
    s = F.col("status")
    return memories.withColumn("route", F.when(s == "READY", "READY").when(s == "METADATA_ONLY", "METADATA_ONLY").when(s.isin("FAILED_PERMANENT", "SOURCE_UNAVAILABLE"), "FAILED").otherwise("PROCESSING"))


def route_counts(memories: DataFrame) -> DataFrame:
    """Counts of each route per user."""
    return detail_route(memories).groupBy("user_id").pivot("route", ["READY", "METADATA_ONLY", "PROCESSING", "FAILED"]).count().na.fill(0)
