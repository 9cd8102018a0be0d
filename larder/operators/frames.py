"""Frame timestamps, selection and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uniform_timestamps(media: DataFrame, n: int = 12) -> DataFrame:
    """E5: (media_id, i, timestamp_ms) of n even samples; all zero without a duration."""
    n = max(1, n)
    d = F.col("duration_s")
    at = F.when(d > 0, (F.col("i") * d / n * 1000).cast("int")).otherwise(F.lit(0))
    return media.select("media_id", "duration_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("media_id", "i", at.alias("timestamp_ms"))


def even_subsample(df: DataFrame, keys: list[str], order: list[str], cap: int, rounded: bool = False) -> DataFrame:
    """At most cap rows per key, evenly by place: place int(i * n / cap), or with `rounded` the half-even
    round(i * (n - 1) / (cap - 1)), which keeps both ends."""
    w = Window.partitionBy(*keys)
    placed = df.withColumns({"__at": F.row_number().over(w.orderBy(*order)) - 1, "__n": F.count("*").over(w)})
    i = F.sequence(F.lit(0), F.lit(cap - 1))
    if rounded and cap > 1:
        wanted = F.transform(i, lambda x: F.bround(x * (F.col("__n") - 1) / F.lit(float(cap - 1))).cast("long"))
    else:
        wanted = F.transform(i, lambda x: F.floor(x * F.col("__n") / F.lit(float(cap))).cast("long"))
    return placed.where((F.col("__n") <= cap) | F.array_contains(wanted, F.col("__at").cast("long"))).drop("__at", "__n")


def dedupe_cuts(cuts: DataFrame, uniform: DataFrame, window_ms: int = 150) -> DataFrame:
    """The cuts (media_id, timestamp_ms) farther than window_ms from every uniform sample of their file. A file
    has few samples: they meet its cuts as one array."""
    samples = uniform.groupBy("media_id").agg(F.collect_set("timestamp_ms").alias("__u"))
    far = F.forall(F.coalesce("__u", F.array().cast("array<int>")), lambda u: F.abs(F.col("timestamp_ms") - u) > window_ms)
    return cuts.join(samples, "media_id", "left").where(far).drop("__u")


def select_frames(uniform: DataFrame, cuts: DataFrame, photos: DataFrame, max_extra: int = 12) -> DataFrame:
    """(media_id, timestamp_ms, selection): uniform samples, the scene cuts kept (at most max_extra, evenly),
    and photos (media_id) as one sample at 0."""
    kept = even_subsample(dedupe_cuts(cuts.select("media_id", "timestamp_ms"), uniform), ["media_id"], ["timestamp_ms"], max_extra)
    tag = lambda df, s: df.select("media_id", "timestamp_ms", F.lit(s).alias("selection"))
    return tag(uniform, "uniform").unionByName(tag(kept, "scene")).unionByName(tag(photos.select("media_id", F.lit(0).alias("timestamp_ms")), "photo"))


def assign_frame_index(frames: DataFrame) -> DataFrame:
    """`frame_index`, dense from 0 per memory over album files, time and kind."""
    order = Window.partitionBy("memory_id").orderBy(F.coalesce("album_index", F.lit(-1)), "timestamp_ms", "selection", "media_id")
    return frames.withColumn("frame_index", F.row_number().over(order) - 1)


def media_policy(probes: DataFrame, max_s: float = 600.0) -> DataFrame:
    """`decision` of each probe (duration_s, has_video, has_audio): ok, ok_no_transcript, no_video, too_long."""
    decision = F.when(~F.col("has_video"), "no_video").when(F.col("duration_s") > max_s, "too_long").when(~F.col("has_audio"), "ok_no_transcript").otherwise("ok")
    return probes.withColumn("decision", decision)


def visual_coverage(items: DataFrame, frames: DataFrame, files: DataFrame) -> DataFrame:
    """(memory_id, state, n_frames) of items (memory_id, platform, platform_item_id): READY with frames,
    BACKFILL_AVAILABLE for uploads whose file (name `<id>.<ext>`, no dotfile) is there, else SOURCE_UNAVAILABLE."""
    n = frames.groupBy("memory_id").agg(F.count("*").alias("n_frames"))
    stored = files.where(~F.col("name").startswith(".")).select(F.regexp_extract("name", r"^([^.]+)\.", 1).alias("platform_item_id")).distinct().withColumn("there", F.lit(True))
    met = items.join(n, "memory_id", "left").join(stored, "platform_item_id", "left")
    state = F.when(F.col("n_frames") > 0, "READY").when((F.col("platform") == "upload") & F.col("there"), "BACKFILL_AVAILABLE").otherwise("SOURCE_UNAVAILABLE")
    return met.select("memory_id", state.alias("state"), F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"))
