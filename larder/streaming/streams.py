"""ST1-ST6: captures, counters, failure rates, job watch and classification as streams.

Every stateful step has a watermark; state goes when it passes. Timestamps are cast to the session's zone, UTC.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.operators import dedup, taxonomy, usage
from larder.session import staged
from larder.sources.bucket_table import BucketTable

ITEM = ["user_id", "platform", "platform_item_id"]
IN_FLIGHT = ("RESOLVING_SOURCE", "MEDIA_READY", "TRANSCRIBING", "ANALYZING_VISUALS", "RUNNING_OCR", "GENERATING_MEMORY", "INDEXING")


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet folder, or a single file, as a stream, with the schema of what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)  # streams read folders: this one, for files of that name
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name).parquet(folder)


def drain(df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def for_each_batch(df: DataFrame, folder: str, f: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(f).start().awaitTermination()


def first_captures(captures: DataFrame, delay: str = "7 days") -> DataFrame:
    """ST1, D10: captures without repeats of an item within the delay."""
    return captures.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(ITEM)


def upsert_items(captures: DataFrame, folder: str) -> DataFrame:
    """ST2: items folded from all batches: a versioned table of key buckets (`BucketTable`) at folder/items. A batch reads
    and rewrites the buckets that its items fall into and no others; one that runs twice is applied once, and a restart
    with nothing new gives the newest version that is in the folder."""
    table = BucketTable(captures.sparkSession, f"{folder}/items", ITEM)
    for_each_batch(captures, folder, lambda batch, number: table.write(batch, merged_items, tag=number))
    return table.read()


def merged_items(items: DataFrame, batch: DataFrame) -> DataFrame:
    return dedup.merge_captures(items, batch) if "save_count" in items.columns else dedup.fold_captures(batch)


def daily_usage(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST3: (day, user_id, bucket, n) of each day that the watermark has closed; later rows are dropped."""
    own = usage.exploded(events.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", delay)
    g = own.groupBy(F.window("ts", "1 day").alias("w"), "user_id", "bucket").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").cast("date").alias("day"), "user_id", "bucket", "n")


def sliding_failures(attempts: DataFrame, key: str, window: str = "10 minutes", slide: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """ST4: (window_start, key, attempts, failures) of each sliding window closed by the watermark."""
    own = attempts.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    g = own.groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count("*").alias("attempts"), F.count_if(~F.col("success")).alias("failures"))
    return g.select(F.col("w.start").alias("window_start"), key, "attempts", "failures")


def stuck_jobs(log: DataFrame, limit_s: int = 3600, delay: str = "1 hour") -> DataFrame:
    """ST5: (memory_id, status, since_s) of each spell of more than limit_s seconds in one in-flight status: found when
    the next status comes, or by an event-time timer when none does. State is one status and time per memory."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        now, since = state.get if state.exists else ("", 0.0)
        if state.hasTimedOut:
            out.append((key[0], now, since))
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
            for status, at in zip(rows["status"], rows["at"], strict=True):
                if now in IN_FLIGHT and at - since > limit_s:
                    out.append((key[0], now, since))
                now, since = status, float(at)
            state.update((now, since))
            mark = state.getCurrentWatermarkMs()
            if now in IN_FLIGHT:
                state.setTimeoutTimestamp(max(int((since + limit_s) * 1000), mark + 1))
        yield pd.DataFrame(out, columns=["memory_id", "status", "since_s"])

    own = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    own = own.select("memory_id", "event_id", "status", "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    return own.groupBy("memory_id").applyInPandasWithState(watch, "memory_id long, status string, since_s double", "status string, since double", "append", GroupStateTimeout.EventTimeTimeout)


def classify_stream(memories: DataFrame, text: str, rules: tuple, folder: str) -> DataFrame:
    """ST6: (memory_id, path, score, confidence) of arriving memories by their text, batch by batch; a batch that runs
    twice overwrites its own rows."""
    spark = memories.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        fields = batch.select("memory_id", F.lit("article").alias("field"), taxonomy.norm(F.col(text)).alias("text")).where("text <> ''")
        decided = taxonomy.classify(batch, fields, taxonomy.rule_scores(fields, rules), rules)
        decided.write.mode("overwrite").parquet(f"{folder}/decisions/batch={number}")

    for_each_batch(memories, folder, step)
    return spark.read.parquet(f"{folder}/decisions").drop("batch")


def throttle_stream(attempts: DataFrame, folder: str, per_ip: int = 20, per_account: int = 8, window_s: int = 600, delay_s: float = 0.0, flush: bool = False) -> DataFrame:
    """ST5, the exact throttle: (event_id, allowed, retry_after) of every attempt, as login_throttle decides it.

    Decisions depend on the order over linked keys, so a batch's attempts are decided by linked component, each fed in
    order of time behind what is still recorded for its IPs and accounts (usage.decide). The state is a Parquet
    version for each batch: the recorded failures of the last window, and the attempts that wait because they are less than delay_s
    older than the newest seen. An attempt that comes later than that is decided in its batch, in its place among the batch's own.
    A batch that runs again writes its version and its decisions again. With `flush`, what waits at the end is decided too.
    """
    spark = attempts.sparkSession

    def settle(batch: DataFrame, number: int, last: bool = False) -> None:
        own = usage.attempt_rows(batch)
        if number:
            state = spark.read.parquet(f"{folder}/state/v{number - 1}")
            own = own.unionByName(state.where("kind = 2"))
            records = state.where("kind < 2")
        else:
            records = own.limit(0)
        own = staged(own, "throttle-batch")
        newest = own.agg(F.max("at")).first()[0]
        ready = own if last or newest is None else own.where(F.col("at") <= newest - delay_s)
        waiting = own.where("false") if last or newest is None else own.where(F.col("at") > newest - delay_s)
        decided, left = usage.decide(ready, records, per_ip, per_account, window_s)
        decided.write.mode("overwrite").parquet(f"{folder}/decisions/batch={number}")
        left.unionByName(waiting).write.mode("overwrite").parquet(f"{folder}/state/v{number}")

    for_each_batch(attempts, folder, settle)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    done = [int(s.getPath().getName()[1:]) for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().startswith("v")]
    if flush:
        settle(attempts_like(spark, attempts), max(done) + 1, True)
    return spark.read.parquet(f"{folder}/decisions").drop("batch")


def attempts_like(spark: SparkSession, attempts: DataFrame) -> DataFrame:
    """No attempts, with the columns of the stream."""
    return spark.createDataFrame([], attempts.schema)
