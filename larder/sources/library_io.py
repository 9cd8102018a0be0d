"""IO1-IO5: library tables, stored media, scraper items and benchmark rows."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import islice
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import staged

TASK_FILES = 2_000  # files that a task writes
READ_FILES = 1_000  # files that a task reads
LISTED = 10_000  # names that a listing task sends at once

SCHEMAS = {
    "users": "user_id string, email string, tier string, pro_expires_at timestamp",
    "source_items": "item_id string, user_id string, platform string, platform_item_id string, canonical_url string, first_saved_at timestamp, last_saved_at timestamp, save_count bigint",
    "captures": "capture_id string, user_id string, platform string, platform_item_id string, original_url string, captured_at timestamp",
    "memories": "memory_id string, item_id string, title string, summary string, category string, status string, version int, media_kind string, thumbnail binary",
    "memory_segments": "segment_id string, memory_id string, modality string, start_ms int, end_ms int, content string, embedding array<float>, album_index int",
    "memory_frame_embeddings": "frame_id string, memory_id string, frame_index int, timestamp_ms int, selection string, album_index int, embedding array<float>",
    "memory_tags": "memory_id string, tag string, confidence double",
    "categories": "category_id string, user_id string, path string, name string, depth int, parent_id string",
    "memory_categories": "memory_id string, category_id string, is_primary boolean, confidence double, source string",
    "processing_jobs": "job_id string, memory_id string, status string, stage string, attempt_count int, failure_code string, started_at timestamp, finished_at timestamp",
    # tables of the driver
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """IO1: a table's Parquet with its declared schema: nothing is inferred, missing columns read as null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def load_jdbc(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], parts: int, **options: str) -> DataFrame:
    """IO1 from a database: read in `parts` ranges of a numeric key."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, **options).load()


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _opened(uri: str):
    """A file system and the path in it."""
    scheme, rest = uri.split(":", 1)
    return pafs.FileSystem.from_uri(f"{scheme}://{quote('/' + rest.lstrip('/') if scheme == 'file' else rest[2:])}")


def store_media(df: DataFrame, key: str, content: str, extension: str, folder: str) -> DataFrame:
    """Write each row's content (binary) as the file `<sha256>.<extension>` and return (key, name). A file shows under its
    name only when it is whole: it is written beside it as a dotfile and renamed, so a task that is lost or run twice
    does no harm, and equal contents are one file. Files lie in a folder for each first two digits of the hash, as
    writers in one folder wait for each other; a task writes about TASK_FILES of them. Rows without content (null or empty) or extension are left out."""
    rows = df.where((F.octet_length(F.col(content)) > 0) & F.col(extension).isNotNull()).select(F.col(key), F.concat(F.sha2(F.col(content).cast("binary"), 256), F.lit("."), F.col(extension)).alias("name"), F.col(content).cast("binary").alias("__content"))
    root = _qualified(df.sparkSession, folder)
    fs, base = _opened(root)
    fs.create_dir(base)  # also where nothing is stored
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_FILES))

    def run(batches):
        fs, base = _opened(root)
        made = set()
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("__content"), strict=True):
                to = f"{base}/{name[:2]}"
                if to not in made:
                    fs.create_dir(to)
                    made.add(to)
                # earlier versions stored files in the folder itself
                if any(f.type != pafs.FileType.NotFound for f in fs.get_file_info([f"{to}/{name}", f"{base}/{name}"])):
                    continue
                aside = f"{to}/.{name}.{uuid4().hex}.part"
                with fs.open_output_stream(aside) as out:
                    out.write(value.as_buffer())
                try:
                    fs.move(aside, f"{to}/{name}")
                except OSError:  # another task's file of the same content came first
                    if fs.get_file_info(f"{to}/{name}").type == pafs.FileType.NotFound:
                        raise
                    fs.delete_file(aside)
            yield batch.select([0, 1])

    # equal contents meet in one task; a task's folders are few
    dealt = rows.repartition(tasks, "name")
    return staged(dealt.mapInArrow(run, rows.select(key, "name").schema), "stored-media")


def _hidden(name: str) -> bool:
    """Names that Spark's readers skip."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name and not name.startswith("_metadata")) or name.endswith("._COPYING_")


def _base_name(info: pafs.FileInfo) -> str:
    try:
        return info.base_name
    except UnicodeDecodeError:  # skipped as hidden: no name of a stored file
        return "."


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the files in and beneath a folder, or all that a glob names. Tasks list the folders, level by
    level, into stored tables: the driver learns how many there are, not which."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    roots = [where] if store.exists(where) else [s.getPath() for s in store.globStatus(where) or ()]
    if not roots:
        raise FileNotFoundError(f"Path does not exist: {folder}")
    schema = pa.schema({"path": pa.string(), "bytes": pa.int64(), "folder": pa.bool_()})

    def entries(path: str):
        fs, at = _opened(path)
        own = fs.get_file_info(at)
        if own.type == pafs.FileType.File:
            if not _hidden(own.base_name):
                yield {"path": path, "bytes": own.size, "folder": False}
            return
        for f in fs.get_file_info(pafs.FileSelector(at)):
            name = _base_name(f)
            if f.type in (pafs.FileType.File, pafs.FileType.Directory) and not _hidden(name):
                yield {"path": f"{path.rstrip('/')}/{name}", "bytes": f.size, "folder": f.type == pafs.FileType.Directory}

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                left = entries(path)
                while some := list(islice(left, LISTED)):
                    yield pa.RecordBatch.from_pylist(some, schema)

    folders, files = spark.createDataFrame([(store.makeQualified(r).toString(),) for r in roots], "path string"), []
    while not folders.isEmpty():
        found = folders.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "path string, bytes long, folder boolean")
        found = staged(found, "listed-media", "zstd")
        files.append(found.where("NOT folder").select("path", "bytes"))
        folders = found.where("folder").select("path")
    return reduce(DataFrame.unionByName, files)


def media_inventory(spark: SparkSession, folder: str, pattern: str = "[0-9a-f]*.*", piece: int = 1 << 20) -> DataFrame:
    """IO2: (name, stated_hash, content_hash, intact, bytes, kind) of files named by their hash; dotfiles and partial
    downloads don't match the pattern, empty files are no rows. Tasks list the folders, one task each, and hash about
    READ_FILES files each, in pieces, so a file may have any size."""
    regex = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    name = F.element_at(F.split("path", "/"), -1)
    files = _listed(spark, folder).where(name.rlike(rf"\A(?s:{regex})\z") & name.rlike(r"^[0-9a-f]{64}\.") & (F.col("bytes") > 0))
    files = files.repartition(max(spark.sparkContext.defaultParallelism, -(-files.count() // READ_FILES)), "path")
    stated = F.regexp_extract(name, r"^([0-9a-f]{64})\.", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("mp4", "mov", "webm", "m4v"), "video").when(ext.isin("jpg", "jpeg", "png", "webp"), "image").otherwise("unknown")
    own = files.select("path", name.alias("name"), stated.alias("stated_hash"), "bytes", kind.alias("kind"))

    def hashed(path: str) -> str:
        fs, at = _opened(path)
        found = hashlib.sha256()
        with fs.open_input_stream(at) as data:
            while part := data.read(piece):
                found.update(part)
        return found.hexdigest()

    def run(batches):
        for batch in batches:
            yield batch.append_column("content_hash", pa.array([hashed(p) for p in batch.column("path").to_pylist()], pa.string()))

    found = own.mapInArrow(run, own.withColumn("content_hash", F.lit("")).schema)
    return found.select("name", "stated_hash", "content_hash", "bytes", "kind").withColumn("intact", F.col("stated_hash") == F.col("content_hash"))


def _time(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def normalize_items(df: DataFrame, key: str, item: str, platform: str) -> DataFrame:
    """IO3: (key, creator, caption, published_at, thumbnail, problem) of scraper items in JSON: a time that can't be
    read is null; problem is unavailable, private, retryable, unsupported or null, from the error texts."""
    if platform == "instagram":
        shape = "struct<ownerUsername:string,caption:string,timestamp:string,displayUrl:string,error:string,errorDescription:string>"
        names = ("ownerUsername", "caption", "timestamp", "displayUrl")
    else:
        shape = "struct<channelName:string,text:string,date:string,thumbnailUrl:string,error:string,note:string,isMembersOnly:boolean>"
        names = ("channelName", "text", "date", "thumbnailUrl")
    r = F.from_json(F.col(item), shape)
    rows = df.select(key, r.alias("r"))
    creator, caption, time, thumb = (F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names)
    error = F.coalesce(F.trim("r.error"), F.lit(""))
    if platform == "instagram":
        said = F.lower(F.concat_ws(" ", error, "r.errorDescription"))
        kind = F.when(said.rlike("not_found|not found|deleted"), "unavailable").when(said.rlike("private|login|access"), "private").otherwise("retryable")
    else:
        said = F.upper(error)
        kind = F.when((said == "AGE_RESTRICTED") | said.rlike("MEMBER|PRIVATE"), "private").when(said.isin("NOT_FOUND", "VIDEO_UNAVAILABLE"), "unavailable").otherwise("unsupported")
        kind = F.when((error == "") & F.col("r.isMembersOnly"), "private").otherwise(kind)
    problem = F.when(F.col("r").isNull(), "retryable").when((error != "") | (kind == "private"), kind)
    return rows.select(key, F.substring(creator, 1, 128).alias("creator"), F.substring(caption, 1, 10_000).alias("caption"), _time(time).alias("published_at"), thumb.alias("thumbnail"), problem.alias("problem"))


def replace_rows(new: DataFrame, folder: str, key: str = "memory_id", buckets: int = 32) -> None:
    """IO4: put new rows in the place of all rows that the table at `folder` has for their keys. Rows lie in buckets by
    key; only the buckets that new keys fall into are read and rewritten, each in one dynamic overwrite."""
    spark = new.sparkSession
    own = new.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    out = own
    if exists:
        old = spark.read.schema(own.schema).parquet(folder)
        touched = own.select("bucket").distinct()
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(own.select(key).distinct(), key, "left_anti")
        out = own.unionByName(kept)
    # the table can't be read and overwritten at once: the rows are written aside first
    staged(out, "replace").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def read_bench(spark: SparkSession, path: str, schema: str | None = None, array: bool = False) -> DataFrame:
    """IO5: benchmark rows as JSON lines, as write_bench leaves them; with `array`, of files that hold one JSON array each."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def write_bench(df: DataFrame, path: str) -> None:
    """IO5: rows as JSON lines; null fields are written, so that every column comes back."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
