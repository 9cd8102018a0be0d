"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder in the shared file system. `append` writes arrivals as small immutable shards
and commits a manifest version that lists them. `compact` looks at the manifest only: shards fall
into size tiers (powers of `RATIO`), and each tier with `FANIN` runs or more is merged, in order of
arrival, into files of about `target` bytes; what is already that large stays. Merged shards are
new files; the old ones stay readable for readers of older versions until `vacuum`.

A commit writes the manifest under a private name, then publishes a small file, named by the
version, that says where the manifest lies. Publishing is one atomic step that fails if the name is
taken (on local file systems a hard link, elsewhere a rename that never replaces), so of writers that
saw the same version one wins and the others raise `Conflict`. A crash before that step leaves
files that no version names.

The manifest is a table with a row per shard (metadata, not data); planning is window sums over
it. Merging is one job: rows meet their group by the file they come from, and a group is
bounded by `target`, whatever key its rows share.

Defined results: appending an empty table commits a version without new shards; null and
repeated rows, very long texts and extra columns are kept as they are, whatever their names; the
column that says which file a row lies in gets underscores behind its name where the table has
that name; a store without shards has no columns of its own and reads as an empty table only by a
schema that the reader gives.
"""

from __future__ import annotations

import json
import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.llm.columns import free_name, named

RATIO = 4
FANIN = 4
TARGET = 128 * 1024 * 1024
_SHARD = "regexp_replace(_metadata.file_path, '^.*/data/', '')"
MANIFEST = "shard string, bytes long, rows long, arrival long, level int"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def _name(version: int) -> str:
    return f"v{version:08d}"


class ShardStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest committed version, 0 before the first commit."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        place = json.loads(self.spark.read.text(f"{self.path}/manifests/{_name(v)}", wholetext=True).first()[0])["manifest"]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{place}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        place = f".rows-{uuid4().hex}"
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{place}")
        said = self._path(f"{self.path}/manifests/.said-{uuid4().hex}")
        out = self._fs.create(said, False)
        out.write(bytearray(json.dumps({"manifest": place}).encode()))
        out.close()
        try:
            won = self._publish(said, self._path(f"{self.path}/manifests/{_name(version)}"))
        finally:
            self._fs.delete(said, False)
        if not won:
            self._fs.delete(self._path(f"{self.path}/manifests/{place}"), True)
            raise Conflict(f"version {version} exists")
        return version

    def _publish(self, said, final) -> bool:
        """Give the file a version's name in one step; False where another has that name."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        try:
            if self._fs.getScheme() == "file":
                local = [jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri()) for p in (final, said)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                never = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(said.getFileSystem(self._conf).getUri(), self._conf)
                context.rename(said, final, never)
        except (Py4JJavaError, CapturedException) as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def _shards(self, folder: str, arrival, level: int) -> DataFrame:
        """A manifest row for each file in a data folder, from the files' metadata."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        name = F.regexp_replace("path", "^.*/data/", "")
        return files.select(name.alias("shard"), F.col("length").alias("bytes")).join(rows.select(name.alias("shard"), "rows"), "shard").select("shard", "bytes", "rows", F.lit(arrival).cast("long").alias("arrival"), F.lit(level).cast("int").alias("level"))

    def _begin(self, version: int) -> str:
        """A folder for new files, named as pending until _end: vacuum leaves pending folders alone."""
        name = f"{version:08d}-{uuid4().hex}"
        self._fs.create(self._path(f"{self.path}/pending/{name}"), False).close()
        return name

    def _end(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/pending/{name}"), False)

    def append(self, rows: DataFrame, max_rows: int = 50_000) -> int:
        """Write one arrival; each task's files hold at most max_rows rows."""
        if not rows.columns:
            raise ValueError("no columns")
        version = self.version() + 1
        name = self._begin(version)
        try:
            folder = f"{self.path}/data/{name}"
            rows.write.option("maxRecordsPerFile", max_rows).option("compression", "zstd").parquet(folder)
            new = self._shards(folder, version, 0).where("rows > 0")
            return self._commit(self.manifest().unionByName(new), version)
        finally:
            self._end(name)

    def plan(self, target: int = TARGET, fanin: int = FANIN) -> DataFrame:
        """shard, bytes, tier and group of each shard to merge. Runs of a tier, in arrival order, fill
        groups of about target bytes; tiers with fewer than fanin runs wait."""
        tier = F.floor(F.log(float(RATIO), F.greatest(F.col("bytes"), F.lit(1)).cast("double"))).cast("int")
        small = self.manifest().where(F.col("bytes") < target * 3 // 4).withColumn("tier", tier)
        crowd = small.withColumn("runs", F.count("*").over(Window.partitionBy("tier"))).where(F.col("runs") >= fanin)
        order = Window.partitionBy("tier").orderBy("arrival", "shard").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("bytes").over(order), F.lit(0))
        return crowd.select("shard", "bytes", "tier", F.concat_ws("-", F.lit("tier"), F.col("tier"), F.floor(before / target)).alias("group"))

    def compact(self, target: int = TARGET, fanin: int = FANIN) -> int:
        """Merge once; returns the version then current (the old one when nothing is due)."""
        old = self.version()
        chosen = self.plan(target, fanin).checkpoint()
        many = chosen.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
        chosen = chosen.join(many, "group").checkpoint()
        groups = chosen.select("group").distinct().count()
        if not groups:
            return old
        names = [r.shard for r in chosen.select("shard").toLocalIterator()]  # metadata: names of files
        data = self._files(names)
        shard, group = (free_name(n, data.columns) for n in ("__shard", "__group"))
        rows = data.select(*map(named, data.columns), F.expr(_SHARD).alias(shard))
        numbered = chosen.select(F.col("shard").alias(shard), (F.dense_rank().over(Window.orderBy("group")) - 1).alias(group))
        merged = rows.join(F.broadcast(numbered), shard).drop(shard)  # a row per file to merge
        name = self._begin(old + 1)
        try:
            folder = f"{self.path}/data/{name}"
            # a task per group, whose rows become one file: nothing is sorted
            merged.repartitionById(groups, F.col(group)).drop(group).write.option("compression", "zstd").parquet(folder)
            kept = self.manifest(old).join(chosen.select("shard"), "shard", "left_anti")
            return self._commit(kept.unionByName(self._shards(folder, old + 1, 1).where("rows > 0")), old + 1)
        finally:
            self._end(name)

    def _files(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in names])

    def read(self, version: int | None = None, shard: str = "__shard", schema: StructType | None = None) -> DataFrame:
        """The rows of a version with `shard`, the file that each lies in (underscores follow the name where the table has it).
        A store without rows reads as an empty table of `schema`; without one that is an error."""
        names = [r.shard for r in self.manifest(version).select("shard").toLocalIterator()]
        if not names:
            if schema is None:
                raise ValueError("an empty store has no columns")
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumn(free_name(shard, empty.columns), F.lit("").cast("string"))
        data = self._files(names)
        return data.select(*map(named, data.columns), F.expr(_SHARD).alias(free_name(shard, data.columns)))

    def vacuum(self, keep: int = 1, abandoned_s: float = 604_800.0) -> int:
        """Delete the data files that none of the newest `keep` versions names; returns how many. Files of a write that is
        under way stay: its folder is pending from before its first file until after its version is published. A pending mark
        older than abandoned_s seconds is of a writer that died.

        The order matters: files are listed first, then pending folders, then versions. A listed file whose folder is no
        longer pending then is of a write that had ended, so that the versions read behind it name the file if any does."""
        found, files = [], self._fs.listFiles(self._path(f"{self.path}/data"), True)
        while files.hasNext():
            found.append(files.next().getPath())
        marks = self._path(f"{self.path}/pending")
        limit = (time.time() - abandoned_s) * 1000
        pending = {s.getPath().getName() for s in self._fs.listStatus(marks) if s.getModificationTime() >= limit} if self._fs.exists(marks) else set()
        newest = self.version()
        listed = {r.shard for v in range(max(1, newest - keep + 1), newest + 1) for r in self.manifest(v).select("shard").toLocalIterator()}
        gone = 0
        for path in found:
            name = str(path.toString()).split("/data/", 1)[1]
            if name.endswith(".parquet") and name not in listed and name.split("/")[0] not in pending:
                gone += bool(self._fs.delete(path, False))
        return gone
