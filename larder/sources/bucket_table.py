"""A versioned table of key buckets: upserts and replacements that rewrite touched buckets alone and appear at once.

    folder/data/<write>/bucket=<k>/...   immutable Parquet of one write
    folder/log/<version>.json            which write holds each bucket; the highest number is the table

A write reads the touched buckets of the newest version, writes their new rows aside, and publishes a log file that
takes their place; the others keep their files. Until that one step readers see the old rows, after it the new ones,
wherever a writer dies; what it leaves behind is in no log file, and `vacuum` removes it. The log file is written
aside and renamed to its number without overwriting, so of two writers of one version the later fails and nothing is lost. That rename is one
step on HDFS and local disks; on object stores use one writer at a time.

The driver holds one entry a bucket. Buckets come from the rows (ROWS_PER_BUCKET each at the first write), and when the
table has grown to CROWDED times that a write deals all of it anew.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import staged

ROWS_PER_BUCKET = 500_000
CROWDED = 4
MOST_BUCKETS = 65_536


class BucketTable:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The newest version in the folder."""
        log = self._path(f"{self.folder}/log")
        if not self._fs.exists(log):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def manifest(self, version: int | None = None) -> dict | None:
        """writes (bucket to write), buckets, rows (by bucket), schema and tag of a version, the newest by default."""
        version = self.version() if version is None else version
        if version is None:
            return None
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/log/{version}.json").collect()
        return json.loads(rows[0][0])

    def _publish(self, version: int, manifest: dict) -> None:
        aside = self._path(f"{self.folder}/log/.{uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(aside, self._path(f"{self.folder}/log/{version}.json"), none)

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(manifest["schema"])

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = self._schema(manifest)
        wanted = manifest["writes"].items() if buckets is None else [(str(b), manifest["writes"][str(b)]) for b in buckets if str(b) in manifest["writes"]]
        paths = [f"{self.folder}/data/{write}/bucket={b}" for b, write in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.folder}")
        return self._rows(manifest)

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def write(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], tag: int | None = None) -> int:
        """A version in which the rows of every touched bucket are merge(old rows, new rows). merge must keep a row's keys.
        Numbered writes (tag) that the table has already seen change nothing, so a batch that runs again is applied once."""
        version, old = self.version(), self.manifest()
        if old is not None and tag is not None and old["tag"] is not None and old["tag"] >= tag:
            return version
        new = staged(new, "bucket-new")
        if old is None:
            buckets = min(MOST_BUCKETS, max(1, -(-new.count() // ROWS_PER_BUCKET)))
        else:
            buckets, total = old["buckets"], sum(old["rows"].values())
            if total > CROWDED * ROWS_PER_BUCKET * buckets and buckets < MOST_BUCKETS:
                buckets = min(MOST_BUCKETS, -(-total // ROWS_PER_BUCKET))
        anew = old is not None and buckets != old["buckets"]
        touched = [r[0] for r in new.select(self._bucket(buckets)).distinct().collect()]  # one number a bucket
        kept = {} if old is None or anew else {b: w for b, w in old["writes"].items() if int(b) not in set(touched)}
        before = new.limit(0) if old is None else self._rows(old, None if anew else touched)
        write = uuid4().hex
        rows = merge(before, new)
        dealt = rows.withColumn("bucket", self._bucket(buckets))
        # a bucket is one task's file, or several where it is large
        dealt.repartition("bucket", F.pmod(F.hash(*self.keys), F.lit(CROWDED))).write.partitionBy("bucket").parquet(f"{self.folder}/data/{write}")
        counts = {str(r.bucket): r["count"] for r in self._counted(write, rows)}
        writes = kept | {b: write for b in counts}
        sizes = {b: (old["rows"][b] if b in kept else counts[b]) for b in writes}
        version = 0 if version is None else version + 1
        seen = tag if tag is not None else (old["tag"] if old else None)
        self._publish(version, {"buckets": buckets, "writes": writes, "rows": sizes, "schema": rows.schema.jsonValue(), "tag": seen})
        return version

    def _counted(self, write: str, rows: DataFrame) -> list:
        path = self._path(f"{self.folder}/data/{write}")
        if not any(s.getPath().getName().startswith("bucket=") for s in self._fs.listStatus(path)):
            return []
        return self.spark.read.parquet(f"{self.folder}/data/{write}").groupBy("bucket").count().collect()

    def replace(self, new: DataFrame, by: str, tag: int | None = None) -> int:
        """New rows in the place of all rows that the table has for their value of `by`, the table's only key."""
        if self.keys != [by]:
            raise ValueError(f"rows lie by {self.keys}, not by {by}")
        return self.write(new, lambda old, rows: old.join(rows.select(by).distinct(), by, "left_anti").select(rows.columns).unionByName(rows), tag)

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400.0) -> int:
        """Delete the files of writes that none of the newest `keep` versions names and that were begun more than
        older_than_s seconds ago, so that no running write or reader loses its files; log files of older versions go first.
        Gives the number of writes deleted."""
        newest = self.version()
        if newest is None:
            return 0
        named, names = set(), self._fs.listStatus(self._path(f"{self.folder}/log"))
        versions = sorted(int(n[:-5]) for s in names if (n := s.getPath().getName()).endswith(".json") and n[:-5].isdigit())
        for v in versions[-max(1, keep) :]:
            named |= set(self.manifest(v)["writes"].values())
        limit, gone = (time.time() - older_than_s) * 1000, 0
        old = [s for s in self._fs.listStatus(self._path(f"{self.folder}/data")) if s.getPath().getName() not in named and s.getModificationTime() < limit]
        for v in versions[: -max(1, keep)]:
            held = set(self.manifest(v)["writes"].values())
            if held & {s.getPath().getName() for s in old}:
                self._fs.delete(self._path(f"{self.folder}/log/{v}.json"), False)
        for s in old:
            gone += bool(self._fs.delete(s.getPath(), True))
        return gone
