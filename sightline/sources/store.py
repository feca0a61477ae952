"""A store of swept surfaces: what was swept once is read the next time, whatever the targets' altitudes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import few

#: Buckets of keys, which are folders; a lookup of few keys reads few of them.
BUCKETS = 16
#: Keys (under 100 bytes each) up to which rays are not shuffled to find those of some keys.
KEYS = 1_000_000
SCHEMA = "key string, az_idx int, first int, mva array<float>, steepest double, version string, bucket int"
MANIFEST = "key string, version string, first int, samples int, rays long, stored timestamp"


class SurfaceStore:
    """Segments of rays (key, az_idx, first, mva array, steepest) under a path, and a manifest of what each write holds of each key.

    A segment is a ray's samples from ``first`` on, with the steepest slope up to its end, from which a longer sweep goes on.  A write from the
    first sample replaces what the store has of a key, one from a later sample adds to it.  Tables only grow: a deletion is a row of
    its own, later than what it deletes.  A write counts once its manifest is there, so one that fails or runs twice leaves nothing half
    done.  What a key has is read from the manifest alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, rays: DataFrame) -> DataFrame:
        """Stores rays (key, az_idx, mva, and first and steepest, which are 0 and null if they are no columns), and returns what was written."""
        version = uuid.uuid4().hex
        more = [F.col(c) if c in rays.columns else F.lit(v).cast(t).alias(c) for c, v, t in (("first", 0, "int"), ("steepest", None, "double"))]
        bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket")
        rays.select("key", "az_idx", "mva", *more, F.lit(version).alias("version"), bucket).write.mode("append").partitionBy("version", "bucket").parquet(f"{self.path}/rays")
        written = self._table("rays", SCHEMA).where(F.col("version") == version)
        held = written.groupBy("key", "version")
        held = held.agg(F.min("first").alias("first"), F.max(F.col("first") + F.size("mva")).alias("samples"), F.count("*").alias("rays"))
        held.withColumn("stored", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/manifest")
        return written

    def _live(self) -> DataFrame:
        """The manifest's rows that count: not deleted since, nor replaced by a later write from the first sample."""
        gone = self._table("deleted", "key string, deleted timestamp").groupBy("key").agg(F.max("deleted").alias("deleted"))
        rows = self._table("manifest", MANIFEST).join(few(gone), "key", "left")
        rows = rows.where(F.col("deleted").isNull() | (F.col("stored") > F.col("deleted"))).drop("deleted")
        own = Window.partitionBy("key")  # a row for each write of the key
        return rows.withColumn("since", F.max(F.when(F.col("first") == 0, F.col("stored"))).over(own)).where("stored >= since").drop("since")

    def keys(self) -> DataFrame:
        """(key, samples): the keys that the store has, each once, and how many samples of their rays."""
        return self._live().groupBy("key").agg(F.max("samples").alias("samples"))

    def _segments(self, keys: DataFrame) -> DataFrame:
        wanted = self._live().join(few(keys.select("key").distinct(), KEYS), "key", "left_semi")
        wanted = wanted.select("key", "version", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        return self._table("rays", SCHEMA).join(few(wanted, KEYS), ["version", "bucket", "key"], "left_semi")

    def segments(self, keys: DataFrame) -> DataFrame:
        """(key, az_idx, first, mva) of some keys: their rays in parts, as they were stored, without a shuffle."""
        return self._segments(keys).select("key", "az_idx", "first", "mva")

    def read(self, keys: DataFrame) -> DataFrame:
        """(key, az_idx, mva) of some keys, their segments joined; the columns of ``keys`` beside ``key`` are not read."""
        rows = self._segments(keys).groupBy("key", "az_idx").agg(F.array_sort(F.collect_list(F.struct("first", "mva"))).alias("s"))
        return rows.select("key", "az_idx", F.flatten(F.transform("s", lambda x: x["mva"])).alias("mva"))

    def boundary(self, keys: DataFrame) -> DataFrame:
        """(key, az_idx, last_r, steepest) of some keys: where their rays end, and in what state."""
        end = F.col("first") + F.size("mva") - 1
        return self._segments(keys).groupBy("key", "az_idx").agg(F.max(end).alias("last_r"), F.max_by("steepest", "first").alias("steepest"))

    def hits(self, tasks: DataFrame) -> DataFrame:
        return tasks.join(few(self.keys().select("key")), "key", "left_semi")

    def misses(self, tasks: DataFrame) -> DataFrame:
        return tasks.join(few(self.keys().select("key")), "key", "left_anti")

    def compact(self) -> None:
        """Writes what counts as one version, each key's segments as one, and deletes the files of all versions before."""
        old = [r["version"] for r in self._table("manifest", MANIFEST).select("version").distinct().collect()]  # a row for each write
        keys = self.keys().select("key")
        state = self.boundary(keys).select("key", "az_idx", "steepest")
        self.write(self.read(keys).join(state, ["key", "az_idx"]))
        for version in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rays/version={version}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def delete(self, keys: DataFrame) -> None:
        keys.select("key", F.current_timestamp().alias("deleted")).write.mode("append").parquet(f"{self.path}/deleted")

    def clear(self) -> None:
        self.delete(self.keys())

    def stats(self) -> DataFrame:
        """One row: keys, rays, and the files' number, bytes and megabytes, of rays deleted since too."""
        live = self._live().groupBy("key").agg(F.max("rays").alias("rays")).agg(F.count("*").alias("keys"), F.coalesce(F.sum("rays"), F.lit(0)).alias("rays"))
        empty = self._table("manifest", MANIFEST).limit(1).count() == 0
        files = self.spark.createDataFrame([], "length long") if empty else self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.path}/rays").select("length")
        sizes = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("mb", F.col("bytes") / (1 << 20))
        return live.join(F.broadcast(sizes))  # one row each
