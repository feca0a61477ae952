"""What the operators of this subpackage share: folders, size-checked joins, batches, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (keys and numbers, under 100 bytes a row) may be broadcast; every use counts the rows first.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_workspaces: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the workspace in it.

    Where that is unset, a session in one process gets a folder of its own; on a cluster, whose machines share no local folder, that is an error.
    """
    if _workspaces:
        return _workspaces[-1]
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside are deleted at the end, so what is made of them has to be written elsewhere by then."""
    folder = f"{shared_folder(spark)}/workspace-{uuid.uuid4().hex}"
    _workspaces.append(folder)
    try:
        yield
    finally:
        _workspaces.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str, folder: str | None = None) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder (or the one named), read again."""
    path = f"{folder or shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Lowers the rows and bytes of an Arrow batch, as texts can be long.  It holds for the session, as plans run after they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim() -> None:
    """Gives a Python worker's free memory back: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run):
    """A function for mapInArrow that gives its memory back when a task ends."""

    def then_trimmed(batches):
        yield from run(batches)
        trim()

    return then_trimmed


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_ascii(text: Column) -> Column:
    """A null is empty; A-Z become a-z and nothing else changes."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def draw(*parts: Column | str | int) -> Column:
    """A double of 52 bits in [0, 1), from the md5 of the parts."""
    text = F.concat_ws("/", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with right, a table that is cheap to count: broadcast up to so many rows, else shuffled (AQE splits hot keys)."""
    few = right.limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if few else right, keys, how)


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a long, b long) can reach.

    Every round hooks each label to the smallest label beside it and jumps to that label's own label,
    so rounds grow with the logarithm of the diameter.  Each round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        # What a label has reached through any of its nodes, then one jump along it.
        roots = hooked.groupBy(F.col("old").alias("low")).agg(F.min("low").alias("jump"))
        after = written(
            hooked.join(roots, "low", "left").select("node", "old", F.least(F.col("low"), F.coalesce(F.col("jump"), F.col("low"))).alias("component")), "labels"
        )
        if after.where("component <> old").limit(1).count() == 0:
            return after.select("node", "component")
        labels = after.select("node", "component")
