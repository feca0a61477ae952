"""What runs have done: an append-only log of outputs, and runs that make only what it lacks and go on where one output fails."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import saved
from .named import write_named

SCHEMA = "filename string, state_hash string, status string, error string, logged timestamp"
#: Outputs that one job makes and that appear together.
TOGETHER = 10_000
#: Characters of an error that are kept.
ERROR_CHARS = 500


class RunLog:
    """Rows (filename, state_hash, status, error) under a path: done, empty (nothing to write) or failed.  Of one output the last row counts.

    Rows are written after the files that they tell of have appeared, so what is logged as done is there; a run that is broken off between
    makes those files again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def latest(self) -> DataFrame:
        last = F.max_by(F.struct("state_hash", "status", "error"), F.struct("logged", F.col("status") != "failed"))
        return self.rows().groupBy("filename").agg(last.alias("l")).select("filename", "l.*")

    def pending(self, tasks: DataFrame) -> DataFrame:
        """Tasks (filename, state_hash, ...) that no finished output of that state stands for."""
        finished = self.latest().where("status <> 'failed'").select("filename", "state_hash")
        return tasks.join(finished, ["filename", "state_hash"], "left_anti")

    def append(self, rows: DataFrame) -> None:
        rows.select("filename", "state_hash", "status", "error", F.current_timestamp().alias("logged")).write.mode("append").parquet(self.path)


def carried_out(tasks: DataFrame, produce: Callable[[DataFrame], DataFrame], log: RunLog, path: str, together: int = TOGETHER) -> int:
    """Makes the outputs that ``log`` lacks under ``path``, and returns how many tasks there were to do.

    ``tasks`` has filename (of one output each), state_hash, error (why a task can't be carried out, or null) and what ``produce`` needs, which gives
    (filename, content) for tasks.  About ``together`` outputs are one job: its files appear at once, and then its rows in the log.  A job
    that fails is halved until the failing task is alone; that one is logged with its error, all the others are made.  Tasks that share a file name
    can't all be made, nor told apart by halves, so they are logged as failed beforehand.
    """
    todo = log.pending(tasks)
    same = F.count("*").over(Window.partitionBy("filename"))  # a row for each task of one file
    todo = saved(todo.withColumn("error", F.coalesce("error", F.when(same > 1, F.lit("several outputs have this file name")))), "todo")
    count = todo.count()
    wrong = todo.where("error IS NOT NULL")
    if wrong.limit(1).count():
        log.append(wrong.withColumn("status", F.lit("failed")))
    sound = todo.where("error IS NULL").drop("error")
    first = max(1, math.ceil(count / together))
    spread = F.pmod(F.xxhash64("filename"), F.lit(1 << 40))
    parts = [(first, i) for i in range(first)]
    while parts:
        of, i = parts.pop()
        part = sound.where(F.pmod(spread, F.lit(of)) == i)
        try:
            documents = saved(produce(part).select("filename", "content"), "documents")
            write_named(documents, path)
            made = documents.select("filename", F.lit("done").alias("made"))
            log.append(part.join(made, "filename", "left").select("filename", "state_hash", F.coalesce("made", F.lit("empty")).alias("status"), F.lit(None).cast("string").alias("error")))
        except Exception as e:  # whatever a task may meet
            some = part.limit(2).count()
            if some == 2 and of < 1 << 39:
                parts += [(2 * of, i), (2 * of, i + of)]
            elif some:
                log.append(part.withColumns({"status": F.lit("failed"), "error": F.lit(f"{type(e).__name__}: {e}"[:ERROR_CHARS])}))
    return count
