"""Exact dedup by content sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import looked_up, lower_ascii, partitions, written

#: Characters of the text that splitters hold; texts that agree so far are split by fingerprint.
HEAD = 24


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Groups equal texts by sorting content.

    Sampled splitters range-partition the rows by the first characters of the normalised text (A-Z in lower
    case) and its fingerprint; the external sort within partitions then compares whole texts, so equal ones
    are neighbours, and a window over the full text closes each run of equals.  The row with the largest
    (or smallest) identifier stays.  Splitters are short, whatever the texts' lengths.

    A fingerprint with more than a quarter of a partition's share of rows is dealt over several pieces by the rows' places in the
    input, so rows alike in identifier too, or without one, are spread as well; there are at most 4 such fingerprints a partition,
    which bounds their broadcast.  One row for each piece, with
    its text, then meets the other pieces' rows.

    Returns (id, keep_id, group_size, kept, text_sha256), a row for every row of ``docs``.  A null text counts as
    empty.  Of rows that share text and identifier one has kept true.  Null identifiers rank last; a group of
    nothing else has a null keep_id and keeps one row.  Other columns are not read, so their names can't clash.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), lower_ascii(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("print", F.xxhash64("norm"))
    most = max(64, docs.count() // (4 * n))
    hot = rows.groupBy("print").agg(F.count("*").alias("copies")).where(F.col("copies") > most)
    hot = hot.select("print", F.ceil(F.col("copies") / most).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(hot), "print", "left")  # at most rows / most <= 4 n of them
    rows = rows.withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("pieces")))).withColumn("head", F.substring("norm", 1, HEAD))
    place = ["head", "print", "piece"]
    run = Window.partitionBy(*place, "norm")
    best = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    top = F.max if keep == "largest" else F.min
    runs = (
        rows.repartitionByRange(n, *place)
        .withColumn("turn", F.row_number().over(run.orderBy(best)))
        .withColumn("keep_id", top("id").over(run))
        .withColumn("group_size", F.count("*").over(run))
        .select(
            "id", "print", "piece", "turn", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"),
            F.when((F.col("piece") > 0) & (F.col("turn") == 1), F.col("norm")).alias("norm"),
        )
    )
    runs = written(runs, "runs")
    alone = runs.where("piece = 0").select("id", "keep_id", "group_size", (F.col("turn") == 1).alias("kept"), "text_sha256")
    whole = Window.partitionBy("print", "norm")
    first = F.col("keep_id").desc_nulls_last() if keep == "largest" else F.col("keep_id").asc_nulls_last()
    met = (
        runs.where("piece > 0 AND turn = 1")
        .select(
            "piece", "text_sha256",
            F.row_number().over(whole.orderBy(first, "piece")).alias("order"), top("keep_id").over(whole).alias("all_keep_id"), F.sum("group_size").over(whole).alias("all_size"),
        )
    )
    split = looked_up(runs.where("piece > 0").drop("norm", "print", "group_size"), written(met, "met"), ["piece", "text_sha256"])
    split = split.select("id", F.col("all_keep_id").alias("keep_id"), F.col("all_size").alias("group_size"), ((F.col("turn") == 1) & (F.col("order") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(split).withColumnRenamed("id", id_col)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; nulls, ties and repeats as in ``exact_groups``."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
