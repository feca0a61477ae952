"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import draw, looked_up, written

#: A mean above this is the sum of equal smaller means, each drawn on its own.
PART = 16.0
#: Values of one such draw; beyond them a mean of 16 has no mass that a double could show.
TERMS = 96
SALTS = 64
#: Production mix of the query: sources by the square root of their size, about as many rows as came in.
ALPHA = 0.5


def target_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: int | None = None) -> DataFrame:
    """(source, rate): how often a document of each source is to appear on average.

    ``weights`` gives each source's share of the result (sources that it does not name get none); without it
    shares are proportional to the source's size to the power ``alpha``.  ``total`` rows are expected, by default as
    many as there are.  A null source is a source like any other and never has a named weight.
    """
    sizes = docs.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source") == name, float(weight)).otherwise(share)
    sizes = sizes.withColumn("share", F.coalesce(share, F.lit(0.0)))
    sums = sizes.agg(F.sum("share").alias("shares"), F.sum("n").alias("rows"))  # one row
    rows = F.col("rows") if total is None else F.lit(total)
    rate = F.when(F.col("shares") > 0, rows * F.col("share") / F.col("shares") / F.col("n")).otherwise(0.0)
    return sizes.join(F.broadcast(sums)).select("source", rate.alias("rate"))


def mixed(docs: DataFrame, rates: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, few_sources: int = 10_000) -> DataFrame:
    """Each document as often as a Poisson draw with its source's rate says, all in random order.

    The draw inverts the Poisson distribution at a hash of seed and identifier, so the same document gets the same count
    whatever the partitioning.  Where rows share an identifier or have none, the hash takes in their content; where rows
    are alike in all columns too, also their places in the input: each row has a draw of its own, whatever repeats.
    Copies get a random key of their own, are dealt out by it and lie in its order in each partition.  Up to ``few_sources``
    sources are broadcast; with more, both sides are salted, so a source that holds a third of the rows is spread
    over many tasks.

    Returns the columns of ``docs`` (any names; ones called mix_copy, mix_copies or mix_key are replaced) and mix_copy (from 0),
    mix_copies, mix_key.  A null text or other column changes nothing.  Sources absent from ``rates`` are left out.
    """
    own = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_copies", "mix_key")]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(*hashed).alias("content")
    )
    alike = rows.groupBy("id", "content").agg(F.count("*").alias("n")).where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    rows = looked_up(rows, written(alike.where("rows > 1").drop("rows"), "alike"), ["id"], "left")
    place = F.when(F.col("id").isNull() | (F.col("most") > 1), F.monotonically_increasing_id().cast("string"))
    key = F.when(F.col("id").isNotNull() & F.col("most").isNull(), F.col("id").cast("string")).otherwise(
        F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("content").cast("string"), place)
    )
    rows = rows.select("row", "source", key.alias("key"))

    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    mean = F.col("rate") / F.col("parts")
    none = F.exp(-mean)
    table = rates.withColumn("parts", parts).select(
        F.col("source").alias("of"),
        "parts",
        F.aggregate(
            F.sequence(F.lit(1), F.lit(TERMS)),
            F.struct(none.alias("p"), F.array(none).alias("sums")),
            lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + s["p"] * mean / k)).alias("sums")),
            lambda s: s["sums"],
        ).alias("sums"),
    )
    table = written(table, "rates")
    same = F.col("source").eqNullSafe(F.col("of"))
    if table.limit(few_sources + 1).count() <= few_sources:
        joined = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own_salt") == F.col("salt")))
    counts = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda n, j: n + F.size(F.filter("sums", lambda c: c <= draw(seed, F.col("key"), j))))
    once = F.size(F.filter("sums", lambda c: c <= F.col("first_draw")))
    counts = F.when(F.col("parts") == 1, once).otherwise(counts)
    counted = joined.withColumn("first_draw", draw(seed, F.col("key"), 0)).select("row", "key", counts.alias("mix_copies")).where("mix_copies > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.when(F.col("mix_copies") > 0, F.sequence(F.lit(0), F.col("mix_copies") - 1))))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit("order"), "key", F.col("mix_copy").cast("string"))))
    return copies.select(*(F.col("row").getField(c).alias(c) for c in own), "mix_copy", "mix_copies", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that sources weigh by the square root of their size; nulls, repeats and an empty table as in ``mixed``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs, target_rates(docs))


SQL = """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sum(n) OVER () * sqrt(n) / sum(sqrt(n)) OVER () / n AS rate FROM n),
p AS (SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts FROM r),
s(source, parts, mean, k, p, sums) AS (
  SELECT source, parts, rate / parts, 0, exp(-(rate / parts)), exp(-(rate / parts)) FROM p
  UNION ALL
  SELECT source, parts, mean, k + 1, p * mean / (k + 1), sums + p * mean / (k + 1) FROM s WHERE k < 96
),
a AS (SELECT source, any_value(parts) AS parts, list(sums ORDER BY k) AS sums FROM s GROUP BY source),
c AS (
  SELECT d.*, list_sum(list_transform(range(0, a.parts), lambda j:
           len(list_filter(a.sums, lambda c: c <= ('0x' || substr(md5('17/' || d.doc_id || '/' || j), 1, 13))::BIGINT / 4503599627370496.0))))::INT AS mix_copies
  FROM documents d JOIN a ON d.source IS NOT DISTINCT FROM a.source
),
e AS (SELECT c.*, unnest(range(0, mix_copies))::INT AS mix_copy FROM c)
SELECT doc_id, text, lang, source, n_chars, mix_copy, mix_copies, md5('17/order/' || doc_id || '/' || mix_copy) AS mix_key FROM e
"""
