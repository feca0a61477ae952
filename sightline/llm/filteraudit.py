"""Filter interaction audit: what every order of five filters keeps, removes and loses, from the survivors of the subsets of filters."""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, written

#: The filters, each by its letter; a subset is a number with bit i for the i-th.
FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_MEASURES = ("docs", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failures that a text decides alone: under 50 words, few distinct words, many capitals, odd signs.  A text without words fails A only."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A to E, good, toxic) for every row of ``docs``; null texts and parts are empty.

    E: some row of a smaller identifier has the same text.  A row without an identifier ranks after all that have one, and rows that share
    one, or have none, don't fail for each other.  A document is good (toxic) if any of its labels says quality (toxic) 1; labels
    without an identifier say nothing.  Texts are told apart by SHA-256.  Columns of other names are not read.

    Texts are read once.  Copies are counted partially before they are shuffled; the narrow rows then meet the least identifier of texts
    that repeat, and the labels, each broadcast if counted few, else in a join whose hot keys Spark splits.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("print"),
        *(c.alias(f) for f, c in text_failures(text).items()),
    )
    rows = written(rows, "failures")
    repeated = rows.groupBy("print").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").select("print", "first")
    rows = looked_up(rows, written(repeated, "repeated"), ["print"], "left")
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    own = own.agg(*(F.max((F.col(c) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    rows = looked_up(rows, written(own, "labels"), ["id"], "left")
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return rows.select("part", *"ABCD", copy.alias("E"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")))


def survivors(failed: DataFrame) -> DataFrame:
    """(part, subset, docs, good, toxic): the rows of each part that fail none of the subset; subsets that nothing survives have no row.

    A cube over part and flags: the row of a grouping set whose flags are all false counts the survivors of that subset of
    filters.  Rows are counted by part and flags first, so the cube sees 32 rows a part at most.
    """
    counts = failed.groupBy("part", *FILTERS).agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    cube = counts.cube("part", *FILTERS).agg(
        *(F.sum(m).alias(m) for m in _MEASURES), F.grouping("part").alias("whole"),
        sum(((1 - F.grouping(f)) * (1 << i) for i, f in enumerate(FILTERS)), F.lit(0)).cast("int").alias("subset"),
    )
    none_failed = [~F.coalesce(F.col(f), F.lit(False)) for f in FILTERS]
    return cube.where((F.col("whole") == 0) & none_failed[0] & none_failed[1] & none_failed[2] & none_failed[3] & none_failed[4]).select("part", "subset", *_MEASURES)


def effects(alive: DataFrame) -> DataFrame:
    """(part, filter, before, kept, removed, good_lost, toxic_lost) for each filter and each subset applied before it: a subset and the next one, side by side."""
    pairs = alive.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("before"))
    pairs = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("filter")).where("(before & shiftleft(1, filter)) = 0")
    pairs = pairs.withColumn("after", F.expr("before | shiftleft(1, filter)"))
    for side in ("before", "after"):
        pairs = pairs.join(alive.select("part", F.col("subset").alias(side), F.struct(*_MEASURES).alias(f"{side}_of")), ["part", side], "left")
    count = lambda side, m: F.coalesce(F.col(f"{side}_of.{m}"), F.lit(0))
    lost = [(count("before", m) - count("after", m)).alias(to) for m, to in zip(_MEASURES, ("removed", "good_lost", "toxic_lost"), strict=True)]
    return pairs.select("part", "filter", "before", count("after", "docs").alias("kept"), *lost)


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, zeros included; odd rows as in ``failures``.  Of an empty table nothing.

    A filter's share of the sum over all orders is its removals after each subset times the orders that begin so.
    """
    spark, n = docs.sparkSession, len(FILTERS)
    each = written(effects(written(survivors(failures(docs, labels, id_col, text_col, part_col)), "survivors")), "effects")
    size = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), size + 1)
    whole = each.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * orders).cast("long").alias("shapley"),
        F.max(F.when(size == 0, F.col("removed"))).alias("fails"), F.max(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"),
    )
    steps = ", ".join(
        f"('{''.join(FILTERS[f] for f in order)}', {k + 1}, {f}, {sum(1 << g for g in order[:k])})" for order in permutations(range(n)) for k, f in enumerate(order)
    )
    steps = spark.sql(f"SELECT * FROM VALUES {steps} AS t(filter_order, step, filter, before)")  # 600 rows
    rows = each.join(whole, ["part", "filter"]).join(F.broadcast(steps), ["filter", "before"])
    return rows.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by source, through the five filters in all 120 orders; odd rows as in ``failures``."""
    return audited(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': t.doc_id > min(t.doc_id) OVER (PARTITION BY text)} AS fails
  FROM t LEFT JOIN l ON l.doc_id = t.doc_id),
p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, string_split(filter_order[:step - 1], '') AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, letter, n, good, toxic, fails[letter] AS now, len(list_filter(earlier, lambda e: e <> '' AND fails[e])) > 0 AS gone,
    len(list_filter(map_values(fails), lambda v: v)) = 1 AS alone FROM p, s),
a AS (SELECT part, filter_order, step, letter,
    sum(n) FILTER (WHERE NOT gone AND NOT now) AS kept, sum(n) FILTER (WHERE NOT gone AND now) AS removed, sum(n) FILTER (WHERE gone AND now) AS redundant,
    sum(n) FILTER (WHERE now AND alone) AS unique_fails, sum(good) FILTER (WHERE NOT gone AND now) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND now) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM a
"""
