"""Line dedup: lines that many documents hold are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, lower_ascii, written

#: White space that is no part of a line's key.
SPACES = " \t\n\v\f\r"


def line_prints(lines: Column, min_chars: int) -> Column:
    """For an array of lines, the 128-bit digests (hex) of their keys: stripped of white space at both ends, A-Z in lower case; null for a shorter key."""

    def print_of(line: Column) -> Column:
        key = F.btrim(line, F.lit(SPACES))
        return F.when(F.char_length(key) >= min_chars, F.md5(lower_ascii(key)))

    return F.transform(lines, print_of)


def frequent_prints(prints: DataFrame, min_docs: int) -> DataFrame:
    """(print) for rows (prints, an array): those found in so many rows or more.

    A row counts a digest once, as repeats within it go before the explosion; what is shuffled is a partial count for each digest and
    task, so a line in a third of all documents costs no more than any other.
    """
    single = prints.select(F.explode(F.array_distinct("prints")).alias("print")).where("print IS NOT NULL")
    return single.groupBy("print").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("print")


def without_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(id, n_lines, n_dropped, text) for every row: its text without the lines whose key ``min_docs`` rows or more hold.

    Lines end at \\n only.  A line's key is the line without white space at both ends, A-Z in lower case; keys under ``min_chars`` code
    points are kept and counted nowhere.  All lines of a frequent key go, in every row; the others stay as they were, in their order.  A null text is an
    empty one, which is one empty line.  Each row is a document, whatever its identifier: rows that repeat one, or have none,
    count one by one.  Other columns are not read, so their names can't clash.

    Rows get a key in a written table.  Lines are exploded as (row, position, digest) and meet the frequent digests, which are
    broadcast if counted few, else shuffled.  A row's dropped positions then cut its text into the runs of lines between them; so texts
    are shuffled once, by row, and no task needs more than one text at a time.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = written(rows, "lines")
    prints = rows.select("row", line_prints(F.split("text", "\n"), min_chars).alias("prints"))
    frequent = written(frequent_prints(prints, min_docs), "frequent")
    placed = prints.select("row", F.posexplode("prints").alias("at", "print"))
    dropped = looked_up(placed, frequent, ["print"]).groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("dropped"))
    dropped = written(dropped, "dropped")
    # Alike at every size: by a hash table of the positions, so that texts are neither sorted nor left where they are because few lines are dropped.
    joined = rows.withColumn("lines", F.split("text", "\n")).drop("text").join(dropped.hint("shuffle_hash"), "row", "left")
    ends = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size("lines")))
    kept = joined.withColumn("ends", ends).withColumn(
        "kept", F.flatten(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.slice("lines", F.get("ends", k - 1) + 2, F.get("ends", k) - F.get("ends", k - 1) - 1)))
    )
    return kept.select(
        F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.coalesce("kept", "lines"), "\n").alias("text"),
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold, as its counts and digest; odd rows as in ``without_frequent_lines``."""
    kept = without_frequent_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_CUT = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_CUT}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON f.key = k.key GROUP BY doc_id
"""
