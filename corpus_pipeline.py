"""A corpus in five stages: language ID, exact dedup, near dedup, mixing of sources, and SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import dedup, jaccard, langid, mixing, pieces
from sightline.llm.common import looked_up, shared_folder, workspace, written

#: A text whose language is less likely than so many times a chance guess among the languages learned is rejected.
MARGIN = 1.2


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` as a written table with a row key in one more column, and that column's name: decisions are for rows, whatever identifiers hold."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def _without(keyed: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``keyed`` without the rows whose keys are in ``gone`` (one column), and without the key."""
    gone = written(gone.toDF(key), "gone")
    return looked_up(keyed, gone, [key], "left_anti").drop(key)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those in no language that the labelled texts teach.

    Null and empty texts go; null identifiers, repeated rows and columns of any names are kept or go by their own texts; nothing
    is cut from long texts.  Where nothing can be learned every row with a text goes too, as no language is known; of an empty table nothing is left.
    """
    found = langid.identified(docs, ~langid.held_out(), keep=True)
    fine = (F.col("lang_pred") != langid.UND) & ((F.col("languages") == 1) | (F.col("score") * F.col("languages") >= MARGIN))
    return found.where(fine).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, a null as an empty one) the row with the largest identifier stays.

    Rows without an identifier rank last, and of rows that tie one stays; of each text exactly one row is left, however many repeat it.
    """
    keyed, key = _keyed(docs)
    rows = keyed.select(F.struct("doc_id", key).alias("id"), "text")
    return _without(keyed, key, dedup.exact_groups(rows, "id").where("NOT kept").select(f"id.{key}"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest identifier stays; rows without one rank last, ties go to one row.

    Texts without words are near to nothing, so they all stay.
    """
    keyed, key = _keyed(docs)
    found = written(jaccard.near_groups(keyed, key).select(F.col(key).alias("key"), "component_id"), "near")
    groups = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    members = written(looked_up(found, written(groups, "groups"), ["component_id"]), "members")
    ranked = looked_up(keyed.select(F.col(key).alias("key"), "doc_id"), members, ["key"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    stays = written(ranked.groupBy("component_id").agg(first.alias("key")).select("key"), "stays")
    return _without(keyed, key, members.select("key").join(stays, "key", "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target weights; each row, with or without an identifier, has a draw of its own."""
    return mixing.mixed(docs, mixing.target_rates(docs)).select(*(F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as piece ids, with the digest that shows that decoding gives the text; a null text has null ids and digest."""
    rows = pieces.encoded(docs.select("doc_id", "source", "text"), decode_as="decoded")
    return rows.select(
        "doc_id", "source", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "piece_ids", F.sha2("decoded", 256).alias("text_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mix), ("SentencePiece", encode)]
#: Trained models and sampled pieces are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents, each written and read again; what a stage writes on the way is deleted."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        with workspace(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage{k}", folder)
    return docs
