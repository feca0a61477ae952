"""Sensor inputs derived from the test tables by whole-number formulas: strictly synthetic, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expressions of the site table; Spark and DuckDB read them alike.
_SITE = {
    "site_id": "s_suppkey",
    "name": "s_name",
    "latitude": "CAST((s_suppkey * 7919) % 14000 AS DOUBLE) / 100 - 70",
    "longitude": "CAST((s_suppkey * 104729) % 34000 AS DOUBLE) / 100 - 170",
    "altitude_mode": "CASE s_suppkey % 3 WHEN 0 THEN 'clampToGround' WHEN 1 THEN 'relativeToGround' ELSE 'absolute' END",
    "input_altitude": "CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST((s_suppkey * 13) % 300 AS DOUBLE) END",
    "height": "CAST(5 + s_suppkey % 50 AS DOUBLE)",
    "ground": "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST((s_suppkey * 37) % 900 AS DOUBLE) END",
}
_TILE = {
    "id": "'tile' || CAST(c_custkey AS VARCHAR(20))",
    "ordinal": "c_custkey",
    "min_lon": "CAST((c_custkey * 31) % 340 AS DOUBLE) - 170.0",
    "min_lat": "CAST((c_custkey * 17) % 140 AS DOUBLE) - 70.0",
    "max_lon": "CAST((c_custkey * 31) % 340 AS DOUBLE) - 169.0 + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END",
    "max_lat": "CAST((c_custkey * 17) % 140 AS DOUBLE) - 69.0",
    "score": "CASE c_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END",
    "cached": "c_custkey % 4 = 0",
    "elevation": "CAST((c_custkey * 41) % 1200 AS DOUBLE)",
}
_ITEM = {
    "ordinal": "o_orderkey",
    "site_id": "o_custkey % 50",
    "filename": "'01_cover-S' || CAST(o_custkey % 50 AS VARCHAR(20)) || '-tgt_alt_' || CAST((o_orderkey % 4 + 1) * 100 AS VARCHAR(20)) || 'm' || CASE o_orderkey % 3 WHEN 0 THEN '_MSL' WHEN 1 THEN '_AGL' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '_sh_' || CAST(o_orderkey % 30 AS VARCHAR(20)) || 'm' ELSE '' END || '.kml'",
    "lon": "CAST(o_custkey % 50 AS DOUBLE) / 8.0",
    "lat": "CAST(o_custkey % 50 AS DOUBLE) / 16.0",
}


def _sql(name: str, table: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {table})"


SITES, TILES, ITEMS = _sql("sites", "supplier", _SITE), _sql("tiles", "customer", _TILE), _sql("items", "orders", _ITEM)


def _read(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{v} AS {k}" for k, v in columns.items()))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier", _SITE)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 1 or 2 degrees by 1; several may cover the same square."""
    return _read(spark, sf_dir, "customer", _TILE)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier outputs, by file name."""
    return _read(spark, sf_dir, "orders", _ITEM)


def altitudes(spark: SparkSession, *values: float) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*(F.lit(float(v)) for v in values or (10, 100, 1000, 10000)))).alias("alt_m"))
