"""Sensor sites in CSV and KML files: readers, style lookups and writers."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import css_color

MODES = ("clampToGround", "relativeToGround", "absolute")
_POINT = "STRUCT<altitudeMode: STRING, coordinates: STRING>"
_COLOR = "STRUCT<color: STRING, scale: DOUBLE, width: DOUBLE>"
_STYLE = f"IconStyle {_COLOR}, LineStyle {_COLOR}, PolyStyle {_COLOR}"
_STYLE_STRUCT = f"STRUCT<IconStyle: {_COLOR}, LineStyle: {_COLOR}, PolyStyle: {_COLOR}>"


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in a folder of our own only where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sightline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: cuts the lineage."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of narrow rows, marked for a broadcast if a count says that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """Rows that become many, dealt out over all tasks first: a file of few bytes is read by one task, and few bytes are put back together by AQE unless a number is given."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows' places from 1 in an order, by ranges: places within each and the counts of those before, so no task has all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = saved(ranged.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))  # a row for each range
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return rows.join(F.broadcast(starts), "__range").withColumn(name, F.col("__at") - F.col("__first") + F.col("__start") + 1).drop("__range", "__at", "__first", "__start")


def _found(spark: SparkSession, glob: str) -> bool:
    """Whether a file system has anything of such a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def _headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The files under a path by their first line: a row for each header comes to the driver, with its files' names."""
    given = [path] if isinstance(path, str) else path
    paths = [q for p in given for q in ([f"{p.rstrip('/')}/*.csv"] if _found(spark, f"{p.rstrip('/')}/*.csv") else [p] if p.endswith(".csv") else [])]
    if not paths:
        return {}
    files = spark.read.format("binaryFile").load(paths).where("length > 0")
    first = F.regexp_extract(F.decode(F.substring("content", 1, 1 << 16), "UTF-8"), r"^([^\r\n]*)", 1)
    found = files.select(first.alias("header"), "path").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("files"))
    return {r["header"]: r["files"] for r in found.collect()}


def read_csv_sites(spark: SparkSession, path: str | list[str], height: float) -> DataFrame:
    """Sites (name, latitude, longitude, altitude_mode, input_altitude, height) of CSV files, or of the CSV files in a folder.

    Files of different headers are read apart, so columns may come in any order.  Headers are compared without a byte-order
    mark, surrounding space and case; lat and lon stand for latitude and longitude.  Quotes are doubled within quotes, where
    line breaks may stand too.  Rows without a number for either place are left out, and so are all rows of a file where a needed
    column is missing.  A missing or bad height_agl is ``height``.  Sites of a CSV stand on the ground.
    """
    parts = [_csv_sites(spark, files, height) for _, files in sorted(_headers(spark, path).items())]
    if not parts:
        return spark.createDataFrame([], "name string, latitude double, longitude double, altitude_mode string, input_altitude double, height double")
    return reduce(DataFrame.unionByName, parts)


def _csv_sites(spark: SparkSession, path: list[str], height: float) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    have = {c.removeprefix("\ufeff").strip().lower(): F.col(f"`{c}`") for c in raw.columns}
    column = lambda *names: next((have[n] for n in names if n in have), None)
    name, lat, lon, own = column("name"), column("latitude", "lat"), column("longitude", "lon"), column("height_agl")
    number = lambda c: F.lit(None).cast("double") if c is None else F.trim(c).try_cast("double")
    rows = raw.select(
        F.trim(F.coalesce(name, F.lit(""))).alias("name") if name is not None else F.lit(None).cast("string").alias("name"),
        number(lat).alias("latitude"), number(lon).alias("longitude"), F.lit(MODES[0]).alias("altitude_mode"),
        F.lit(0.0).alias("input_altitude"), F.coalesce(number(own), F.lit(float(height))).alias("height"),
    )
    return rows.where("name IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")


def read_sites(spark: SparkSession, folder: str, height: float) -> DataFrame:
    """Sites of all KML files and then all CSV files right in a folder, with those columns of ``read_csv_sites``; either kind may be missing."""
    columns = ["name", "latitude", "longitude", "altitude_mode", "input_altitude", "height"]
    glob = f"{folder.rstrip('/')}/*.kml"
    kml = [read_kml_sites(spark, glob, height).select(columns)] if _found(spark, glob) else []
    return reduce(DataFrame.unionByName, [*kml, read_csv_sites(spark, folder, height)])


def _xml(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def read_kml_sites(spark: SparkSession, path: str | list[str], height: float) -> DataFrame:
    """Sites of the placemarks with a point: the columns of ``read_csv_sites``, description, style_url, own_style and file.

    A file is read by one task, a placemark at a time.  A placemark without a point, or whose longitude or latitude
    is no number, is left out.  A name that is missing is "Unnamed", an unknown altitude mode
    clampToGround.  A site with an altitude that isn't clamped has that as its whole height: its own height is 0.
    """
    raw = _xml(spark, path, "Placemark", f"name STRING, description STRING, styleUrl STRING, Style {_STYLE_STRUCT}, Point {_POINT}, MultiGeometry STRUCT<Point: ARRAY<{_POINT}>>")
    point = F.coalesce("Point", F.get("MultiGeometry.Point", F.lit(0)))
    part = lambda i: F.get(F.split(F.trim("at.coordinates"), ","), F.lit(i)).try_cast("double")
    mode, given = F.trim("at.altitudeMode"), F.nullif(F.trim("name"), F.lit(""))
    rows = raw.withColumn("at", point).select(
        F.coalesce(given, F.lit("Unnamed")).alias("name"), part(1).alias("latitude"), part(0).alias("longitude"),
        F.when(mode.isin(*MODES), mode).otherwise(MODES[0]).alias("altitude_mode"), part(2).alias("input_altitude"),
        F.trim("description").alias("description"), F.trim("styleUrl").alias("style_url"), F.col("Style").alias("own_style"), "file",
    )
    own = F.col("altitude_mode").isin(*MODES[1:]) & F.col("input_altitude").isNotNull()
    return rows.where("latitude IS NOT NULL AND longitude IS NOT NULL").withColumn("height", F.when(own, 0.0).otherwise(float(height)))


def read_kml_styles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, style_url, shared_style): shared styles by their reference, and style maps by that of their normal style; one step, no more."""
    styles = _xml(spark, path, "Style", f"_id STRING, {_STYLE}").where("_id IS NOT NULL")
    styles = styles.select("file", F.concat(F.lit("#"), "_id").alias("style_url"), F.struct("IconStyle", "LineStyle", "PolyStyle").alias("shared_style"))
    maps = _xml(spark, path, "StyleMap", "_id STRING, Pair ARRAY<STRUCT<key: STRING, styleUrl: STRING>>").where("_id IS NOT NULL")
    normal = F.get(F.filter("Pair", lambda p: F.trim(p["key"]) == "normal"), F.lit(0))["styleUrl"]
    maps = maps.select("file", F.concat(F.lit("#"), "_id").alias("map_url"), F.trim(normal).alias("style_url"))
    through = maps.join(styles, ["file", "style_url"]).select("file", F.col("map_url").alias("style_url"), "shared_style")
    return styles.unionByName(through)


def styled(sites: DataFrame, styles: DataFrame) -> DataFrame:
    """KML sites with a style of their own or the one they refer to: colours as #rrggbb, fill opacity, icon scale, line width; null where neither tells."""
    rows = sites.join(styles.dropDuplicates(["file", "style_url"]), ["file", "style_url"], "left")
    pick = lambda path: F.coalesce(F.col(f"own_style.{path}"), F.col(f"shared_style.{path}"))
    return rows.select(
        *sites.columns, pick("IconStyle.color").alias("icon_color"), pick("IconStyle.scale").alias("icon_scale"),
        css_color(pick("LineStyle.color"))["color"].alias("line_color"), pick("LineStyle.width").alias("line_width"),
        css_color(pick("PolyStyle.color"))["color"].alias("fill_color"), css_color(pick("PolyStyle.color"))["opacity"].alias("fill_opacity"),
    )


def point(lon: Column, lat: Column, mode: Column, altitude: Column) -> Column:
    """A site's place as the Point of a placemark."""
    at = F.concat_ws(",", lon.cast("string"), lat.cast("string"), altitude.cast("string"))
    return F.struct(mode.alias("altitudeMode"), at.alias("coordinates"))


def write_kml(placemarks: DataFrame, path: str, by: str = "filename") -> None:
    """KML files of placemarks (by, and what a placemark holds: name, description, styleUrl, Point), in one folder ``by=value`` for each output.

    Each task writes its own whole file, its placemarks side by side under the root, so nothing is gathered.
    """
    root = 'kml xmlns="http://www.opengis.net/kml/2.2"'
    placemarks.write.format("xml").option("rootTag", root).option("rowTag", "Placemark").partitionBy(by).save(path)
