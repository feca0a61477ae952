"""Queries that write sites to files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import sites as S
from ..registry import query
from ..sources import files, kml
from ..sources import tables as T
from .detections import geodesic_sql
from .sitework import RADIUS


_CSV = """SELECT CASE WHEN site_id % 10 = 1 THEN name || ', "south"' WHEN site_id % 10 = 2 THEN name || chr(10) || 'line' ELSE name END AS name, latitude, longitude,
 'clampToGround' AS altitude_mode, 0.0::DOUBLE AS input_altitude, CASE WHEN site_id % 4 = 0 OR site_id % 10 = 2 THEN 10.0 ELSE height END::DOUBLE AS height FROM sites WHERE site_id % 9 <> 0"""


def _write_csv(spark, sf_dir, path):
    """Three kinds of files: as usual, with other column order and doubled quotes, and with line breaks in quotes and no height."""
    s = T.sites(spark, sf_dir)
    lat = F.when(F.col("site_id") % 9 == 0, "north").otherwise(F.col("latitude").cast("string"))
    own = F.when(F.col("site_id") % 4 == 0, "none").otherwise(F.col("height").cast("string"))
    kind = lambda k: s.where(k)
    options = {"header": True, "escape": '"', "quoteAll": True}
    kind("site_id % 10 NOT IN (1, 2)").select(F.col("name").alias("Name"), lat.alias("LAT"), F.col("longitude").alias("Lon"), own.alias("Height_AGL")).write.mode("append").option("header", True).csv(path)
    kind("site_id % 10 = 1").select(F.col("longitude").alias(" longitude "), own.alias("height_agl"), F.concat("name", F.lit(', "south"')).alias("name"), lat.alias("latitude")).write.mode("append").options(**options).csv(path)
    kind("site_id % 10 = 2").select(lat.alias("lat"), F.concat("name", F.lit("\nline")).alias("NAME"), F.col("longitude").alias("lon")).write.mode("append").options(**options).csv(path)


@query(f"WITH {T.SITES} {_CSV}")
def csv_sites(spark, sf_dir):
    """Sites through CSV files of three headers in one folder, some with a height or a place that is no number."""
    path = files.scratch(spark, "sites-csv")
    _write_csv(spark, sf_dir, path)
    return files.read_csv_sites(spark, path, 10.0)


@query(f"""WITH {T.SITES} {_CSV} UNION ALL SELECT name, latitude, longitude, altitude_mode, input_altitude,
 CASE WHEN altitude_mode <> 'clampToGround' AND input_altitude IS NOT NULL THEN 0.0 ELSE 10.0 END::DOUBLE AS height FROM sites""")
def folder_sites(spark, sf_dir):
    """Sites of a folder that holds CSV and KML files, as a bag."""
    path = files.scratch(spark, "sites-folder")
    _write_csv(spark, sf_dir, path)
    s = T.sites(spark, sf_dir)
    at = F.concat_ws(",", F.col("longitude").cast("string"), F.col("latitude").cast("string"), F.col("input_altitude").cast("string"))
    marks = F.concat(F.lit("<Placemark><name>"), text.escaped(F.col("name")), F.lit("</name><Point><altitudeMode>"), "altitude_mode", F.lit("</altitudeMode><coordinates>"), at, F.lit("</coordinates></Point></Placemark>"))
    kml.write_files(s.select(F.concat(F.lit("s"), F.pmod("site_id", F.lit(4)), F.lit(".kml")).alias("filename"), marks.alias("mark")).groupBy("filename").agg(kml.document(F.lit("sites"), F.array_join(F.array_sort(F.collect_list("mark")), "")).alias("content")), path)
    return files.read_sites(spark, path, 10.0)


@query(f"""WITH {T.SITES} SELECT name, latitude, longitude, altitude_mode, input_altitude,
 CASE WHEN altitude_mode <> 'clampToGround' AND input_altitude IS NOT NULL THEN 0.0 ELSE 10.0 END::DOUBLE AS height FROM sites""")
def kml_sites(spark, sf_dir):
    """Sites through KML files, one folder for each altitude mode."""
    path = files.scratch(spark, "sites-kml")
    s = T.sites(spark, sf_dir)
    at = files.point(F.col("longitude"), F.col("latitude"), F.col("altitude_mode"), F.col("input_altitude"))
    files.write_kml(s.select(F.col("altitude_mode").alias("filename"), "name", at.alias("Point")), path)
    return files.read_kml_sites(spark, path, 10.0).select("name", "latitude", "longitude", "altitude_mode", "input_altitude", "height")


_BOX_SITE = "site_id, name, longitude, latitude, floor(longitude / 0.05)::BIGINT AS c, floor(latitude / 0.05)::BIGINT AS r"


def _outlined(spark, sf_dir):
    """Two squares round each site, one with a hole: the outline and what a viewer is told of it."""
    s = T.sites(spark, sf_dir).withColumn("c", F.floor(F.col("longitude") / 0.05)).withColumn("r", F.floor(F.col("latitude") / 0.05))

    def square(dc: int, dr: int, size: int):
        corner = lambda i, j: F.struct(((F.col("c") + dc + i) * 0.05).alias("lon"), ((F.col("r") + dr + j) * 0.05).alias("lat"))
        return F.array(corner(0, 0), corner(size, 0), corner(size, size), corner(0, size), corner(0, 0))

    polygons = F.array(F.array(square(-3, -3, 7), square(-1, -1, 2)), F.array(square(6, 0, 2)))
    title = F.concat("name", F.lit(" <&> seen"))
    sensor = F.struct("name", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.lit("ff10a0e0").alias("icon_color"), F.lit(1.25).alias("icon_scale"), F.lit(None).cast("string").alias("icon_href"))
    style = F.struct(F.lit("#0a5f80").alias("line_color"), F.lit(3.0).alias("line_width"), F.when(F.col("site_id") % 2 == 0, "#b04020").alias("fill_color"), F.lit(0.4).alias("fill_opacity"))
    metadata = F.create_map(F.lit("Sensor"), "name", F.lit("Ground & height"), F.concat(F.coalesce(F.col("ground").cast("int").cast("string"), F.lit("?")), F.lit(" m")))
    name = F.concat(F.lit("0_cover-S"), F.col("site_id").cast("string"), F.lit("-tgt_alt_150m_AGL.kml"))
    return s.select("site_id", name.alias("filename"), title.alias("title"), F.lit(150.0).alias("altitude"), polygons.alias("polygons"), F.array(sensor).alias("sensors"), style.alias("style"), metadata.alias("metadata"), kml.height_mode(F.lit("absolute"), F.lit("agl")).alias("mode"), "name", "longitude", "latitude")


@query(f"""WITH {T.SITES}, b AS (SELECT {_BOX_SITE} FROM sites)
SELECT '0_cover-S' || site_id || '-tgt_alt_150m_AGL.kml' AS file, NULL::VARCHAR AS folder_name, name AS sensor_name, longitude AS lon, latitude AS lat, 2 AS polygons, 3 AS rings, round((c + 8) * 0.05, 6) AS east, round((r - 3) * 0.05, 6) AS south,
 '#0a5f80' AS line_color, CASE WHEN site_id % 2 = 0 THEN '#b04020' ELSE '#000000' END AS fill_color, 'ff10a0e0' AS icon_color, 3.0::DOUBLE AS line_width FROM b""")
def viewshed_kml_roundtrip(spark, sf_dir):
    """Outlines with holes written as KML files, one a site, and read back with their sensors and styles."""
    path = files.scratch(spark, "outlines")
    kml.write_files(kml.coverage_documents(_outlined(spark, sf_dir)), path)
    back = kml.read_coverage(spark, path)
    points = F.flatten(F.flatten("polygons"))
    return back.select(
        "file", "folder_name", "sensor_name", "sensor.lon", "sensor.lat", F.size("polygons").alias("polygons"), F.aggregate("polygons", F.lit(0), lambda n, p: n + F.size(p)).alias("rings"),
        F.round(F.array_max(F.transform(points, lambda p: p["lon"])), 6).alias("east"), F.round(F.array_min(F.transform(points, lambda p: p["lat"])), 6).alias("south"),
        F.col("style")["line_color"].alias("line_color"), F.col("style")["fill_color"].alias("fill_color"), F.col("style")["icon_color"].alias("icon_color"), F.col("style")["line_width"].cast("double").alias("line_width"),
    )


@query(f"""WITH {T.SITES} SELECT '0_cover-S' || site_id || '-tgt_alt_150m_AGL.kml' AS file, name AS sensor, coalesce(ground::INTEGER::VARCHAR, '?') || ' m' AS told FROM sites UNION ALL SELECT 'broken.kml', NULL, NULL""")
def kml_metadata(spark, sf_dir):
    """Metadata of written outlines; a file that is no KML tells nothing and stops nothing."""
    path = files.scratch(spark, "metadata")
    documents = kml.coverage_documents(_outlined(spark, sf_dir))
    kml.write_files(documents.unionByName(documents.limit(1).select(F.lit("broken.kml").alias("filename"), F.lit("<kml><Document>").alias("content"))), path)
    return kml.read_metadata(spark, path).select("file", F.col("metadata")["Sensor"].alias("sensor"), F.col("metadata")["Ground & height"].alias("told"))


@query(f"""WITH {T.SITES} SELECT 'S' || site_id AS file, 0 AS outlines, TRUE AS failed FROM sites WHERE site_id % 4 = 1 UNION ALL SELECT '0_cover-S' || site_id || '-tgt_alt_150m_AGL.kml', 2, FALSE FROM sites""")
def broken_files(spark, sf_dir):
    """Outlines read from a folder in which some files are cut off: those are told, the others read."""
    path = files.scratch(spark, "broken")
    documents = kml.coverage_documents(_outlined(spark, sf_dir))
    kml.write_files(documents, path)
    s = T.sites(spark, sf_dir).where("site_id % 4 = 1")
    kml.write_files(s.select(F.concat(F.lit("S"), F.col("site_id").cast("string")).alias("filename"), F.when(F.col("site_id") % 8 == 1, "<kml><Docu").otherwise("no xml").alias("content")), path)
    return kml.read_coverage(spark, path).select("file", F.coalesce(F.size("polygons"), F.lit(0)).alias("outlines"), F.col("error").isNotNull().alias("failed"))


@query(f"""WITH {T.SITES}, a AS (SELECT site_id, name, unnest([100.0, 1000.0])::DOUBLE AS alt FROM sites)
SELECT 'network' || site_id % 5 || '.kml' AS file, name AS folder_name, name AS sensor_name, site_id, 2 AS outlines FROM a WHERE alt = 100""")
def combined_kml(spark, sf_dir):
    """Files of several sensors with two outlines each, a folder for each sensor."""
    o = _outlined(spark, sf_dir).withColumn("altitude", F.explode(F.array(F.lit(100.0), F.lit(1000.0))))
    rows = o.select(F.concat(F.lit("network"), F.col("site_id") % 5, F.lit(".kml")).alias("filename"), F.lit("All").alias("title"), F.col("name").alias("sensor"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), F.concat(F.lit("site "), "site_id").alias("description"), F.col("site_id").alias("ordinal"), "altitude", "polygons", "style", "metadata")
    path = files.scratch(spark, "combined")
    kml.write_files(kml.combined_documents(rows), path)
    back = kml.read_coverage(spark, path)
    return back.join(T.sites(spark, sf_dir).select("name", "site_id"), F.col("sensor_name") == F.col("name")).select("file", "folder_name", "sensor_name", "site_id", F.size("polygons").alias("outlines"))


_RINGS = f"""{T.SITES}, h AS (SELECT *, coalesce(ground, CASE WHEN altitude_mode = 'absolute' THEN input_altitude END, 0) AS g FROM sites),
r AS (SELECT site_id, name, latitude, longitude, sqrt(2 * {RADIUS} * CASE altitude_mode WHEN 'relativeToGround' THEN g + coalesce(input_altitude, 0) + height WHEN 'absolute' THEN coalesce(nullif(input_altitude, 0), g) + height ELSE g + height END) + sqrt(2 * {RADIUS} * 100.0) AS dist FROM h)"""


def _horizons(spark, sf_dir):
    s = T.sites(spark, sf_dir)
    rings = S.horizon_rings(s, T.altitudes(spark, 100, 1000)).select(F.col("site_id").alias("ordinal"), F.col("name").alias("sensor"), "alt_m", "dist_m")
    places = s.where("site_id % 7 <> 3").select(F.col("name").alias("sensor"), "latitude", "longitude", "ground", "height")
    style = F.struct(F.lit("#ffaa00").alias("line_color"), F.lit(1.0).alias("line_width"), F.lit(None).cast("string").alias("fill_color"), F.lit(None).cast("double").alias("fill_opacity"))
    return rings, places, style, F.create_map(F.lit("Command"), F.lit("horizon"))


@query(f"""WITH {_RINGS}, d AS (SELECT * REPLACE (CASE WHEN site_id % 7 = 3 THEN 0 ELSE latitude END AS latitude, CASE WHEN site_id % 7 = 3 THEN 0 ELSE longitude END AS longitude) FROM r)
SELECT name AS folder_name, longitude AS lon, latitude AS lat, 181 AS points, round(lon2, 6) AS east, round(lat2, 6) AS north FROM ({geodesic_sql("SELECT site_id, name, latitude, longitude, 90.0::DOUBLE AS az, dist FROM d")}) JOIN (SELECT site_id AS i, 0 AS z FROM sites) q ON q.i = site_id""")
def horizon_kml_roundtrip(spark, sf_dir):
    """Horizons written as one KML file, a folder for each sensor, and read back: the lowest target's ring; a sensor of unknown place stands at 0, 0."""
    path = files.scratch(spark, "horizons")
    kml.write_files(kml.horizon_documents(*_horizons(spark, sf_dir)), path)
    ring = F.col("polygons")[0][0]
    return kml.read_coverage(spark, path).select("folder_name", "sensor.lon", "sensor.lat", F.size(ring).alias("points"), F.round(ring[45]["lon"], 6).alias("east"), F.round(ring[45]["lat"], 6).alias("north"))


@query(f"""WITH {_RINGS} SELECT printf('%02d', row_number() OVER (ORDER BY site_id)) || '_horizon-' || regexp_replace(name, '[^A-Za-z0-9_.-]', '_', 'g') || '.kml' AS file, name AS sensor FROM r""")
def horizon_files(spark, sf_dir):
    """Horizons as one file a sensor, numbered in order of the input."""
    path = files.scratch(spark, "horizon-files")
    rings, places, style, metadata = _horizons(spark, sf_dir)
    kml.write_files(kml.horizon_documents(rings, places, style, metadata, export_mode="absolute", by_sensor=True), path)
    return kml.read_metadata(spark, path).select("file", F.col("metadata")["Sensor Name"].alias("sensor"))


@query(f"""WITH {T.SITES} SELECT 'S' || site_id || '.kml' AS file, name AS title, 5 AS points FROM sites""")
def bare_polygons(spark, sf_dir):
    """Outlines alone, without sensors, as files that site and style scans can read."""
    o = _outlined(spark, sf_dir).select(F.concat(F.lit("S"), "site_id", F.lit(".kml")).alias("filename"), F.col("name").alias("title"), "altitude", "polygons", "style")
    path = files.scratch(spark, "bare")
    kml.write_files(kml.polygon_documents(o), path)
    marks = spark.read.format("xml").option("rowTag", "Placemark").schema("name STRING, MultiGeometry STRUCT<Polygon: ARRAY<STRUCT<altitudeMode: STRING, outerBoundaryIs: STRUCT<LinearRing: STRUCT<coordinates: STRING>>>>>").load(path + "/*")
    first = F.split(F.trim(F.col("MultiGeometry.Polygon")[0]["outerBoundaryIs"]["LinearRing"]["coordinates"]), " ")
    return marks.select(kml.name_of(F.col("_metadata.file_path")).alias("file"), F.col("name").alias("title"), F.size(first).alias("points"))
