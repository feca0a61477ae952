"""Queries on detection ranges and geodesics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import earth, text
from ..operators import coverage as C
from ..operators import detection as D
from ..registry import query
from ..sources import files, kml
from ..sources import tables as T
from ..sources.named import in_folders

#: Degrees of a cell.
RES = 0.05

_PARSED = f"""{T.ITEMS}, p AS (SELECT *, nullif(regexp_extract(filename, 'tgt_alt_([0-9]+)m', 1), '')::DOUBLE AS altitude, lower(nullif(regexp_extract(filename, 'm_(MSL|AGL)', 1), '')) AS reference,
 nullif(regexp_extract(filename, '_sh_([0-9]+)m', 1), '')::DOUBLE AS sensor_height, nullif(regexp_extract(filename, '_cover-(S[0-9]+)-', 1), '') AS sensor FROM items)"""


@query(f"WITH {_PARSED} SELECT ordinal, altitude, reference, sensor_height, sensor FROM p")
def filename_extract(spark, sf_dir):
    return D.parsed(T.items(spark, sf_dir)).select("ordinal", "altitude", "reference", "sensor_height", "sensor")


@query(f"""WITH {_PARSED}, g AS (SELECT altitude, reference, sensor_height, min(ordinal) AS first_seen, count(*) AS items FROM p GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY altitude, first_seen)::INTEGER AS group_no FROM g""")
def altitude_groups(spark, sf_dir):
    return D.grouped(D.parsed(T.items(spark, sf_dir)))


@query(f"""WITH {_PARSED}, n AS (SELECT *, row_number() OVER (PARTITION BY altitude, reference, sensor_height, lon, lat ORDER BY ordinal) - 1 AS n, count(*) OVER (PARTITION BY altitude, reference, sensor_height, lon, lat) AS here FROM p),
v AS (SELECT *, max(here) OVER (PARTITION BY altitude, reference, sensor_height) AS variants FROM n)
SELECT altitude, reference, sensor_height, s AS scenario, ordinal FROM (SELECT *, unnest(range(n, CASE WHEN n = here - 1 THEN variants ELSE n + 1 END)) AS s FROM v)""")
def variant_scenarios(spark, sf_dir):
    rows = D.scenarios(D.parsed(T.items(spark, sf_dir)), ["altitude", "reference", "sensor_height"])
    return rows.select("altitude", "reference", "sensor_height", "scenario", "ordinal")


@query(f"""WITH {_PARSED}, g AS (SELECT altitude, reference, count(DISTINCT sensor) AS sensors, string_agg(DISTINCT sensor, ', ' ORDER BY sensor) AS names FROM p GROUP BY ALL),
r AS (SELECT unnest([50.0, 100.0])::DOUBLE AS range_km)
SELECT altitude, reference, range_km, sensors, names, lpad(rank() OVER (PARTITION BY reference, range_km ORDER BY altitude)::VARCHAR, 2, '0') || '_detection_' || altitude::BIGINT || 'm_' || range_km::BIGINT || 'km' AS filename FROM g CROSS JOIN r""")
def output_names(spark, sf_dir):
    g = D.parsed(T.items(spark, sf_dir)).groupBy("altitude", "reference").agg(F.array_sort(F.collect_set("sensor")).alias("all"))  # sensors, a small set
    g = g.withColumn("range_km", F.explode(F.array(F.lit(50.0), F.lit(100.0))))
    number = F.rank().over(Window.partitionBy("reference", "range_km").orderBy("altitude")).cast("string")
    name = F.concat(F.lpad(number, 2, "0"), F.lit("_detection_"), text.label(F.col("altitude")), F.lit("m_"), text.label(F.col("range_km")), F.lit("km"))
    return g.select("altitude", "reference", "range_km", F.size("all").cast("long").alias("sensors"), F.array_join("all", ", ").alias("names"), name.alias("filename"))


def geodesic_sql(start: str) -> str:
    """Vincenty's series, one step each subquery; a constant of the method is written as in the formula."""
    a, b, f = repr(earth.A), repr(earth.B), repr(earth.FLAT)
    steps = [start, f"SELECT *, (1 - {f}) * tan(radians(latitude)) AS t, sin(radians(az)) AS sa1, cos(radians(az)) AS ca1 FROM (X)", "SELECT *, 1 / sqrt(1 + t * t) AS cu, atan2(t, ca1) AS s1 FROM (X)",
             "SELECT *, t * cu AS su, cu * sa1 AS sa, 1 - cu * sa1 * cu * sa1 AS c2a FROM (X)", f"SELECT *, c2a * (({a} * {a} - {b} * {b}) / ({b} * {b})) AS u2 FROM (X)",
             "SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS aa, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS bb FROM (X)", f"SELECT *, dist / ({b} * aa) AS s FROM (X)"]
    turn = f"SELECT * REPLACE (dist / ({b} * aa) + bb * sin(s) * (cos(2 * s1 + s) + bb / 4 * (cos(s) * (-1 + 2 * cos(2 * s1 + s) ** 2) - bb / 6 * cos(2 * s1 + s) * (-3 + 4 * sin(s) ** 2) * (-3 + 4 * cos(2 * s1 + s) ** 2))) AS s) FROM (X)"
    steps += [turn] * 5
    steps += [f"SELECT *, cos(2 * s1 + s) AS m, su * sin(s) - cu * cos(s) * ca1 AS x, atan2(sin(s) * sa1, cu * cos(s) - su * sin(s) * ca1) AS lam, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS q FROM (X)",
              f"SELECT *, degrees(atan2(su * cos(s) + cu * sin(s) * ca1, (1 - {f}) * sqrt(sa * sa + x * x))) AS lat2, longitude + degrees(lam - (1 - q) * {f} * sa * (s + q * sin(s) * (m + q * cos(s) * (-1 + 2 * m * m)))) AS lon2 FROM (X)"]
    out = steps[0]
    for step in steps[1:]:
        out = step.replace("X", out)
    return out


@query(f"WITH {T.SITES} SELECT site_id, round(lat2, 7) AS lat2, round(lon2, 7) AS lon2 FROM ({geodesic_sql('SELECT site_id, latitude, longitude, (site_id * 37 % 360)::DOUBLE AS az, 1000.0 + (site_id * 7919 % 300000) AS dist FROM sites')})")
def geodesic_direct(spark, sf_dir):
    s = T.sites(spark, sf_dir).withColumn("az", (F.col("site_id") * 37 % 360).cast("double")).withColumn("dist", 1000.0 + F.col("site_id") * 7919 % 300000)
    return earth.with_geodesic(s, "latitude", "longitude", "az", "dist").select("site_id", F.round("lat2", 7).alias("lat2"), F.round("lon2", 7).alias("lon2"))


@query(f"""WITH {T.SITES} SELECT site_id, i, round(lat2, 7) AS lat2, round(lon2, 7) AS lon2 FROM ({geodesic_sql('SELECT site_id, i::INTEGER AS i, latitude, longitude, i * 2.8125::DOUBLE AS az, 100000.0::DOUBLE AS dist FROM sites CROSS JOIN range(128) r(i)')})""")
def geodesic_circle(spark, sf_dir):
    s = T.sites(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(127)))).withColumn("az", F.col("i") * 2.8125).withColumn("dist", F.lit(100000.0))
    return earth.with_geodesic(s, "latitude", "longitude", "az", "dist").select("site_id", "i", F.round("lat2", 7).alias("lat2"), F.round("lon2", 7).alias("lon2"))


def inverse_sql(start: str, steps: int = 12) -> str:
    """The series from two places to the length and azimuth, one step each subquery, with nulls where it doesn't settle."""
    a, b, f = repr(earth.A), repr(earth.B), repr(earth.FLAT)
    sphere = ["SELECT *, sqrt((cu2 * sin(lam)) ** 2 + (cu1 * su2 - su1 * cu2 * cos(lam)) ** 2) AS ss, su1 * su2 + cu1 * cu2 * cos(lam) AS cs FROM (X)", "SELECT *, atan2(ss, cs) AS s, CASE WHEN ss = 0 THEN 0 ELSE cu1 * cu2 * sin(lam) / ss END AS sa FROM (X)",
              "SELECT *, CASE WHEN 1 - sa * sa < 1e-15 THEN 0 ELSE cs - 2 * su1 * su2 / (1 - sa * sa) END AS m, 1 - sa * sa AS c2a FROM (X)"]
    step = f"SELECT * EXCLUDE (ss, cs, s, sa, m, c2a, q) REPLACE (lam AS was, l + (1 - q) * {f} * sa * (s + q * ss * (m + q * cs * (-1 + 2 * m * m))) AS lam) FROM (SELECT *, {f} / 16 * c2a * (4 + {f} * (4 - 3 * c2a)) AS q FROM (X))"
    every = [start, f"SELECT *, (1 - {f}) * tan(radians(latitude)) AS t1, (1 - {f}) * tan(radians(lat2)) AS t2 FROM (X)", "SELECT *, 1 / sqrt(1 + t1 * t1) AS cu1, 1 / sqrt(1 + t2 * t2) AS cu2 FROM (X)",
             "SELECT *, t1 * cu1 AS su1, t2 * cu2 AS su2, radians((lon2 - longitude + 540) - 360 * floor((lon2 - longitude + 540) / 360) - 180) AS l FROM (X)", "SELECT *, l AS lam, l AS was FROM (X)"]
    every += [*sphere, step] * steps + sphere
    every += [f"SELECT *, c2a * (({a} * {a} - {b} * {b}) / ({b} * {b})) AS u2 FROM (X)", "SELECT *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) AS aa, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) AS bb FROM (X)",
              f"SELECT *, CASE WHEN abs(lam - was) < 1e-12 THEN {b} * aa * (s - bb * ss * (m + bb / 4 * (cs * (-1 + 2 * m * m) - bb / 6 * m * (-3 + 4 * ss * ss) * (-3 + 4 * m * m)))) END AS geo_m, CASE WHEN abs(lam - was) < 1e-12 THEN atan2(cu2 * sin(lam), cu1 * su2 - su1 * cu2 * cos(lam)) END AS az FROM (X)"]
    out = every[0]
    for one in every[1:]:
        out = one.replace("X)", out + ")")
    return out


@query(f"""WITH {T.SITES}, {T.TILES}, p AS (SELECT id, site_id, latitude, longitude, (min_lat + max_lat) / 2 AS lat2, (min_lon + max_lon) / 2 AS lon2 FROM tiles JOIN sites ON site_id = 1 + ordinal % (SELECT count(*) FROM sites))
SELECT id, site_id, round(geo_m, 3) AS geo_m, round(CASE WHEN az < 0 THEN az + 2 * pi() ELSE az END, 9) AS geo_az FROM ({inverse_sql('SELECT * FROM p')})""")
def geodesic_inverse(spark, sf_dir):
    """How far each tile's centre lies from a site, and in which direction, on the ellipsoid."""
    sites, tiles = T.sites(spark, sf_dir), T.tiles(spark, sf_dir)
    number = sites.agg(F.count("*").alias("sites"))  # one row
    p = tiles.join(F.broadcast(number)).withColumn("site_id", 1 + F.col("ordinal") % F.col("sites")).join(sites.select("site_id", "latitude", "longitude"), "site_id")
    p = p.select("id", "site_id", "latitude", "longitude", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("lat2"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("lon2"))
    return earth.with_inverse(p, "latitude", "longitude", "lat2", "lon2").select("id", "site_id", F.round("geo_m", 3).alias("geo_m"), F.round("geo_az", 9).alias("geo_az"))


#: Sites' outlines as squares of cells: of every site one for each altitude, and of every fifth a second, smaller one at the lower altitude.
_VARIANTS = "(SELECT * FROM (VALUES (0, 100, 5), (0, 200, 5), (1, 100, 2)) x(v, alt, half))"
_DETECTED = f"""{T.SITES}, i AS (SELECT site_id, name, longitude, latitude, v, alt, half FROM sites CROSS JOIN {_VARIANTS} WHERE v = 0 OR site_id % 5 = 0),
q AS (SELECT *, (CAST(floor(latitude / 0.05) AS INTEGER) + dr)::INTEGER AS "row", (CAST(floor(longitude / 0.05) AS INTEGER) + dc)::INTEGER AS col FROM i CROSS JOIN range(-5, 6) a(dr) CROSS JOIN range(-5, 6) b(dc) WHERE abs(dr) <= half AND abs(dc) <= half),
d AS (SELECT *, 2 * {earth.MEAN!r} * asin(sqrt(sin(radians(("row" + 0.5) * 0.05 - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(("row" + 0.5) * 0.05)) * sin(radians((col + 0.5) * 0.05 - longitude) / 2) ** 2)) AS dist FROM q),
sc AS (SELECT site_id, name, v, alt, v AS s FROM i UNION ALL SELECT site_id, name, v, alt, 1 FROM i WHERE v = 0 AND alt = 100 AND site_id % 5 <> 0),
g AS (SELECT sc.alt, sc.s, sc.name, d.site_id, km, "row", col FROM sc JOIN d ON d.site_id = sc.site_id AND d.v = sc.v AND d.alt = sc.alt JOIN (SELECT unnest([10.0, 20.0])::DOUBLE AS km) r ON dist <= km * 1000),
f AS (SELECT *, CASE alt WHEN 100 THEN '01' ELSE '02' END AS n, '-tgt_alt_' || alt || 'm_AGL-det_rng_' || km::INTEGER || 'km' || CASE WHEN alt = 100 THEN '-var' || (s + 1) ELSE '' END || '.kml' AS tail FROM g)"""


def _detected(spark, sf_dir, union: bool):
    """Outlines as files, read back with what their names tell, clipped to two ranges by the cells inside them; the outputs as files, read back again."""
    s = T.sites(spark, sf_dir).withColumn("x", F.explode(F.array(*(F.struct(F.lit(v).alias("v"), F.lit(a).alias("alt"), F.lit(h).alias("half")) for v, a, h in ((0, 100, 5), (0, 200, 5), (1, 100, 2))))))
    s = s.select("site_id", "name", "longitude", "latitude", "x.*").where("v = 0 OR site_id % 5 = 0")
    c, r = F.floor(F.col("longitude") / RES), F.floor(F.col("latitude") / RES)
    corner = lambda i, j: F.struct(((c + i) * RES).alias("lon"), ((r + j) * RES).alias("lat"))
    low, high = -F.col("half"), F.col("half") + 1
    square = F.array(corner(low, low), corner(high, low), corner(high, high), corner(low, high), corner(low, low))
    none = F.lit(None).cast("string")
    sensor = F.struct("name", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), none.alias("icon_color"), F.lit(None).cast("double").alias("icon_scale"), none.alias("icon_href"))
    style = F.struct(F.lit("#00aa00").alias("line_color"), F.lit(2.0).alias("line_width"), none.alias("fill_color"), F.lit(None).cast("double").alias("fill_opacity"))
    name = F.concat(F.lit("0"), F.col("v").cast("string"), F.lit("_cover-S"), F.col("site_id").cast("string"), F.lit("-tgt_alt_"), F.col("alt").cast("string"), F.lit("m_AGL.kml"))
    given = s.select(name.alias("filename"), F.col("name").alias("title"), F.col("alt").cast("double").alias("altitude"), F.array(F.array(square)).alias("polygons"), F.array(sensor).alias("sensors"), style.alias("style"), F.create_map(F.lit("Site"), "name").alias("metadata"), F.lit("clampToGround").alias("mode"))
    path = files.scratch(spark, "given")
    kml.write_files(kml.coverage_documents(given).withColumn("filename", in_folders(F.col("filename"), given.count())), path)

    read = kml.read_coverage(spark, path).where("error IS NULL")
    number = F.regexp_extract("file", r"cover-S(\d+)-", 1).cast("long") * 10 + F.substring("file", 1, 2).cast("long") * 2 + F.when(F.col("file").contains("_200m"), 1).otherwise(0)
    read = read.select(F.col("file").alias("filename"), number.alias("ordinal"), F.coalesce("sensor_name", "folder_name").alias("name"), "sensor.lon", "sensor.lat", "polygons", "style")
    items = files.saved(D.parsed(read.drop("sensor")).select("ordinal", "filename", "name", "lon", "lat", "altitude", "reference", "sensor_height", "style", "polygons"), "items")
    inside = C.cells_inside(items, ["ordinal", "lon", "lat"], RES)
    far = earth.sphere_distance(F.col("lat"), F.col("lon"), C.centre(F.col("row"), RES), C.centre(F.col("col"), RES))
    ranges = spark.range(1).select(F.explode(F.array(F.lit(10.0), F.lit(20.0))).alias("range_km"))
    outputs, cells = D.detection_ranges(items.drop("polygons"), files.saved(inside.select("ordinal", "row", "col", far.alias("dist_m")), "inside"), ranges, union)
    outputs, cells = files.saved(outputs, "outputs"), files.saved(cells, "cells")

    drawn = C.polygons(cells, ["filename"], RES).join(outputs, "filename")
    line = F.struct(F.col("style")["line_color"].alias("line_color"), F.col("style")["line_width"].cast("double").alias("line_width"), F.col("style")["fill_color"].alias("fill_color"), F.col("style")["fill_opacity"].cast("double").alias("fill_opacity"))
    sensors = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["lon"].alias("lon"), x["lat"].alias("lat"), none.alias("icon_color"), F.lit(None).cast("double").alias("icon_scale"), none.alias("icon_href")))
    told = F.create_map(F.lit("Detection Range"), F.concat(text.label(F.col("range_km")), F.lit(" km")), F.lit("Mode"), F.lit("Union" if union else "Single"), F.lit("Sensor Count"), F.col("sensors").cast("string"), F.lit("Sensors"), F.col("names"))
    done = drawn.select("filename", F.regexp_replace("filename", r"\.kml$", "").alias("title"), "altitude", "polygons", sensors.alias("sensors"), line.alias("style"), told.alias("metadata"), kml.height_mode(F.lit("clamped"), F.col("reference")).alias("mode"))
    path = files.scratch(spark, "detection")
    kml.write_files(kml.coverage_documents(done).withColumn("filename", in_folders(F.col("filename"), outputs.count())), path)
    back = C.cells_inside(kml.read_coverage(spark, path).where("error IS NULL"), ["file"], RES).groupBy("file").agg(F.count("*").alias("cells"))
    meta = kml.read_metadata(spark, path).select("file", F.col("metadata")["Sensor Count"].cast("long").alias("sensors"), F.col("metadata")["Detection Range"].alias("reach"))
    return back.join(meta, "file").select("file", "sensors", "reach", "cells")


@query(f"WITH {_DETECTED} SELECT n || '_coverage-Union' || tail AS file, count(DISTINCT site_id) AS sensors, any_value(km)::INTEGER || ' km' AS reach, count(DISTINCT (\"row\", col)) AS cells FROM f GROUP BY n, tail")
def detection_range(spark, sf_dir):
    """Detection ranges of a network, from outlines in files to outlines in files: the united coverage of each scenario and range."""
    return _detected(spark, sf_dir, True)


@query(f"WITH {_DETECTED} SELECT n || '_coverage-' || name || tail AS file, 1::BIGINT AS sensors, any_value(km)::INTEGER || ' km' AS reach, count(*) AS cells FROM f GROUP BY n, name, tail")
def detection_singles(spark, sf_dir):
    """The same without the union: an output for each sensor."""
    return _detected(spark, sf_dir, False)
