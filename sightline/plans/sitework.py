"""Queries on sites, tasks, horizons, names and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import earth, text
from ..operators import sites as S
from ..registry import query
from ..sources import tables as T
from ..sources.files import few

_W = f"(1 - {earth.E2!r} * sin(radians(latitude)) * sin(radians(latitude)))"
RADIUS = f"(sqrt(({earth.A * (1 - earth.E2)!r} / ({_W} * sqrt({_W}))) * ({earth.A!r} / sqrt({_W}))) * {4 / 3!r})"
MSL = """CASE WHEN ground IS NULL THEN NULL WHEN altitude_mode = 'relativeToGround' THEN ground + coalesce(input_altitude, 0) + height
 WHEN altitude_mode = 'absolute' THEN coalesce(nullif(input_altitude, 0), ground) + height ELSE ground + height END"""
ALTS = "alts AS (SELECT unnest([10.0, 100.0, 1000.0, 10000.0])::DOUBLE AS alt_m)"


@query(f"WITH {T.SITES} SELECT site_id, round({RADIUS}, 4) AS radius_m FROM sites")
def effective_radius(spark, sf_dir):
    return T.sites(spark, sf_dir).select("site_id", F.round(earth.effective_radius(F.col("latitude")), 4).alias("radius_m"))


@query(f"WITH {T.SITES} SELECT site_id, {MSL} AS msl FROM sites")
def sensor_msl_height(spark, sf_dir):
    return S.with_msl_height(T.sites(spark, sf_dir)).select("site_id", "msl")


@query(f"""WITH {T.SITES}, {ALTS}, g AS (SELECT *, coalesce(ground, CASE WHEN altitude_mode = 'absolute' THEN input_altitude END, 0) AS g FROM sites),
h AS (SELECT *, CASE altitude_mode WHEN 'relativeToGround' THEN g + coalesce(input_altitude, 0) + height WHEN 'absolute' THEN coalesce(nullif(input_altitude, 0), g) + height ELSE g + height END AS msl, {RADIUS} AS radius FROM g)
SELECT site_id, name, alt_m, round(sqrt(2 * radius * msl) + sqrt(2 * radius * alt_m), 4) AS dist_m FROM h CROSS JOIN alts""")
def horizon_rings(spark, sf_dir):
    rings = S.horizon_rings(T.sites(spark, sf_dir), T.altitudes(spark))
    return rings.select("site_id", "name", "alt_m", F.round("dist_m", 4).alias("dist_m"))


@query(f"WITH {T.SITES}, h AS (SELECT *, {MSL} AS msl, {RADIUS} AS radius FROM sites) SELECT site_id, CASE WHEN msl >= 0 THEN round(sqrt(2 * radius * msl), 4) END AS own_m FROM h")
def horizon_range_single(spark, sf_dir):
    s = S.with_msl_height(T.sites(spark, sf_dir))
    return s.select("site_id", F.round(earth.horizon(F.col("msl"), earth.effective_radius(F.col("latitude"))), 4).alias("own_m"))


@query(f"WITH {T.SITES} SELECT site_id, name FROM sites WHERE regexp_matches(name, '[05]$')")
def name_filter(spark, sf_dir):
    return S.named(T.sites(spark, sf_dir), "[05]$").select("site_id", "name")


@query(f"""WITH {T.SITES}, {ALTS}, h AS (SELECT site_id, unnest(CASE WHEN altitude_mode IN ('relativeToGround', 'absolute') AND input_altitude IS NOT NULL THEN [height] ELSE [10.0::DOUBLE, 20.0::DOUBLE] END) AS task_height FROM sites)
SELECT site_id, task_height, alt_m FROM h CROSS JOIN alts""")
def task_cross(spark, sf_dir):
    return S.tasks(T.sites(spark, sf_dir), T.altitudes(spark), [20.0, 10.0, 10.0]).select("site_id", "task_height", "alt_m")


@query(f"WITH {T.SITES} SELECT altitude_mode, count(*) AS sites, count(input_altitude) AS with_altitude, max(height) AS highest, list_sort(list_distinct(list(height))) AS heights FROM sites GROUP BY altitude_mode")
def site_summary(spark, sf_dir):
    return T.sites(spark, sf_dir).groupBy("altitude_mode").agg(
        F.count("*").alias("sites"), F.count("input_altitude").alias("with_altitude"), F.max("height").alias("highest"), F.array_sort(F.collect_set("height")).alias("heights")
    )


@query(f"""WITH {T.SITES}, b AS (SELECT site_id, latitude, longitude, 30000.0 + (site_id % 7) * 10000 AS reach FROM sites)
SELECT site_id, round(longitude - reach / (111320.0 * greatest(0.1, cos(radians(latitude)))), 7) AS min_lon, round(latitude - reach / 111320.0, 7) AS min_lat,
round(longitude + reach / (111320.0 * greatest(0.1, cos(radians(latitude)))), 7) AS max_lon, round(latitude + reach / 111320.0, 7) AS max_lat FROM b""")
def bbox(spark, sf_dir):
    s = T.sites(spark, sf_dir).withColumn("b", earth.bounding_box(F.col("latitude"), F.col("longitude"), 30000.0 + (F.col("site_id") % 7) * 10000))
    return s.select("site_id", *(F.round(F.col(f"b.{c}"), 7).alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))


@query(f"""WITH {T.SITES}, t AS (SELECT s.site_id, n AS ordinal, site_id * 3 + n AS v, name || CASE WHEN n % 2 = 0 THEN '' ELSE ' ' END AS ring FROM sites s CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n))
SELECT ring, max_by(v, site_id * 10 + ordinal) AS v FROM t GROUP BY ring""")
def last_ring_wins(spark, sf_dir):
    n = F.explode(F.array(*(F.lit(i) for i in (1, 2, 3, 4))))
    t = T.sites(spark, sf_dir).withColumn("n", n).select(F.concat("name", F.when(F.col("n") % 2 == 0, "").otherwise(" ")).alias("ring"), (F.col("site_id") * 10 + F.col("n")).alias("ordinal"), (F.col("site_id") * 3 + F.col("n")).alias("v"))
    return S.last_by(t, "ring", "ordinal").select("ring", "v")


@query(f"""WITH {T.SITES}, {ALTS}, t AS (SELECT site_id, alt_m, 'S' || site_id || '_' || alt_m::BIGINT || '.kml' AS filename, md5(site_id || '|' || alt_m::BIGINT || '|' || coalesce(altitude_mode, 'None')) AS state_hash FROM sites CROSS JOIN alts)
SELECT filename, state_hash FROM t WHERE NOT (site_id % 3 = 0 AND alt_m < 500)""")
def resume_anti(spark, sf_dir):
    t = T.sites(spark, sf_dir).crossJoin(few(T.altitudes(spark)))
    t = t.withColumn("filename", F.concat(F.lit("S"), "site_id", F.lit("_"), text.label(F.col("alt_m")), F.lit(".kml"))).withColumn("state_hash", S.state_hash(F.col("site_id"), text.label(F.col("alt_m")), F.col("altitude_mode")))
    done = t.where("site_id % 3 = 0").withColumn("state_hash", F.when(F.col("alt_m") < 500, F.col("state_hash")).otherwise("stale")).select("filename", "state_hash")
    return S.pending(t, done).select("filename", "state_hash")


@query(f"""WITH {T.SITES} SELECT site_id, sha256(printf('%.6f', latitude) || '|' || printf('%.6f', longitude) || '|' || coalesce(printf('%.2f', {MSL}), 'None') || '|v1') AS zone_key FROM sites""")
def surface_key(spark, sf_dir):
    """Key of a stored surface: place and height above sea level, nothing that depends on the target's altitude."""
    s = S.with_msl_height(T.sites(spark, sf_dir))
    parts = [S.fixed(F.col("latitude"), 6), S.fixed(F.col("longitude"), 6), F.coalesce(S.fixed(F.col("msl"), 2), F.lit("None")), F.lit("v1")]
    return s.select("site_id", F.sha2(F.concat_ws("|", *parts), 256).alias("zone_key"))


@query("""WITH p AS (SELECT p_partkey, lower(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')) AS hex, trunc((p_size % 11) / 10.0::DOUBLE * 255)::BIGINT AS a FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'ff0000ff' ELSE lower(lpad(to_hex(a), 2, '0')) || substr(hex, 5, 2) || substr(hex, 3, 2) || substr(hex, 1, 2) END AS kml,
CASE WHEN p_partkey % 9 = 0 THEN '#ff0000' ELSE '#' || hex END AS back FROM p""")
def kml_color(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    hexed = F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    rgb = F.when(F.col("p_partkey") % 9 == 0, "red").otherwise(F.concat(F.lit("#"), hexed))
    p = p.select("p_partkey", text.kml_color(rgb, F.col("p_size") % 11 / 10.0).alias("kml"))
    return p.select("p_partkey", "kml", text.css_color(F.col("kml"))["color"].alias("back"))


@query("""SELECT p_partkey, '<table><tr><td>Brand</td><td>' || replace(replace(p_brand, '&', '&amp;'), '#', '#') || '</td></tr><tr><td>Name &lt;&amp;&gt;</td><td>' || replace(replace(p_name, '&', '&amp;'), '''', '&#x27;') || '</td></tr></table>' AS html FROM part""")
def metadata_map(spark, sf_dir):
    m = F.create_map(F.lit("Brand"), "p_brand", F.lit("Name <&>"), "p_name")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", text.metadata_html(m).alias("html"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'red' END AS line_color, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '2' END AS line_width, CASE WHEN p_size % 2 = 0 THEN NULL ELSE NULL END AS icon FROM part""")
def style_overlay(spark, sf_dir):
    own = F.map_filter(F.create_map(F.lit("line_color"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("line_width"), F.when(F.col("p_size") % 3 == 0, F.col("p_type"))), lambda k, v: v.isNotNull())
    style = S.overlaid(own, F.create_map(F.lit("line_color"), F.lit("red"), F.lit("line_width"), F.lit("2")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", style["line_color"].alias("line_color"), style["line_width"].alias("line_width"), F.lit(None).cast("int").alias("icon"))


@query("""WITH e AS (SELECT event_id, (event_id * 37 % 100000) AS s FROM events)
SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60 % 60) || 'm ' || (s % 60) || 's' ELSE (s % 60) || 's' END AS took FROM e""")
def durations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.duration(F.col("event_id") * 37 % 100000).alias("took"))


@query("""WITH p AS (SELECT p_partkey, p_size || ', ' || (p_partkey % 90) / 2.0::DOUBLE || ',x' || CASE WHEN p_partkey % 3 = 0 THEN ', 7' ELSE ',' END AS given FROM part)
SELECT p_partkey, i AS place, v AS value FROM (SELECT p_partkey, unnest(o) AS v, unnest(range(len(o))) AS i FROM (SELECT p_partkey, list_filter(list_transform(string_split(given, ','), lambda x: try_cast(trim(x) AS DOUBLE)), lambda x: x IS NOT NULL) AS o FROM p))""")
def option_values(spark, sf_dir):
    """Options that list several numbers, without what is no number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    given = F.concat(F.col("p_size").cast("string"), F.lit(", "), ((F.col("p_partkey") % 90) / 2.0).cast("string"), F.lit(",x"), F.when(F.col("p_partkey") % 3 == 0, ", 7").otherwise(","))
    return p.select("p_partkey", F.posexplode(text.options(given)).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {T.SITES} SELECT site_id, name FROM sites ORDER BY site_id LIMIT 1")
def first_site(spark, sf_dir):
    """The site that comes first in the input, for a trial."""
    return T.sites(spark, sf_dir).agg(F.min_by(F.struct("site_id", "name"), "site_id").alias("s")).select("s.*")


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS name, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def run_stamps(spark, sf_dir):
    """Times as names of runs and as metadata."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.stamp(F.col("ts")).alias("s")).select("event_id", "s.*")
