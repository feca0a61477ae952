"""Queries on the tile catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import earth, text
from ..operators import tiles as O
from ..registry import query
from ..sources import tables as T

_BOX = f"""{T.SITES}, {T.TILES}, b AS (SELECT site_id, longitude - r / (111320.0 * greatest(0.1, cos(radians(latitude)))) AS min_lon, latitude - r / 111320.0 AS min_lat,
 longitude + r / (111320.0 * greatest(0.1, cos(radians(latitude)))) AS max_lon, latitude + r / 111320.0 AS max_lat FROM (SELECT *, 60000.0 + (site_id % 5) * 20000 AS r FROM sites))"""
_HIT = "t.min_lon <= b.max_lon AND t.max_lon >= b.min_lon AND t.min_lat <= b.max_lat AND t.max_lat >= b.min_lat"


def _boxes(spark, sf_dir):
    s = T.sites(spark, sf_dir).withColumn("b", earth.bounding_box(F.col("latitude"), F.col("longitude"), 60000.0 + (F.col("site_id") % 5) * 20000))
    return s.select("site_id", "b.*")


@query(f"WITH {_BOX} SELECT b.site_id, t.id FROM b JOIN tiles t ON {_HIT}")
def tile_intersect(spark, sf_dir):
    return O.touching(_boxes(spark, sf_dir), T.tiles(spark, sf_dir)).select("site_id", "id")


@query(f"""WITH {T.SITES}, {T.TILES}, m AS (SELECT s.site_id, t.*, s.longitude > t.min_lon AND s.longitude < t.max_lon AND s.latitude > t.min_lat AND s.latitude < t.max_lat AS inside
 FROM sites s JOIN tiles t ON s.longitude >= t.min_lon AND s.longitude <= t.max_lon AND s.latitude >= t.min_lat AND s.latitude <= t.max_lat),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY inside DESC, CASE WHEN inside THEN score ELSE 0 END DESC, ordinal) AS n FROM m)
SELECT s.site_id, r.id AS tile_id, coalesce(r.elevation, 0) AS sampled_m FROM sites s LEFT JOIN r ON r.site_id = s.site_id AND r.n = 1""")
def tile_best_score(spark, sf_dir):
    return O.sampled(T.sites(spark, sf_dir), T.tiles(spark, sf_dir)).select("site_id", "tile_id", "sampled_m")


@query(f"WITH {_BOX} SELECT DISTINCT t.id FROM b JOIN tiles t ON {_HIT} WHERE NOT t.cached")
def tile_missing_anti(spark, sf_dir):
    return O.touched(_boxes(spark, sf_dir), T.tiles(spark, sf_dir).where("NOT cached")).select("id").distinct()


@query(f"WITH {_BOX} SELECT DISTINCT t.id FROM b JOIN tiles t ON {_HIT} WHERE t.cached")
def tile_cached_semi(spark, sf_dir):
    return O.touched(_boxes(spark, sf_dir), T.tiles(spark, sf_dir).where("cached")).select("id").distinct()


@query(f"""WITH {_BOX}, d AS (SELECT DISTINCT t.id, t.cached FROM b JOIN tiles t ON {_HIT})
SELECT count(*) AS total, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS to_download, count(*) FILTER (NOT cached) * 25.0::DOUBLE AS est_mb FROM d""")
def download_requirements(spark, sf_dir):
    return O.requirements(O.touched(_boxes(spark, sf_dir), T.tiles(spark, sf_dir)))


@query(f"""WITH {_BOX}, n AS (SELECT b.site_id, ((ceil(max_lon) - floor(b.min_lon)) * (ceil(max_lat) - floor(b.min_lat)))::BIGINT AS need FROM b),
q AS (SELECT DISTINCT unnest(range(min_lon::BIGINT, max_lon::BIGINT)) AS x, min_lat AS y FROM tiles),
h AS (SELECT b.site_id, count(*) AS have FROM b JOIN q ON q.x >= floor(b.min_lon) AND q.x < ceil(b.max_lon) AND q.y >= floor(b.min_lat) AND q.y < ceil(b.max_lat) GROUP BY b.site_id)
SELECT n.site_id, need, coalesce(have, 0) AS have, coalesce(have, 0) = need AS covered FROM n LEFT JOIN h USING (site_id)""")
def tile_full_cover(spark, sf_dir):
    return O.covered(_boxes(spark, sf_dir), T.tiles(spark, sf_dir), "site_id").select("site_id", "need", "have", "covered")


@query(f"WITH {T.TILES}, r AS (SELECT *, row_number() OVER (PARTITION BY min_lon, min_lat ORDER BY ordinal DESC) AS n FROM tiles) SELECT min_lon, min_lat, elevation, id FROM r WHERE n = 1")
def mosaic_last_wins(spark, sf_dir):
    """Of tiles over one square the later one's samples stay."""
    return T.tiles(spark, sf_dir).groupBy("min_lon", "min_lat").agg(F.max_by("elevation", "ordinal").alias("elevation"), F.max_by("id", "ordinal").alias("id"))


@query(f"WITH {T.TILES} SELECT score, min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat, min_by(id, elevation * 100000 + ordinal) AS lowest FROM tiles GROUP BY score")
def mosaic_bounds(spark, sf_dir):
    return T.tiles(spark, sf_dir).groupBy("score").agg(
        F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"), F.min_by("id", F.col("elevation") * 100000 + F.col("ordinal")).alias("lowest")
    )


@query(f"WITH {T.TILES} SELECT id, min_lon, min_lat, max_lon, max_lat FROM tiles")
def footprint_parse(spark, sf_dir):
    t = T.tiles(spark, sf_dir)
    x, y = (F.col(c).cast("int").cast("string") for c in ("min_lon", "min_lat"))
    x1, y1 = (F.col(c).cast("int").cast("string") for c in ("max_lon", "max_lat"))
    at = lambda a, b: F.concat(a, F.lit(" "), b)
    wkt = F.concat(F.lit("geography'SRID=4326;POLYGON(("), F.concat_ws(", ", at(x, y), at(x, y1), at(x1, y1), at(x1, y), at(x, y)), F.lit("))'"))
    box = text.footprint_box(wkt)
    return t.withColumn("b", box).select("id", "b.*")


@query(f"""WITH {_BOX}, d AS (SELECT DISTINCT t.id, t.cached FROM b JOIN tiles t ON {_HIT})
SELECT b.site_id, count(*) AS tiles, count(*) FILTER (cached) AS cached FROM b JOIN tiles t ON {_HIT} GROUP BY b.site_id""")
def prepare_tiles(spark, sf_dir):
    """Of each site the tiles that its terrain needs, and how many are there."""
    return O.touching(_boxes(spark, sf_dir), T.tiles(spark, sf_dir)).groupBy("site_id").agg(F.count("*").alias("tiles"), F.count_if("cached").alias("cached"))


_MEMBER = """SELECT c_custkey AS archive, n AS ordinal, CASE n WHEN 0 THEN 'A' || c_custkey || '/DEM/x_DEM.tif' WHEN 1 THEN 'A' || c_custkey || '/DEM/x_dem.DT' || (1 + c_custkey % 2)
 WHEN 2 THEN 'A' || c_custkey || '/AUXFILES/x_EDM.tif' WHEN 3 THEN 'readme_dem.txt' WHEN 4 THEN 'x_WBM.dt2' ELSE 'x' || (c_custkey % 7) || '.dt' || (1 + c_custkey % 2) END AS member"""


@query(f"""WITH m AS ({_MEMBER} FROM customer CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS n)), f AS (SELECT *, lower(member) AS l FROM m WHERE NOT (ordinal < 2 AND archive % 3 = 0)),
s AS (SELECT archive, ordinal, member, CASE WHEN l LIKE '%dem/%' THEN 100 ELSE 0 END + CASE WHEN contains(l, '_dem') THEN 50 ELSE 0 END + CASE WHEN l LIKE '%.dt2' THEN 3 WHEN l LIKE '%.dt1' THEN 2 ELSE 0 END AS score FROM f
 WHERE regexp_matches(l, '[.](dt2|dt1|tif)$') AND NOT regexp_matches(l, '_(edm|flm|hem|acm|wbm)'))
SELECT archive, arg_max(member, score * 10 - ordinal) AS member, max(score) AS score FROM s GROUP BY archive""")
def archive_member(spark, sf_dir):
    """Of each terrain archive the member that is the raster: no masks, the best score, of equals the first."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("n", F.explode(F.array(*(F.lit(i) for i in range(6)))))
    m = c.selectExpr("c_custkey AS archive", "n AS ordinal", _MEMBER.split("ordinal, ")[1].replace(" AS member", "") + " AS member").where("NOT (ordinal < 2 AND archive % 3 = 0)")
    m = m.withColumn("score", text.member_score(F.col("member"))).where("score IS NOT NULL")
    return m.groupBy("archive").agg(F.max_by("member", F.struct("score", -F.col("ordinal"))).alias("member"), F.max("score").alias("score"))


@query(f"""WITH {T.TILES}, f AS (SELECT id, e AS ending, CASE WHEN (ordinal + k) % 3 = 0 THEN 0 ELSE 9 END AS bytes, k FROM tiles CROSS JOIN (VALUES ('.dt2', 1), ('.dt1', 2), ('.tif', 3)) x(e, k) WHERE (ordinal + k) % 4 <> 0),
b AS (SELECT id, arg_min(ending, k) AS ending FROM f WHERE bytes > 0 GROUP BY id)
SELECT id, id || coalesce(ending, '.dt2') AS local, ending IS NOT NULL AS downloaded FROM tiles LEFT JOIN b USING (id)""")
def tile_files(spark, sf_dir):
    """The file that holds each tile, by order of endings."""
    t = T.tiles(spark, sf_dir)
    k = F.explode(F.array(*(F.struct(F.lit(e).alias("ending"), F.lit(i).alias("k")) for i, e in enumerate((".dt2", ".dt1", ".tif"), 1))))
    files = t.select("id", "ordinal", k.alias("e")).select("id", "e.ending", F.when((F.col("ordinal") + F.col("e.k")) % 3 == 0, 0).otherwise(9).alias("bytes"), ((F.col("ordinal") + F.col("e.k")) % 4 != 0).alias("there")).where("there")
    return O.present(t, files).select("id", "local", "downloaded")


@query(f"""WITH {T.TILES}, c AS (SELECT id, min_lon, min_lat, max_lon, max_lat FROM tiles) SELECT id, 'name ' || id AS name, min_lon, min_lat, max_lon, max_lat FROM c""")
def tile_index(spark, sf_dir):
    """Entries of JSON index documents, one document for each score, as rows; documents that are none give nothing."""
    t = T.tiles(spark, sf_dir)
    at = lambda a, b: F.concat(F.col(a).cast("string"), F.lit(" "), F.col(b).cast("string"))
    ring = F.concat_ws(", ", at("min_lon", "min_lat"), at("min_lon", "max_lat"), at("max_lon", "max_lat"), at("max_lon", "min_lat"), at("min_lon", "min_lat"))
    entry = F.struct("id", F.struct(F.concat(F.lit("name "), "id").alias("name"), F.concat(F.lit("geography'SRID=4326;POLYGON(("), ring, F.lit("))'")).alias("footprint")))
    documents = t.groupBy("score", F.pmod("ordinal", F.lit(50))).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("document"))
    documents = documents.select("document").union(t.limit(1).select(F.lit("{no index")))
    return documents.select(F.explode(text.index_entries(F.col("document"))).alias("e")).select("e.id", "e.name", "e.box.*")


@query(f"""WITH {T.SITES}, {T.TILES}, r AS (SELECT *, 30000.0 + (site_id % 5) * 20000 AS i FROM sites), b AS (SELECT *, i + 60000 AS o FROM r),
x AS (SELECT *, longitude - o / (111320.0 * greatest(0.1, cos(radians(latitude)))) AS x0, latitude - o / 111320.0 AS y0, longitude + o / (111320.0 * greatest(0.1, cos(radians(latitude)))) AS x1, latitude + o / 111320.0 AS y1 FROM b),
h AS (SELECT x.site_id, x.latitude, x.longitude, x.i, t.id, unnest([min_lat, min_lat, max_lat, max_lat]) AS cy, unnest([min_lon, max_lon, min_lon, max_lon]) AS cx FROM x JOIN tiles t ON t.min_lon <= x1 AND t.max_lon >= x0 AND t.min_lat <= y1 AND t.max_lat >= y0)
SELECT site_id, id FROM h GROUP BY site_id, id, i HAVING max(2 * 6371008.8 * asin(sqrt(sin(radians(cy - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(cy)) * sin(radians(cx - longitude) / 2) ** 2))) > i""")
def lazy_tiles(spark, sf_dir):
    """Tiles to fetch when a sweep goes on from an inner reach to an outer one."""
    s = T.sites(spark, sf_dir).withColumn("inner_m", 30000.0 + (F.col("site_id") % 5) * 20000).withColumn("outer_m", F.col("inner_m") + 60000)
    return O.extra_for(s, T.tiles(spark, sf_dir), "inner_m", "outer_m")
