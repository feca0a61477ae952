"""Queries on polygons themselves: depth, sets and detection ranges of outlines without cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import earth
from ..operators import overlay as O
from ..registry import query
from ..sources import tables as T
from .detections import geodesic_sql

#: Corners of a circle, and its ranges in km.
CORNERS, RANGES = 64, (100, 300)
#: Half width and height of an outline round a site, in degrees.
HALF = (3.0, 2.0)
_SIDE = "CASE WHEN altitude_mode = 'absolute' THEN 0 ELSE 1 END"
_CIRCLES = geodesic_sql(f"SELECT site_id, km, i::INTEGER AS i, {_SIDE} AS side, latitude, longitude, i * {360 / CORNERS!r}::DOUBLE AS az, km * 1000.0::DOUBLE AS dist FROM sites CROSS JOIN range({CORNERS}) r(i) CROSS JOIN (SELECT unnest({list(RANGES)}) AS km) k")
#: Circles' corners run clockwise, so what heads east has the circle below it.
_EDGES = f"""{T.SITES}, o AS (SELECT site_id, km, side, i, lon2 AS ax, lat2 AS ay, lead(lon2, 1) OVER w AS nx, lead(lat2, 1) OVER w AS ny, first_value(lon2) OVER w AS fx, first_value(lat2) OVER w AS fy FROM ({_CIRCLES}) WINDOW w AS (PARTITION BY site_id, km ORDER BY i)),
ce AS (SELECT km, site_id, side, i, least(ax, bx) AS x0, CASE WHEN ax < bx THEN ay ELSE by_ END AS y0, greatest(ax, bx) AS x1, CASE WHEN ax < bx THEN by_ ELSE ay END AS y1, CASE WHEN ax < bx THEN -1 ELSE 1 END AS d FROM (SELECT *, coalesce(nx, fx) AS bx, coalesce(ny, fy) AS by_ FROM o) WHERE ax <> bx)"""
#: Edges e in slabs between all ends and crossings, from below (mid), with the integral of the sine of their latitude over the slab (below).
_SLABS = """g AS MATERIALIZED (SELECT *, (y1 - y0) / (x1 - x0) AS m, least(y0, y1) AS lo, greatest(y0, y1) AS hi, row_number() OVER (ORDER BY km, site_id, side, i) AS id FROM e),
cr AS (SELECT km, x FROM (SELECT a.km, a.x0 + ((b.y0 + (a.x0 - b.x0) * b.m) - a.y0) / (a.m - b.m) AS x, greatest(a.x0, b.x0) AS l, least(a.x1, b.x1) AS h FROM g a JOIN g b ON a.km = b.km AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.lo <= b.hi AND b.lo <= a.hi WHERE a.m <> b.m) WHERE x > l AND x < h),
st AS (SELECT km, x AS xa, lead(x) OVER (PARTITION BY km ORDER BY x) AS xb FROM (SELECT km, x0 AS x FROM g UNION SELECT km, x1 FROM g UNION SELECT km, x FROM cr)),
sl AS (SELECT g.km, site_id, side, d, xa, xb, y0 + ((xa + xb) / 2 - x0) * m AS mid, radians(m * (xb - xa) / 2) AS half FROM st JOIN g ON g.km = st.km AND x0 <= xa AND x1 >= xb AND xb > xa),
ab AS (SELECT *, radians(xb - xa) * sin(radians(mid)) * CASE WHEN abs(half) < 1e-9 THEN 1 ELSE sin(half) / half END AS below FROM sl)"""
_KM2 = f"round(sum(lead_below - below) * {earth.MEAN**2!r} / 1e6, 3) AS area_km2"


def _circles(spark, sf_dir, ranges: tuple[int, ...] = RANGES) -> DataFrame:
    sites = T.sites(spark, sf_dir).withColumn("km", F.explode(F.array(*map(F.lit, ranges)))).withColumns({"dist": F.col("km") * 1000.0, "side": F.expr(_SIDE)})
    return O.circles(sites, ["km", "site_id", "side"], CORNERS)


def _km2() -> Column:
    return F.round(F.sum(O.piece_area()) / 1e6, 3).alias("area_km2")


@query(f"""WITH {_EDGES}, e AS (SELECT * FROM ce), {_SLABS}
SELECT km, depth, {_KM2} FROM (SELECT km, xa, below, sum(d) OVER w AS depth, lead(below) OVER w AS lead_below FROM ab WINDOW w AS (PARTITION BY km, xa ORDER BY mid)) WHERE depth > 0 AND lead_below > below GROUP BY ALL HAVING sum(lead_below - below) > 1e-10""")
def polygon_depth_area(spark, sf_dir):
    """Square kilometres within so many sites' circles, by range."""
    shapes = _circles(spark, sf_dir).withColumn("side", F.lit(0))
    found = O.areas(O.edges(shapes, ["km"]), ["km"])
    return found.where((F.col("n0") > 0) & (F.col("m2") > 1e-10 * earth.MEAN**2)).select("km", F.col("n0").alias("depth"), F.round(F.col("m2") / 1e6, 3).alias("area_km2"))


@query(f"""WITH {_EDGES}, e AS (SELECT * FROM ce), {_SLABS},
n AS (SELECT km, below, sum(CASE side WHEN 0 THEN d ELSE 0 END) OVER w AS n0, sum(CASE side WHEN 1 THEN d ELSE 0 END) OVER w AS n1, lead(below) OVER w AS lead_below FROM ab WINDOW w AS (PARTITION BY km, xa ORDER BY mid))
SELECT 'union' AS what, km, {_KM2} FROM n WHERE n0 > 0 OR n1 > 0 GROUP BY km
UNION ALL SELECT 'intersection', km, {_KM2} FROM n WHERE n0 > 0 AND n1 > 0 AND lead_below > below GROUP BY km HAVING sum(lead_below - below) > 1e-10
UNION ALL SELECT 'difference', km, {_KM2} FROM n WHERE n0 > 0 AND n1 <= 0 GROUP BY km""")
def polygon_set_area(spark, sf_dir):
    """What the circles of sites of absolute altitude and those of all others cover together, both, or the first alone."""
    found = O.areas(O.edges(_circles(spark, sf_dir), ["km"]), ["km"], sets=True)
    what = F.array(F.lit("union"), F.when(F.col("n0") > 0, F.when(F.col("n1") > 0, "intersection").otherwise("difference")))
    each = found.select(F.explode(F.array_compact(what)).alias("what"), "km", "m2").groupBy("what", "km").agg(F.sum("m2").alias("m2"))
    return each.where(F.col("m2") > 1e-10 * earth.MEAN**2).select("what", "km", F.round(F.col("m2") / 1e6, 3).alias("area_km2"))


@query(f"""WITH {_EDGES},
bx AS (SELECT km, site_id, 0 AS side, i, longitude - {HALF[0]} AS x0, latitude + v AS y0, longitude + {HALF[0]} AS x1, latitude + v AS y1, CASE WHEN v < 0 THEN 1 ELSE -1 END AS d FROM sites CROSS JOIN (VALUES (0, {-HALF[1]}::DOUBLE), (1, {HALF[1]}::DOUBLE)) x(i, v) CROSS JOIN (SELECT unnest({list(RANGES)}) AS km) k),
e AS (SELECT * REPLACE (1 AS side) FROM ce UNION ALL BY NAME SELECT * FROM bx), {_SLABS},
w AS (SELECT *, sum(CASE side WHEN 0 THEN d ELSE 0 END) OVER w AS n0, sum(CASE side WHEN 1 THEN d ELSE 0 END) OVER w AS n1 FROM ab WINDOW w AS (PARTITION BY km, xa, site_id ORDER BY mid)),
i AS (SELECT *, (n0 > 0 AND n1 > 0)::INTEGER AS inside FROM w),
c AS (SELECT *, inside - coalesce(lag(inside) OVER (PARTITION BY km, xa, site_id ORDER BY mid), 0) AS more FROM i),
n AS (SELECT km, below, sum(more) OVER w AS n, lead(below) OVER w AS lead_below FROM c WINDOW w AS (PARTITION BY km, xa ORDER BY mid))
SELECT km, {_KM2} FROM n WHERE n > 0 GROUP BY km""")
def detection_overlay(spark, sf_dir):
    """Detection ranges as polygons: each site's outline clipped to its circle, and the clipped outlines united by range."""
    x, y = F.col("longitude"), F.col("latitude")
    at = lambda i, j: F.struct((x + i * HALF[0]).alias("lon"), (y + j * HALF[1]).alias("lat"))
    outline = F.array(F.array(F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1))))
    sites = T.sites(spark, sf_dir).withColumn("km", F.explode(F.array(*map(F.lit, RANGES))))
    own = sites.select("km", "site_id", F.lit(0).alias("side"), outline.alias("polygons"))
    both = own.unionByName(_circles(spark, sf_dir).withColumn("side", F.lit(1)))
    clipped = O.overlay(O.edges(both, ["km", "site_id"]), ["km", "site_id"], "intersection")
    return O.overlay(O.piece_edges(clipped, ["km"]), ["km"], "union").groupBy("km").agg(_km2())
