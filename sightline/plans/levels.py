"""Queries on coverage in cells of several sizes: each zone of a viewshed has its own, and a network's coverage is runs of codes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import earth
from ..operators import coverage as C
from ..operators import intervals as I
from ..operators import viewshed as V
from ..registry import query
from ..sources import tables as T
from ..sources.files import few, saved
from .terrainwork import _COMPOSITE, zone_tasks, zone_terrain

#: The level of each zone's cells: 1.2, 2.4 and 4.9 km at the equator.
LEVELS = (15, 14, 13)
FINEST = max(LEVELS)


def _spread(x: str) -> str:
    for shift, mask in I._MASKS:
        x = f"(({x} | ({x} << {shift})) & {mask})"
    return x


def _near(zone: int, level: int) -> str:
    """Cells of a zone's level near each site (d), those inside its ring and what the others hold of the finest."""
    res, fine, k = I.degrees(level), I.degrees(FINEST), 1 << (FINEST - level)
    half = earth.MEAN * math.radians(res) * 0.7072
    at = lambda r, q, step: f"""2 * {earth.MEAN!r} * asin(sqrt(sin(radians(({r} + 0.5) * {step!r} - latitude) / 2) * sin(radians(({r} + 0.5) * {step!r} - latitude) / 2) + cos(radians(latitude)) * cos(radians(({r} + 0.5) * {step!r})) * (sin(radians(({q} + 0.5) * {step!r} - longitude) / 2) * sin(radians(({q} + 0.5) * {step!r} - longitude) / 2)))) AS dist_m,
 atan2(sin(radians(({q} + 0.5) * {step!r} - longitude)) * cos(radians(({r} + 0.5) * {step!r})), cos(radians(latitude)) * sin(radians(({r} + 0.5) * {step!r})) - sin(radians(latitude)) * cos(radians(({r} + 0.5) * {step!r})) * cos(radians(({q} + 0.5) * {step!r} - longitude))) AS az"""  # noqa: E731
    own = "site_id, zone, latitude, longitude, z_min, pass_max, n_r, n_az"
    return f"""n{zone} AS (SELECT {own}, r, floor(longitude / {res!r})::BIGINT + unnest(range(-w, w + 1)) AS q FROM (SELECT *, floor(latitude / {res!r})::BIGINT + i AS r, ceil(60000 / (111000 * cos(radians(least(abs(latitude) + 1, 85)))) / {res!r})::BIGINT AS w FROM h CROSS JOIN range(-{math.ceil(0.55 / res)}, {math.ceil(0.55 / res) + 1}) x(i) WHERE zone = {zone})),
d{zone} AS (SELECT *, (dist_m - {half!r} > z_min OR z_min = 0) AND dist_m + {half!r} <= pass_max AS whole FROM (SELECT *, {at("r", "q", res)} FROM n{zone}) WHERE dist_m <= pass_max + {half!r} AND dist_m > z_min - {half!r}),
w{zone} AS (SELECT * EXCLUDE whole, {k} AS size FROM d{zone} WHERE whole UNION ALL SELECT * FROM (SELECT {own}, r, q, {at("r", "q", fine)}, 1 AS size FROM (SELECT {own}, r, q * {k} + unnest(range({k})) AS q FROM (SELECT {own}, r * {k} + unnest(range({k})) AS r, q FROM d{zone} WHERE NOT whole))) WHERE dist_m <= pass_max AND (dist_m > z_min OR (z_min = 0 AND dist_m = 0)))"""


_FLAT = f"""{_COMPOSITE}, {", ".join(_near(z, x) for z, x in enumerate(LEVELS))},
lw AS (SELECT * FROM w0 UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2),
li AS (SELECT *, CASE WHEN az < 0 THEN az + 2 * pi() ELSE az END AS way FROM lw),
lm AS (SELECT li.site_id, r, q, size, mva FROM (SELECT *, least(greatest(trunc(way / (2 * pi() / n_az))::INTEGER, 0), n_az - 1) AS ai, least(greatest(trunc(dist_m / (pass_max / greatest(n_r - 1, 1)))::INTEGER, 0), n_r - 1) AS ri FROM li) li JOIN m ON m.site_id = li.site_id AND m.zone = li.zone AND m.az_idx = ai AND m.r_idx = ri),
lf AS (SELECT site_id, r, q * size + unnest(range(size)) AS q, mva FROM (SELECT site_id, r * size + unnest(range(size)) AS r, q, size, mva FROM lm)),
lc AS (SELECT alt_m, r, q, {_spread(f"(q + {1 << (FINEST - 1)})")} | ({_spread(f"(r + {1 << (FINEST - 1)})")} << 1) AS code, count(*) AS depth FROM lf CROSS JOIN (SELECT unnest([50.0, 200.0])::DOUBLE AS alt_m) WHERE mva <= alt_m::FLOAT GROUP BY ALL)"""


def zone_runs(spark, sf_dir) -> DataFrame:
    """(site_id, alt_m, side, lo, hi): what each sensor sees at each altitude above ground, in its zones' own cells."""
    tasks = saved(zone_tasks(spark, sf_dir), "tasks")
    surfaces, found = saved(V.zone_surfaces(tasks, zone_terrain), "surfaces"), None
    for zone, level in enumerate(LEVELS):
        cells = I.ring_cells(tasks.where(F.col("zone") == zone), level, FINEST, ("zone", "res_m"))
        g = earth.polar_grid(F.col("pass_max"), F.col("res_m"))
        at = cells.withColumn("i", earth.ray_index(F.col("az"), F.col("dist_m"), F.col("pass_max"), g["n_r"], g["n_az"])).select("site_id", "zone", "level", "row", "col", "i.*")
        mva = C.gathered(at, surfaces.where(F.col("zone") == zone), V.RAY)
        coarse, fine = I.run_of(F.col("row"), F.col("col"), level, FINEST), I.run_of(F.col("row"), F.col("col"), FINEST, FINEST)
        pick = lambda i: F.when(F.col("level") == FINEST, fine[i]).otherwise(coarse[i])  # noqa: B023, E731
        rows = mva.select("site_id", "mva", F.lit(0).alias("side"), pick(0).alias("lo"), pick(1).alias("hi"))
        found = rows if found is None else found.unionByName(rows)
    return found.join(few(T.altitudes(spark, 50, 200)), F.col("mva") <= F.col("alt_m").cast("float")).drop("mva")


@query(f"WITH {_FLAT} SELECT alt_m, min(code) AS lo, max(code) + 1 AS hi FROM (SELECT alt_m, code, code - row_number() OVER (PARTITION BY alt_m, code >> {I.RANGE_BITS} ORDER BY code) AS island FROM lc) GROUP BY alt_m, code >> {I.RANGE_BITS}, island")
def coverage_runs(spark, sf_dir):
    """A network's coverage at the resolution of each zone, as runs of codes; SQL counts it finest cell by finest cell."""
    return I.united(zone_runs(spark, sf_dir), ["alt_m"])


@query(f"WITH {_FLAT} SELECT alt_m, depth::BIGINT AS depth, count(*) AS cells FROM lc GROUP BY ALL")
def coverage_runs_depth(spark, sf_dir):
    """How much of it, in finest cells, how many sensors see."""
    found = I.depth(zone_runs(spark, sf_dir), ["alt_m"])
    return found.groupBy("alt_m", "depth").agg(F.sum(F.col("hi") - F.col("lo")).alias("cells"))


@query(f"WITH {_FLAT} SELECT alt_m, round(sum({earth.MEAN!r} * {earth.MEAN!r} * {math.radians(I.degrees(FINEST))!r} * (sin(radians((r + 1) * {I.degrees(FINEST)!r})) - sin(radians(r * {I.degrees(FINEST)!r})))) / 1e6, 1) AS area_km2 FROM lc GROUP BY alt_m")
def coverage_runs_area(spark, sf_dir):
    """Its area, from the largest cells that the runs are made of."""
    found = I.area(I.united(zone_runs(spark, sf_dir), ["alt_m"]), ["alt_m"], FINEST)
    return found.select("alt_m", F.round(F.col("area_m2") / 1e6, 1).alias("area_km2"))


@query(f"""WITH {_FLAT}, gained AS (SELECT code FROM lc WHERE alt_m = 200 EXCEPT SELECT code FROM lc WHERE alt_m = 50)
SELECT min(code) AS lo, max(code) + 1 AS hi FROM (SELECT code, code - row_number() OVER (PARTITION BY code >> {I.RANGE_BITS} ORDER BY code) AS island FROM gained) GROUP BY code >> {I.RANGE_BITS}, island""")
def coverage_runs_gained(spark, sf_dir):
    """What is seen of higher targets only: one set of runs less another."""
    return I.without(zone_runs(spark, sf_dir).withColumn("side", F.when(F.col("alt_m") == 50, 1).otherwise(0)), [])
