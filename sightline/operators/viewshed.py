"""A whole viewshed: each zone swept on its own from the sensor at its own resolution, cut to its ring, and all zones' cells together."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import earth
from ..sources.files import few, saved
from . import coverage, sweep

RAY = ["site_id", "zone", "az_idx"]


#: Fixed value: how much farther than the horizon terrain is needed.
MARGIN = 1.05


def reach(msl: Column, target: Column, radius: Column) -> Column:
    """How far a sensor has to be swept for a target's height: to where they meet over a smooth Earth, and a margin; null below the sea."""
    return earth.mutual_horizon(msl, target, radius) * MARGIN


def zone_rays(tasks: DataFrame, ray: list[str] = RAY) -> DataFrame:
    """Rays of every task's zones (site_id, latitude, longitude, msl, radius, zone, res_m, pass_max), dealt by ray: with az_idx, n_az, n_r and the step between samples."""
    grid = earth.polar_grid(F.col("pass_max"), F.col("res_m"))
    rays = tasks.withColumn("g", grid).select(*tasks.columns, F.col("g.n_r").alias("n_r"), F.col("g.n_az").alias("n_az")).withColumn("step_m", F.col("pass_max") / F.greatest(F.col("n_r") - 1, F.lit(1)))
    return rays.withColumn("az_idx", F.explode(F.sequence(F.lit(0), F.col("n_az") - 1))).repartition(*ray)


def zone_samples(rays: DataFrame) -> DataFrame:
    """The samples of rays: r_idx, r_m, and the place on the sensor's plane (x east, y north)."""
    s = rays.withColumn("r_idx", F.explode(F.sequence(F.lit(0), F.col("n_r") - 1))).withColumn("r_m", F.col("r_idx") * F.col("step_m"))
    az = F.col("az_idx") * (2 * 3.141592653589793 / F.col("n_az"))
    return s.withColumns({"x": F.col("r_m") * F.sin(az), "y": F.col("r_m") * F.cos(az)})


def zone_surfaces(tasks: DataFrame, terrain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(site_id, zone, az_idx, mva array): the surface of every zone; ``terrain`` adds elevation (float) to samples and keeps their partitioning where it can."""
    return sweep.as_rays(sweep.surface(terrain(zone_samples(zone_rays(tasks))), RAY), RAY)


def zone_cells(tasks: DataFrame, surfaces: DataFrame, res: float, ray: list[str] = RAY, keep: tuple[str, ...] = (), values: tuple[str, ...] = ("mva",)) -> DataFrame:
    """(site_id, zone, row, col, dist_m, keep, values): the cells of each zone's ring, each once, with the surface there; the rings of a task's zones are disjoint."""
    cells = coverage.site_cells(tasks, F.col("pass_max"), res, keep=("zone", "z_min", "pass_max", "res_m", *keep))
    cells = cells.where((F.col("dist_m") > F.col("z_min")) | ((F.col("z_min") == 0) & (F.col("dist_m") == 0)))
    g = earth.polar_grid(F.col("pass_max"), F.col("res_m"))
    at = earth.ray_index(F.col("az"), F.col("dist_m"), F.col("pass_max"), g["n_r"], g["n_az"])
    own = [c for c in dict.fromkeys((*ray, *keep)) if c not in ("site_id", "zone", "az_idx")]
    return coverage.gathered(cells.withColumn("i", at).select("site_id", "zone", "row", "col", "dist_m", *own, "i.az_idx", "i.r_idx"), surfaces, ray, values)


def composite(tasks: DataFrame, terrain: Callable[[DataFrame], DataFrame], altitudes: DataFrame, res: float, surfaces: DataFrame | None = None) -> DataFrame:
    """(site_id, alt_m, row, col): what each sensor sees at each altitude above ground, over all zones; ``surfaces`` if they are known already."""
    known = zone_surfaces(tasks, terrain) if surfaces is None else surfaces
    return coverage.seen_at(zone_cells(tasks, known, res), altitudes, "site_id", "row", "col").select("site_id", "alt_m", "row", "col")


#: A ray's surface is the same for all targets whose reach goes beyond its zone, so it is named by the zone's part that is swept, in whole millimetres, and not by the target.
SHARED_RAY = ["site_id", "zone", "reach_mm", "az_idx"]
SHARED_ZONE = SHARED_RAY[:3]
SHARED = ["site_id", "latitude", "longitude", "msl", "radius", "zone", "res_m", "pass_max", "reach_mm"]


def with_shared_key(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("reach_mm", F.round(F.col("pass_max") * 1000).cast("long"))


def shared(tasks: DataFrame) -> DataFrame:
    """What has to be swept for all tasks (with ``with_shared_key``): each sensor's zone and reach once."""
    return tasks.select(*SHARED).dropDuplicates(SHARED_ZONE)


def _looked(res: float, above_sea: bool):
    """A sector's surface to (alt_m, row, col), altitude by altitude of its ``targets``: what ``seen_cells`` takes by a join is looked up beside the rays."""

    def look(s: dict, mva: np.ndarray, ground: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        rays, n_r = mva.shape
        for row, col, az, dist in coverage.cells_of_site(s["latitude"], s["longitude"], s["pass_max"], res):
            i = np.clip((az / (2 * math.pi / s["n_az"])).astype(np.int64), 0, s["n_az"] - 1) - s["az_idx"]
            k = np.clip((dist / (s["pass_max"] / max(n_r - 1, 1))).astype(np.int64), 0, n_r - 1)
            own = np.flatnonzero((i >= 0) & (i < rays) & ((dist > s["z_min"]) | ((s["z_min"] == 0) & (dist == 0))))
            row, col, low, high = row[own], col[own], mva[i[own], k[own]], ground[i[own], k[own]]
            for target in s["targets"]:
                over = np.float32(target) - high if above_sea else np.float32(target)
                at = np.flatnonzero((over >= 0) & (low <= over) if above_sea else low <= over)
                if len(at):
                    yield np.full(len(at), target), row[at], col[at]

    return look


def surface_sums(tasks: DataFrame, found: DataFrame, step: float, side: int, posts: bool = False) -> DataFrame:
    """(site_id, zone, reach_mm, samples, open, ground, mva) of tasks (with ``with_shared_key``) over the mosaic ``found``: of each sector's or ray's samples their number, how many have
    their ground seen, and the sums of ground and surface."""
    from . import blocks  # which reads this module

    fields = [T.StructField("samples", T.LongType()), T.StructField("open", T.LongType()), T.StructField("ground", T.DoubleType()), T.StructField("mva", T.DoubleType())]

    def look(s: dict, mva: np.ndarray, ground: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        return [(np.array([mva.size]), np.array([np.count_nonzero(mva == 0)]), np.array([ground.sum(dtype=float)]), np.array([mva.sum(dtype=float)]))]

    wanted = shared(tasks)
    parts, places = blocks.sectors(wanted, step, posts)
    places = saved(places, "places")
    near = blocks.near_surfaces(parts, places, found, step, SHARED_ZONE, side, posts, ([], look, fields))
    wide = places.where("NOT fits")
    if wide.limit(1).count() == 0:
        return near
    far = wanted.join(parts.join(few(wide.select("px", "py")), ["px", "py"]).select(*SHARED_ZONE).distinct(), SHARED_ZONE, "left_semi")
    of = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    rays = blocks.surfaces(far, found, step, SHARED_RAY, side, posts)
    return near.unionByName(rays.select(*SHARED_ZONE, F.size("mva").cast("long").alias("samples"), F.size(F.filter("mva", lambda v: v == 0)).cast("long").alias("open"), of("ground").alias("ground"), of("mva").alias("mva")))


def seen_over(tasks: DataFrame, found: DataFrame, step: float, res: float, side: int, posts: bool = False, above_sea: bool = False) -> DataFrame:
    """``seen_cells`` of tasks (with ``with_shared_key``) over the mosaic ``found``: terrain comes to the sensors of a place where it fits there, else sensors' rays go to the terrain."""
    from . import blocks  # which reads this module

    own = [*SHARED, "z_min"]
    wanted = tasks.groupBy(*own).agg(F.array_sort(F.collect_set("alt_m")).alias("targets"))  # altitudes, a small set
    parts, places = blocks.sectors(wanted, step, posts)
    places = saved(places, "places")
    fields = [T.StructField("alt_m", T.DoubleType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]
    seen = blocks.near_surfaces(parts, places, found, step, ["site_id"], side, posts, (["z_min", "targets"], _looked(res, above_sea), fields))
    wide = places.where("NOT fits")
    if wide.limit(1).count() == 0:
        return seen
    far = tasks.join(parts.join(few(wide.select("px", "py")), ["px", "py"]).select(*SHARED_ZONE).distinct(), SHARED_ZONE)
    return seen.unionByName(seen_cells(far, saved(blocks.surfaces(shared(far), found, step, SHARED_RAY, side, posts), "surfaces"), res, above_sea))


def seen_cells(tasks: DataFrame, surfaces: DataFrame, res: float, above_sea: bool = False) -> DataFrame:
    """(site_id, alt_m, row, col): what each task (as of ``zone_rays``, and alt_m) sees, of surfaces by SHARED_RAY with mva and ground.

    The target's altitude is above ground, or above sea level: then it has to be over the ground, and the ground's height counts.
    """
    cells = zone_cells(tasks, surfaces, res, SHARED_RAY, ("alt_m", "reach_mm"), ("mva", "ground"))
    seen = sweep.seen_msl(F.col("mva"), F.col("ground"), F.col("alt_m")) if above_sea else sweep.seen_agl(F.col("mva"), F.col("alt_m"))
    return cells.where(seen).select("site_id", "alt_m", "row", "col")
