"""Terrain as cells: tiles' rasters, the mosaic of overlapping ones, samples at points, and elevations warped onto a sensor's plane.

A tile (id, ordinal, min_lon, max_lat, step) has cells (id, row, col, elevation), rows counted from the north; the mosaic is one
grid of the world (gx east, gy north from 0, 0) at the finest step.  Everything is joined by whole cell numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import earth
from ..sources.files import few, saved
from .tiles import answering, at_points, best_first


def nearest_pixel(points: DataFrame, tiles: DataFrame, cells: Callable[[DataFrame], DataFrame], default: float = 0.0) -> DataFrame:
    """``points`` (site_id, longitude, latitude, ...) with the tile that answers and the elevation of its pixel there; ``default`` where no tile is, or the pixel is empty.

    ``cells`` gives the cells of some tiles: only those that answer for a point are read.  They are many times the bytes of their tiles, which the
    optimiser can't tell, so it must not broadcast them.
    """
    ranked = tiles if "rank" in tiles.columns else tiles.withColumn("rank", F.lit(0))
    hit = at_points(points, answering(ranked)).groupBy("site_id").agg(F.max_by(F.struct("id", "tile_min_lon", "tile_max_lat", "step", "rows", "cols"), best_first()).alias("t"))
    at = points.join(hit, "site_id", "left")
    inside = lambda v, n: F.least(F.greatest(F.floor(v).cast("int"), F.lit(0)), n - 1)  # noqa: E731  a point on the far edge has the last pixel
    at = at.withColumn("row", inside((F.col("t.tile_max_lat") - F.col("latitude")) / F.col("t.step"), F.col("t.rows"))).withColumn("col", inside((F.col("longitude") - F.col("t.tile_min_lon")) / F.col("t.step"), F.col("t.cols")))
    at = at.withColumn("tile_id", F.col("t.id"))
    wanted = saved(at.drop("t"), "pixels")
    own = cells(tiles.join(few(wanted.select(F.col("tile_id").alias("id")).where("id IS NOT NULL").distinct()), "id", "left_semi"))
    found = wanted.join(own.select(F.col("id").alias("tile_id"), "row", "col", F.col("elevation").alias("__e")).hint("merge"), ["tile_id", "row", "col"], "left")
    return found.withColumn("sampled_m", F.coalesce(F.nanvl(F.col("__e").cast("double"), F.lit(None)), F.lit(default))).select(*points.columns, "tile_id", "sampled_m")


def mosaic(tiles: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """(gx, gy, elevation): all tiles' cells on one grid of the finest step; coarser ones fill several cells, and where tiles overlap the last one's values stay.

    Cells without a value hide nothing.  Cells that bring their tile's place (ordinal, min_lon, max_lat, step) with them are not joined.
    """
    place = ["ordinal", "min_lon", "max_lat", "step"]
    placed = cells if set(place) <= set(cells.columns) else cells.join(few(tiles.select("id", *place)), "id")
    placed = placed.where(F.col("elevation").isNotNull() & ~F.isnan(F.col("elevation").cast("double")))
    times = F.round(F.col("step") / step).cast("int")
    x0 = F.round((F.col("min_lon") + F.col("col") * F.col("step")) / step).cast("int")
    y0 = F.round((F.col("max_lat") - (F.col("row") + 1) * F.col("step")) / step).cast("int")
    last = lambda rows: rows.agg(F.max_by("elevation", "ordinal").alias("elevation"), F.max("ordinal").alias("ordinal"))
    own = last(placed.select("ordinal", "elevation", x0.alias("x0"), y0.alias("y0"), times.alias("times")).groupBy("x0", "y0", "times"))  # before coarse ones spread
    spread = own.select("ordinal", "elevation", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("times") - 1)).alias("gx"), "y0", "times")
    spread = spread.select("ordinal", "elevation", "gx", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("times") - 1)).alias("gy"))
    return last(spread.groupBy("gx", "gy")).drop("ordinal")


def bilinear(points: DataFrame, grid: DataFrame, step: float, keys: list[str]) -> DataFrame:
    """``points`` (keys, lon, lat) with the elevation between the four nearest cell centres of ``grid``; those without a value count for nothing, null where all are.

    A point is four rows for one join by cell, added up by its keys.
    """
    x, y = F.col("lon") / step - 0.5, F.col("lat") / step - 0.5
    at = points.withColumns({"__x": F.floor(x).cast("int"), "__y": F.floor(y).cast("int")}).withColumns({"__u": x - F.col("__x"), "__v": y - F.col("__y")})
    corner = lambda i, j: F.struct((F.col("__x") + i).alias("gx"), (F.col("__y") + j).alias("gy"), ((F.col("__u") if i else 1 - F.col("__u")) * (F.col("__v") if j else 1 - F.col("__v"))).alias("w"))
    four = at.select(*keys, F.explode(F.array(corner(0, 0), corner(1, 0), corner(0, 1), corner(1, 1))).alias("c")).select(*keys, "c.*").where("w > 0")
    near = four.join(grid.where("elevation IS NOT NULL"), ["gx", "gy"])
    sums = near.groupBy(*keys).agg((F.sum(F.col("w") * F.col("elevation")) / F.sum("w")).alias("elevation"))
    return points.join(sums, keys, "left")


def on_earth(plane: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """``plane`` (latitude, longitude of the sensor, x east and y north in metres, ...) with lon and lat: distances and directions from the sensor are true."""
    at = plane.withColumn("__az", F.degrees(F.atan2(x, y))).withColumn("__dist", F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)))
    at = at.withColumnsRenamed({"__az": "plane_az", "__dist": "plane_dist"})
    return earth.with_geodesic(at, "latitude", "longitude", "plane_az", "plane_dist").withColumnsRenamed({"lon2": "lon", "lat2": "lat"}).drop("plane_az", "plane_dist")


def plane_cell(x: Column, y: Column, extent: Column, res: Column, dim: Column) -> Column:
    """Row and column of a sensor's square grid that a place on its plane falls on; beyond the rim those at the rim."""
    clip = lambda v: F.least(F.greatest(v.cast("int"), F.lit(0)), dim - 1)
    return F.struct(clip((extent - y) / res).alias("row"), clip((x + extent) / res).alias("col"))


def looked_up(samples: DataFrame, grid: DataFrame, sensor: str) -> DataFrame:
    """``samples`` (sensor, row, col, ...) with the elevation of the sensor's grid there; no value is sea level.

    Both are many times the bytes of the sensors that they are made of, which the optimiser can't tell, so neither may be broadcast.
    """
    found = samples.join(grid.select(sensor, "row", "col", F.col("elevation").alias("__e")).hint("merge"), [sensor, "row", "col"], "left")
    return found.withColumn("elevation", F.coalesce(F.nanvl(F.col("__e").cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float")).drop("__e")
