"""The terrain tile catalogue: which tiles cover a box, which one answers for a point, what has to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.earth import bounding_box, sphere_distance
from ..functions.text import RASTERS

TILE_MB = 25.0


def _squares(low: str, high: str):
    """The whole degrees that an extent reaches into."""
    return F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))


def touching(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Boxes (min_lon .. max_lat) joined with the tiles (id, min_lon .. max_lat, ...) whose box they touch, edges included.

    An equi-join on whole degrees, then the exact test; a pair that meets in several squares is taken in the first of them.
    Tiles' columns come with their own names, those of their box as tile_min_lon .. tile_max_lat.
    """
    sides = ("min_lon", "min_lat", "max_lon", "max_lat")
    spread = boxes.withColumn("__x", F.explode(_squares("min_lon", "max_lon"))).withColumn("__y", F.explode(_squares("min_lat", "max_lat")))
    placed = tiles.withColumn("__x", F.explode(_squares("min_lon", "max_lon"))).withColumn("__y", F.explode(_squares("min_lat", "max_lat"))).withColumnsRenamed({c: f"tile_{c}" for c in sides})
    near = spread.join(placed, ["__x", "__y"])
    first = (F.col("__x") == F.greatest(F.floor("min_lon"), F.floor("tile_min_lon"))) & (F.col("__y") == F.greatest(F.floor("min_lat"), F.floor("tile_min_lat")))
    meets = (F.col("tile_min_lon") <= F.col("max_lon")) & (F.col("tile_max_lon") >= F.col("min_lon")) & (F.col("tile_min_lat") <= F.col("max_lat")) & (F.col("tile_max_lat") >= F.col("min_lat"))
    return near.where(first & meets).drop("__x", "__y")


def at_points(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """Points (site_id, longitude, latitude) with the tiles that they touch, and ``inside``: not on an edge."""
    boxes = points.select("site_id", "longitude", "latitude", F.col("longitude").alias("min_lon"), F.col("longitude").alias("max_lon"), F.col("latitude").alias("min_lat"), F.col("latitude").alias("max_lat"))
    lon, lat = F.col("longitude"), F.col("latitude")
    inside = (lon > F.col("tile_min_lon")) & (lon < F.col("tile_max_lon")) & (lat > F.col("tile_min_lat")) & (lat < F.col("tile_max_lat"))
    return touching(boxes, tiles).withColumn("inside", inside)


def best_first() -> Column:
    """The largest is the tile that answers for a point: inside, then by score, then the first; on edges by kind of raster, then the first."""
    kind = F.when(F.col("inside"), F.col("score")).otherwise(F.col("rank"))
    return F.struct(F.col("inside").cast("int").alias("inside"), kind.alias("kind"), (-F.col("ordinal")).alias("first"))


def answering(tiles: DataFrame) -> DataFrame:
    """Of tiles with one and the same box those that can be ``best_first`` at a point, so that copies of a box meet no point: the best score, and the best rank, of equals the first."""
    box, own = ["min_lon", "min_lat", "max_lon", "max_lat"], F.struct(*tiles.columns)
    best = [F.max_by(own, F.struct(c, -F.col("ordinal"))) for c in ("score", "rank")]
    each = tiles.groupBy(*box).agg(F.array_distinct(F.array(*best)).alias("t"))
    return each.select(F.explode("t").alias("t")).select("t.*")


def sampled(points: DataFrame, tiles: DataFrame, default: float = 0.0) -> DataFrame:
    """Each point's elevation from the best tile that holds it, ``best_first``; else the default."""
    rank = tiles.withColumn("rank", F.col("rank") if "rank" in tiles.columns else F.lit(0))
    best = at_points(points, answering(rank)).groupBy("site_id").agg(F.max_by(F.struct("id", "elevation"), best_first()).alias("tile"))
    return points.join(best, "site_id", "left").withColumn("tile_id", F.col("tile.id")).withColumn("sampled_m", F.coalesce(F.col("tile.elevation"), F.lit(default))).drop("tile")


def covered(boxes: DataFrame, tiles: DataFrame, key: str) -> DataFrame:
    """Whether the tiles that a box touches contain all of it: every whole-degree square that it reaches into has a tile."""
    need = (F.ceil("max_lon") - F.floor("min_lon")) * (F.ceil("max_lat") - F.floor("min_lat"))
    whole = lambda low, high: F.sequence(F.ceil(low).cast("int"), F.floor(high).cast("int") - 1)
    some = tiles.where("ceil(min_lon) < floor(max_lon) AND ceil(min_lat) < floor(max_lat)")
    squares = touching(boxes, some).withColumn("x", F.explode(whole("tile_min_lon", "tile_max_lon"))).withColumn("y", F.explode(whole("tile_min_lat", "tile_max_lat")))
    squares = squares.where((F.col("x") < F.ceil("max_lon")) & (F.col("x") >= F.floor("min_lon")) & (F.col("y") < F.ceil("max_lat")) & (F.col("y") >= F.floor("min_lat")))
    have = squares.groupBy(key).agg(F.countDistinct("x", "y").alias("have"))
    return boxes.withColumn("need", need).join(have, key, "left").withColumn("have", F.coalesce("have", F.lit(0))).withColumn("covered", F.col("have") == F.col("need"))


def last_of_each(tiles: DataFrame) -> DataFrame:
    """Of tiles listed more than once the last entry."""
    return tiles.groupBy("id").agg(F.max_by(F.struct(*(c for c in tiles.columns if c != "id")), "ordinal").alias("t")).select("id", "t.*")


def touched(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """The tiles that any of the boxes touches, each once.

    Boxes meet the tiles' different boxes, each once; so rows follow boxes and places, not the pairs of boxes and tiles, however many tiles lie over one place.
    """
    box = ["min_lon", "min_lat", "max_lon", "max_lat"]
    places = tiles.select(*box).distinct()
    hit = touching(boxes.select(*box), places).select(*(F.col(f"tile_{c}").alias(c) for c in box)).distinct()
    return tiles.join(hit, box, "left_semi")


def requirements(needed: DataFrame) -> DataFrame:
    """Totals over distinct tiles, by their last entries: all, cached, to fetch, and an estimate of their size."""
    return last_of_each(needed).agg(
        F.count("*").alias("total"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("to_download"), (F.count_if(~F.col("cached")) * TILE_MB).alias("est_mb")
    )


def present(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """Tiles with the file that holds each: the first kind there is of (id, ending, bytes), best kinds first; a file without bytes is none.

    ``local`` is its name, or that of the best kind where there is no file; ``downloaded`` says which.
    """
    rank = F.array_position(F.array(*(F.lit(e) for e in RASTERS)), F.col("ending"))
    own = files.where((F.col("bytes") > 0) & (rank > 0)).groupBy("id").agg(F.min_by("ending", rank).alias("ending"))
    return tiles.join(own, "id", "left").withColumn("local", F.concat("id", F.coalesce("ending", F.lit(RASTERS[0])))).withColumn("downloaded", F.col("ending").isNotNull()).drop("ending")


def extra_for(sites: DataFrame, tiles: DataFrame, inner: str, outer: str) -> DataFrame:
    """(site_id, id): tiles that a reach of ``outer`` metres needs beyond one of ``inner``: a tile with all corners in the inner circle is left out."""
    boxes = sites.withColumn("b", bounding_box(F.col("latitude"), F.col("longitude"), F.col(outer))).select("site_id", "latitude", "longitude", inner, "b.*")
    far = F.greatest(*(sphere_distance(F.col("latitude"), F.col("longitude"), F.col(f"tile_{y}_lat"), F.col(f"tile_{x}_lon")) for x in ("min", "max") for y in ("min", "max")))
    return touching(boxes, tiles).where(far > F.col(inner)).select("site_id", "id")
