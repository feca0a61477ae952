"""Sweeps over real terrain: rasters as blocks of cells, rays cut where they leave a block, and the surface from the cuts' own maxima.

1. *Blocks.* Rasters come as pieces (ordinal, min_lon, max_lat, step_lon, step_lat, row0, col0, rows, cols, cells), which are laid out on one
   grid of the world at the finest step; its cells lie between whole steps, or round them for rasters of ``posts``.  Each block of the mosaic is painted from the pieces that reach into it, and one more row and column of its neighbours.
2. *Cuts.* A ray's samples lie on the sensor's plane, so the blocks it crosses follow from their places; a cut is a run of samples in one
   block, and a row of numbers: no sample is shuffled.
3. *Samples.* Cuts meet their block, which is sent once to each task that needs it, and take the terrain between its cell centres: an array
   of elevations, single precision, is all that goes on.
4. *Surface.* A ray's few cuts, sorted, are put together in a stream and swept as one row.

Where sensors' terrain takes fewer bytes than their samples, it is the other way round (``near_surfaces``): the blocks round a place of some degrees are
sent to its sensors, which are sectors of numbers, and no sample is shuffled at all.  The same samples take the same elevations either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import earth
from ..sources.files import dealt, few, saved
from .sweep import surface_of_rays, swept
from .viewshed import zone_rays

#: Cells on a block's side, samples that a task takes from one block at most on average, and samples laid out at a time.
SIDE, SAMPLES, AT_ONCE = 256, 4_000_000, 1_000_000
#: Degrees of a place whose sensors are swept together, bytes of terrain that a task may hold for one, and samples of a sector at most.
PLACE, HELD, SECTOR = 4.0, 64 << 20, 250_000


def pieces(tiles: DataFrame, cells: DataFrame, side: int = SIDE) -> DataFrame:
    """(ordinal, min_lon, max_lat, step_lon, step_lat, row0, col0, rows, cols, cells) of tiles (id, ordinal, min_lon, max_lat, step) and their cells (id, row, col, elevation)."""
    at = cells.withColumns({"r": F.floor(F.col("row") / side).cast("int"), "c": F.floor(F.col("col") / side).cast("int")}).groupBy("id", "r", "c")
    found = at.agg(F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") - F.min("row") + 1).alias("rows"), (F.max("col") - F.min("col") + 1).alias("cols"), F.array_sort(F.collect_list(F.struct("row", "col", "elevation"))).alias("list"))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row0, col0, rows, cols, own in zip(*(batch.column(n).to_pylist() for n in ("row0", "col0", "rows", "cols")), batch.column("list"), strict=True):
                grid = np.full((rows, cols), np.nan, np.float32)
                parts = own.values
                value = parts.field("elevation").cast(pa.float32()).to_numpy(zero_copy_only=False)
                grid[parts.field("row").to_numpy() - row0, parts.field("col").to_numpy() - col0] = value
                out.append(grid.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(n) for n in ("row0", "col0", "rows", "cols")), _lists(out)], names=["id", "row0", "col0", "rows", "cols", "cells"])

    laid = found.drop("r", "c").mapInArrow(dense, found.select("id", "row0", "col0", "rows", "cols").schema.add("cells", T.ArrayType(T.FloatType())))
    return laid.join(few(tiles.select("id", "ordinal", "min_lon", "max_lat", F.col("step").alias("step_lon"), F.col("step").alias("step_lat"))), "id").drop("id")


def _lists(arrays: list[np.ndarray], kind=None) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.float32)]), kind))


def _parts(side: int):
    """Pieces to the parts of them that each block has, in their own cells: a block has one row and column of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        done = lambda own, cells: pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(zip(*own), kinds)), _lists(cells, pa.float32())], names=["bx", "by", "ordinal", "times_x", "times_y", "x0", "y1", "rows", "cols", "cells"])
        for batch in batches:
            own, cells, size = [], [], 0
            for ordinal, tx, ty, x0, y1, rows, cols, values in zip(*(batch.column(n).to_pylist() for n in ("ordinal", "times_x", "times_y", "x0", "y1", "rows", "cols")), batch.column("cells"), strict=True):
                grid = values.values.to_numpy(zero_copy_only=False).reshape(rows, cols)
                for by in range((y1 - rows * ty - 1) // side, (y1 - 1) // side + 1):
                    # Rows count from the north: of those that reach into the block's cells, by * side to by * side + side.
                    r0, r1 = max(0, (y1 - 1 - (by * side + side)) // ty), min(rows, (y1 - 1 - by * side) // ty + 1)
                    for bx in range((x0 - 1) // side, (x0 + cols * tx - 1) // side + 1):
                        c0, c1 = max(0, (bx * side - x0) // tx), min(cols, (bx * side + side - x0) // tx + 1)
                        if r0 < r1 and c0 < c1:
                            own.append((bx, by, ordinal, tx, ty, x0 + c0 * tx, y1 - r0 * ty, r1 - r0, c1 - c0))
                            cells.append(grid[r0:r1, c0:c1].ravel())
                            size += len(cells[-1])
                if size >= AT_ONCE:
                    yield done(own, cells)
                    own, cells, size = [], [], 0
            if own:
                yield done(own, cells)

    return run


def mosaic(found: DataFrame, step: float, side: int = SIDE, posts: bool = False) -> DataFrame:
    """(bx, by, cells): the blocks of the world's grid at ``step`` degrees that pieces reach into: side + 1 rows from the south by side + 1 columns from the west.

    Where pieces overlap the one of the highest ordinal stays, cell by cell; empty cells hide nothing; coarser ones fill several.  Pieces are
    cut to blocks before they are shuffled; they go to a task in order and are painted one after the other, so a task holds one block and one piece, however many overlap.
    """
    across = round(360 / step)
    p = found.withColumns({f"times_{k}": F.round(F.col(f"step_{n}") / step).cast("int") for k, n in (("x", "lon"), ("y", "lat"))})
    half = lambda k: F.floor(F.col(f"times_{k}") / 2) if posts else F.lit(0)  # noqa: E731  cells that lie before a coarser post's own
    inset = 0.5 if posts else 0.0
    p = p.withColumn("x0", F.round((F.col("min_lon") + inset * F.col("step_lon")) / step).cast("long") + F.col("col0") * F.col("times_x") - half("x"))
    top = F.round((F.col("max_lat") - inset * F.col("step_lat")) / step).cast("long") - F.col("row0") * F.col("times_y")
    p = p.withColumn("y1", top - half("y") + F.col("times_y") if posts else top)
    turns = F.when(F.col("x0") <= -across // 2, F.array("x0", F.col("x0") + across)).otherwise(F.array("x0"))  # the first column is also the last one's neighbour
    p = p.withColumn("x0", F.explode(turns))
    p = p.select("ordinal", "times_x", "times_y", "x0", "y1", "rows", "cols", "cells").mapInArrow(_parts(side), "bx long, by long, ordinal long, times_x int, times_y int, x0 long, y1 long, rows int, cols int, cells array<float>")
    p = p.repartition("bx", "by").sortWithinPartitions("bx", "by", "ordinal", "x0", "y1")

    def painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), _lists([block.ravel()])], names=["bx", "by", "cells"])
        for batch in batches:
            for bx, by, tx, ty, x0, y1, rows, cols, own in zip(*(batch.column(n).to_pylist() for n in ("bx", "by", "times_x", "times_y", "x0", "y1", "rows", "cols")), batch.column("cells"), strict=True):
                if at != (bx, by):
                    if at:
                        yield done()
                    at, block = (bx, by), np.full((side + 1, side + 1), np.nan, np.float32)
                grid = own.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(rows, cols)[::-1]  # from the south
                if tx > 1 or ty > 1:
                    grid = grid.repeat(ty, 0).repeat(tx, 1)
                y0, south, west = y1 - rows * ty, by * side, bx * side
                (c0, c1), (r0, r1) = (max(x0, west), min(x0 + cols * tx, west + side + 1)), (max(y0, south), min(y1, south + side + 1))
                if c0 < c1 and r0 < r1:
                    new = grid[r0 - y0 : r1 - y0, c0 - x0 : c1 - x0]
                    np.copyto(block[r0 - south : r1 - south, c0 - west : c1 - west], new, where=~np.isnan(new))
        if at:
            yield done()

    return p.mapInArrow(painted, "bx long, by long, cells array<float>")


def geodesic(lat: np.ndarray, lon: np.ndarray, az: np.ndarray, dist: np.ndarray, steps: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) at the end of geodesics (azimuth in degrees) on the ellipsoid, by Vincenty's series as ``earth.with_geodesic``."""
    a, b, f = earth.A, earth.B, earth.FLAT
    t, sin1, cos1 = (1 - f) * np.tan(np.radians(lat)), np.sin(np.radians(az)), np.cos(np.radians(az))
    cu = 1 / np.sqrt(1 + t * t)
    su, s1, sa = t * cu, np.arctan2(t, cos1), cu * sin1
    c2a = 1 - sa * sa
    u2 = c2a * ((a * a - b * b) / (b * b))
    big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    s = dist / (b * big)
    for _ in range(steps):
        m, k = np.cos(2 * s1 + s), np.sin(s)
        s = dist / (b * big) + small * k * (m + small / 4 * (np.cos(s) * (-1 + 2 * m * m) - small / 6 * m * (-3 + 4 * k * k) * (-3 + 4 * m * m)))
    k, c, m = np.sin(s), np.cos(s), np.cos(2 * s1 + s)
    x = su * k - cu * c * cos1
    lat2 = np.degrees(np.arctan2(su * c + cu * k * cos1, (1 - f) * np.sqrt(sa * sa + x * x)))
    q = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
    turn = np.arctan2(k * sin1, cu * c - su * k * cos1) - (1 - q) * f * sa * (s + q * k * (m + q * c * (-1 + 2 * m * m)))
    return lat2, lon + np.degrees(turn)


_RAY = ("latitude", "longitude", "msl", "radius", "res_m", "pass_max", "az_idx", "n_az", "n_r", "step_m")


def _places(ray: dict[str, np.ndarray], index: np.ndarray, step: float, posts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Samples' places on the world's grid, in cells from the first centre.

    The terrain is that of the plane of the sensor: a sample takes the centre of the plane's cell that it falls on, as far as the plane goes.
    """
    az, r = ray["az_idx"] * (2 * math.pi / ray["n_az"]), index * ray["step_m"]
    half, res = ray["pass_max"] * 1.05, ray["res_m"]
    last = np.floor(2 * half / res) - 1
    col, row = (np.clip(np.trunc((v + half) / res), 0, last) for v in (r * np.sin(az), -r * np.cos(az)))
    x, y = (col + 0.5) * res - half, half - (row + 0.5) * res
    return _on_grid(ray["latitude"], ray["longitude"], x, y, step, posts)


def _on_grid(latitude: np.ndarray, longitude: np.ndarray, x: np.ndarray, y: np.ndarray, step: float, posts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places on the world's grid of those on sensors' planes, x east and y north."""
    lat, lon = geodesic(latitude, longitude, np.degrees(np.arctan2(x, y)), np.sqrt(x * x + y * y))
    across = round(360 / step)
    inset = 0 if posts else 0.5
    gx = lon / step - inset
    return gx - across * np.floor((gx + across / 2) / across), lat / step - inset  # the date line lies between two columns


def _between(grid: np.ndarray, x: np.ndarray, right: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The terrain so far (u, v) beyond the centres of cells (x, y) of a grid, towards columns ``right``, single precision; cells without a value count for nothing, and 0 is where all are."""
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        w, value = (u if i else 1 - u) * (v if j else 1 - v), grid[y + j, right if i else x]
        counts = (w > 0) & ~np.isnan(value)
        total += np.where(counts, w * np.where(counts, value, 0), 0)
        weight += np.where(counts, w, 0)
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 0).astype(np.float32)


def _columns(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy() if isinstance(batch, pa.Table) else batch.column(n).to_numpy(zero_copy_only=False) for n in _RAY}


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows of AT_ONCE samples at most, or of one row."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right")))
        yield slice(low, high)
        low = high


def cuts(rays: DataFrame, step: float, side: int = SIDE, posts: bool = False) -> DataFrame:
    """``rays`` (as of ``zone_rays``) cut into runs of samples that lie in one block: with cut (from 0 along the ray), first, n, bx and by."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ray = _columns(batch)
            for part in _slices(ray["n_r"]):
                sizes = ray["n_r"][part]
                which = np.repeat(np.arange(part.start, part.stop), sizes)
                start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                index = np.arange(len(which)) - np.repeat(start, sizes)
                gx, gy = _places({n: v[which] for n, v in ray.items()}, index, step, posts)
                bx, by = (np.floor(np.floor(v) / side).astype(np.int64) for v in (gx, gy))
                fresh = np.ones(len(which), bool)
                fresh[1:] = (which[1:] != which[:-1]) | (bx[1:] != bx[:-1]) | (by[1:] != by[:-1])
                at = np.flatnonzero(fresh)
                own = which[at]
                number = np.arange(len(at)) - np.searchsorted(own, own)
                n = np.diff(np.append(at, len(which)))
                kept = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int32()), pa.array(index[at], pa.int32()), pa.array(n, pa.int32()), pa.array(bx[at]), pa.array(by[at])], names=[*kept.schema.names, "cut", "first", "n", "bx", "by"])

    more = [T.StructField(n, T.IntegerType()) for n in ("cut", "first", "n")] + [T.StructField(n, T.LongType()) for n in ("bx", "by")]
    return rays.mapInArrow(cut, T.StructType([*rays.schema.fields, *more]))


def _sampled(keep: list[str], step: float, side: int, posts: bool):
    """Cuts of one block and the block's cells to (keep, cut, elevations)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grid = np.full((side + 1, side + 1), np.nan) if not right.num_rows else right.column("cells").combine_chunks().values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(side + 1, side + 1)
        ray, sizes, first, out = _columns(left), left.column("n").to_numpy(), left.column("first").to_numpy(), []
        bx, by = (left.column(n)[0].as_py() * side if left.num_rows else 0 for n in ("bx", "by"))
        for part in _slices(sizes):
            n = sizes[part]
            which = np.repeat(np.arange(part.start, part.stop), n)
            begins = np.concatenate([[0], np.cumsum(n)])
            index = np.arange(len(which)) - np.repeat(begins[:-1], n) + first[which]
            own = {k: v[which] for k, v in ray.items()}
            gx, gy = _places(own, index, step, posts)
            x, y = np.floor(gx), np.floor(gy)
            at = (x - bx).astype(np.int64)
            ground = _between(grid, at, at + 1, (y - by).astype(np.int64), gx - x, gy - y)
            out += [ground[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        return pa.table([*(left.column(k).combine_chunks() for k in (*keep, "cut")), _lists(out)], names=[*keep, "cut", "elevations"])

    return run


def whole_rays(cuts_: DataFrame, ray: list[str], keep: list[str]) -> DataFrame:
    """(keep, elevations): rays' cuts (keep, cut, elevations), which come in order, put together: one sort, and a task holds a batch and one ray."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
            lists = rows.column("elevations").combine_chunks()
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            own = rows.select(keep).take(pa.array(at))
            return pa.RecordBatch.from_arrays([*(own.column(k).combine_chunks() for k in keep), pa.ListArray.from_arrays(pa.array(np.append(ends[at], ends[-1]).astype(np.int32)), lists.flatten())], names=[*keep, "elevations"])

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            fresh = np.zeros(rows.num_rows, bool)
            fresh[0] = True
            for k in ray:
                column = rows.column(k).to_numpy()
                fresh[1:] |= column[1:] != column[:-1]
            at = np.flatnonzero(fresh)
            rest = rows.slice(at[-1])  # the next batch may go on with it
            if len(at) > 1:
                yield put(rows.slice(0, at[-1]), at[:-1])
        if rest is not None and rest.num_rows:
            yield put(rest, np.array([0]))

    return cuts_.repartition(*ray).sortWithinPartitions(*ray, "cut").drop("cut").mapInArrow(run, cuts_.select(*keep, "elevations").schema)


def surfaces(tasks: DataFrame, found: DataFrame, step: float, ray: list[str], side: int = SIDE, posts: bool = False) -> DataFrame:
    """(ray, mva array, ground array): the surface along every ray of ``tasks`` (as of ``viewshed.zone_rays``) over the mosaic ``found``, and the terrain under it.

    A block that many rays cross is sent to several tasks, each with a part of the cuts, as a count of samples says.  Where no block or
    no value is, the ground is sea level.
    """
    rays = zone_rays(tasks, ray)
    cut = saved(cuts(rays.select(*dict.fromkeys((*ray, *_RAY))), step, side, posts), "cuts")
    load = cut.groupBy("bx", "by").agg(F.ceil(F.sum("n") / SAMPLES).cast("int").alias("tasks"))
    load = few(saved(load, "load"))
    parts = cut.join(load, ["bx", "by"]).withColumn("task", F.pmod(F.xxhash64(*ray), F.col("tasks")).cast("int")).drop("tasks")
    sent = found.join(load, ["bx", "by"]).withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    keep = list(dict.fromkeys((*ray, "msl", "radius", "step_m")))
    schema = parts.select(*keep, "cut").schema.add("elevations", T.ArrayType(T.FloatType()))
    at = ["bx", "by", "task"]
    sampled = parts.groupBy(*at).cogroup(sent.groupBy(*at)).applyInArrow(_sampled(keep, step, side, posts), schema)
    swept = surface_of_rays(whole_rays(sampled, ray, keep), [*ray, "elevations"])
    return swept.select(*ray, "mva", F.col("elevations").alias("ground"))


def sectors(tasks: DataFrame, step: float, posts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sectors, places): ``tasks`` as runs of rays of SECTOR samples at most (with n_az, n_r, step_m, az_idx of the first ray, rays), and the places (px, py) that they lie in.

    A place has the box of cells that its rays may need (x0, y0, wide, high; columns are counted on past the date line), the parts that its samples are dealt to, and whether
    it ``fits``: a task can hold its box, which is sent to every part and takes no more bytes than the samples.
    """
    across, inset = round(360 / step), 0.0 if posts else 0.5
    g = earth.polar_grid(F.col("pass_max"), F.col("res_m"))
    s = tasks.withColumn("g", g).select(*tasks.columns, F.col("g.n_r").alias("n_r"), F.col("g.n_az").alias("n_az")).withColumn("step_m", F.col("pass_max") / F.greatest(F.col("n_r") - 1, F.lit(1)))
    s = s.withColumn("each", F.greatest(F.floor(SECTOR / F.col("n_r")), F.lit(1)).cast("int")).withColumn("az_idx", F.explode(F.sequence(F.lit(0), F.col("n_az") - 1, F.col("each"))))
    s = s.withColumn("rays", F.least("each", F.col("n_az") - F.col("az_idx"))).drop("each")
    s = s.withColumns({"px": F.floor(F.col("longitude") / PLACE), "py": F.floor(F.col("latitude") / PLACE)})
    away = (F.col("pass_max") + 2 * F.col("res_m")) / 6.3e6  # on a sphere within the ellipsoid
    tall, top = F.degrees(away), F.radians(F.abs("latitude")) + away
    wide = F.when(top < math.pi / 2 - 1e-6, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(away) / F.cos(F.radians("latitude")))))).otherwise(180.0)
    cell = lambda v: F.floor(v / step - inset).cast("long")
    low, high = F.greatest(F.col("latitude") - tall, F.lit(-90.0)), F.least(F.col("latitude") + tall, F.lit(90.0))
    boxes = s.groupBy("px", "py").agg(
        F.min(cell(F.col("longitude") - wide)).alias("x0"), F.max(cell(F.col("longitude") + wide)).alias("x1"), F.min(cell(low)).alias("y0"), F.max(cell(high)).alias("y1"), F.sum(F.col("n_r").cast("long") * F.col("rays")).alias("samples"),
    )
    boxes = boxes.withColumns({"wide": F.least(F.col("x1") - F.col("x0") + 2, F.lit(across)).cast("int"), "high": (F.col("y1") - F.col("y0") + 2).cast("int"), "parts": F.ceil(F.col("samples") / SAMPLES).cast("int")})
    size = (F.col("wide") + 1) * F.col("high") * F.lit(4).cast("long")
    fits = (size <= HELD) & (size * F.col("parts") <= F.greatest(4 * F.col("samples"), F.lit(1 << 20)))
    return s, boxes.select("px", "py", "x0", "y0", "wide", "high", "parts", fits.alias("fits"))


def _swept_near(keep: list[str], values: tuple[str, ...], step: float, side: int, posts: bool, look: tuple[list[str], Callable] | None):
    """A place's blocks, then its sectors, in a stream: to (keep, az_idx, rays, n_r, values) or what ``look`` takes of them; a task holds one box and a batch."""
    across = round(360 / step)
    half = across // 2
    last = (half - 1) // side  # the block whose cells end at the date line
    key = ("px", "py", "part")

    def painted(grid: np.ndarray, box: tuple[int, int, int, int], bx: int, by: int, cells: np.ndarray) -> None:
        x0, y0, wide, high = box
        block = cells.reshape(side + 1, side + 1)
        gx, row = np.arange(bx * side, bx * side + side), np.arange(by * side, by * side + side) - y0
        col = (gx - x0) % across
        rs, cs = np.flatnonzero((row >= 0) & (row < high)), np.flatnonzero((gx >= -half) & (gx < across - half) & (col < wide))
        grid[np.ix_(row[rs], col[cs])] = block[np.ix_(rs, cs)]
        if bx == last:
            grid[row[rs], wide] = block[rs, half - last * side]

    def ground(grid: np.ndarray | None, box: tuple[int, int, int, int], s: dict) -> np.ndarray:
        az, r = np.arange(s["az_idx"], s["az_idx"] + s["rays"]) * (2 * math.pi / s["n_az"]), np.arange(s["n_r"]) * s["step_m"]
        out, res = s["pass_max"] * 1.05, s["res_m"]
        end = np.floor(2 * out / res) - 1
        col, row = (np.clip(np.trunc((v + out) / res), 0, end).astype(np.int64) for v in (r * np.sin(az)[:, None], -r * np.cos(az)[:, None]))
        if grid is None:
            return np.zeros(col.shape, np.float32)
        found, own = np.unique((row * (int(end) + 1) + col).ravel(), return_inverse=True)  # samples on one cell of the plane have one elevation
        col, row = found % (int(end) + 1), found // (int(end) + 1)
        gx, gy = _on_grid(s["latitude"], s["longitude"], (col + 0.5) * res - out, out - (row + 0.5) * res, step, posts)
        x, y = np.floor(gx), np.floor(gy)
        at, up = (x.astype(np.int64) - box[0]) % across, y.astype(np.int64) - box[1]
        right = np.where(x == half - 1, box[2], (at + 1) % across)
        if max(at.max(), right.max() - 1) >= box[2] or up.min() < 0 or up.max() + 1 >= box[3]:
            raise ValueError("a sample lies beyond the terrain of its place")
        return _between(grid, at, right, up, gx - x, gy - y)[own].reshape(len(az), len(r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, grid, box = None, None, None

        def done(batch: pa.RecordBatch, of: list[int], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            if look:
                own = batch.select(keep).take(pa.array(np.repeat(of, [len(c) for c in columns[0]])))
                return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(np.concatenate(c)) for c in columns)], names=[*keep, *values])
            own = batch.select([*keep, "az_idx", "rays", "n_r"]).take(pa.array(of))
            return pa.RecordBatch.from_arrays([*own.columns, *(_lists(list(c), pa.float32()) for c in columns)], names=[*own.schema.names, *values])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
            boxes = list(zip(*(batch.column(k).to_pylist() for k in ("x0", "y0", "wide", "high"))))
            kind, bx, by = (batch.column(k).to_pylist() for k in ("kind", "bx", "by"))
            cells, columns = batch.column("cells"), {n: batch.column(n).to_pylist() for n in (*_RAY, "rays", *(look[0] if look else ()))}
            of, size, out = [], 0, []
            for i, at in enumerate(keys):
                if at != now:
                    now, grid, box = at, None, boxes[i]
                if kind[i] == 0:
                    if grid is None:
                        grid = np.full((box[3], box[2] + 1), np.nan, np.float32)
                    painted(grid, box, bx[i], by[i], cells[i].values.to_numpy(zero_copy_only=False))
                    continue
                s = {n: v[i] for n, v in columns.items()}
                z = ground(grid, box, s)
                column = lambda v: np.full((len(z), 1), v)
                mva, _ = swept(z, {n: column(s[n]) for n in ("msl", "radius", "step_m")} | {"first": column(0), "before": column(-np.inf)})
                for found in look[1](s, mva, z) if look else [tuple((mva if v == "mva" else z).ravel() for v in values)]:
                    of.append(i)
                    out.append(found)
                    size += max(map(len, found))
                    if size >= AT_ONCE:
                        yield done(batch, of, out)
                        of, size, out = [], 0, []
            if of:
                yield done(batch, of, out)

    return run


def near_surfaces(parts: DataFrame, places: DataFrame, found: DataFrame, step: float, keep: list[str], side: int = SIDE, posts: bool = False, look: tuple[list[str], Callable, list[T.StructField]] | None = None) -> DataFrame:
    """(keep, az_idx, rays, n_r, mva, ground): the surface of whole sectors (see ``sectors``) and the ground, ray after ray in one array each, of those places that fit.

    What is shuffled is a few numbers a sector, and the blocks of each place's box.  With ``look`` (columns, a function of a sector's numbers with those columns, its surface and its ground,
    a row a ray, to tuples of columns; their fields) those rows come instead, with keep, and no surface leaves its task.
    """
    across, key, box = round(360 / step), ["px", "py"], ["x0", "y0", "wide", "high"]
    half = across // 2
    p = few(places.where("fits").drop("fits"))
    of = F.pmod(F.xxhash64(*keep, "az_idx"), F.col("parts")).cast("int").alias("part")
    rows = parts.join(p, key).select(*key, of, F.lit(1).alias("kind"), *box, *dict.fromkeys((*keep, *_RAY, "rays", *(look[0] if look else ()))))
    turn = lambda k: (F.greatest(F.col("x0") - k * across, F.lit(-half)), F.least(F.col("x0") + F.col("wide") - k * across, F.lit(across - half - 1)))
    run = lambda a, b: F.when(a <= b, F.sequence(F.floor(a / side), F.floor(b / side))).otherwise(F.array().cast("array<bigint>"))
    needed = p.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("by", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor((F.col("y0") + F.col("high") - 1) / side))))
    needed = needed.withColumn("bx", F.explode(F.array_distinct(F.flatten(F.array(*(run(*turn(k)) for k in (-1, 0, 1)))))))
    sent = found.join(needed.hint("shuffle_hash"), ["bx", "by"]).select(*key, "part", F.lit(0).alias("kind"), *box, "bx", "by", "cells")
    # A named number of tasks, as rows are few bytes and much work.
    every = dealt(rows.unionByName(sent, allowMissingColumns=True), *key, "part").sortWithinPartitions(*key, "part", "kind")
    lists = [T.StructField(v, T.ArrayType(T.FloatType())) for v in ("mva", "ground")]
    schema = T.StructType([*parts.select(*keep).schema.fields, *look[2]] if look else [*parts.select(*keep, "az_idx", "rays", "n_r").schema.fields, *lists])
    values = tuple(f.name for f in (look[2] if look else lists))
    return every.mapInArrow(_swept_near(keep, values, step, side, posts, look and look[:2]), schema)


def ground_at(points: DataFrame, found: DataFrame, step: float, side: int = SIDE, posts: bool = False) -> DataFrame:
    """``points`` (longitude, latitude, ...) with ground_m, the elevation of the mosaic's nearest cell; 0 where there is none.

    The points go to the blocks, which are not shuffled if a count says that the points are few.
    """
    place = lambda c: (F.floor(F.col(c) / step + 0.5) if posts else F.floor(F.col(c) / step)).cast("long")
    at = points.withColumns({"__x": place("longitude"), "__y": place("latitude"), "__point": F.monotonically_increasing_id()})
    at = saved(at.withColumns({"bx": F.floor(F.col("__x") / side), "by": F.floor(F.col("__y") / side)}), "points")
    cell = F.get("cells", ((F.col("__y") - F.col("by") * side) * (side + 1) + F.col("__x") - F.col("bx") * side).cast("int"))
    near = found.join(few(at.select("bx", "by", "__x", "__y", "__point")), ["bx", "by"]).select("__point", F.nanvl(cell.cast("double"), F.lit(0.0)).alias("ground_m"))
    return at.join(near, "__point", "left").select(*points.columns, F.coalesce("ground_m", F.lit(0.0)).alias("ground_m"))
