"""Coverage as intervals: cells of several sizes on one quadtree of the world, and sets of them as runs of Morton codes.

A cell of level l is one of 2**l by 2**l squares of 360 / 2**l degrees; it covers a run of 4**(finest - l) codes of the finest level, so a run is
one row whatever cells it is made of, and sets of different resolutions meet as runs.  Union, intersection, difference and depth
are one sweep over the runs' ends in each range of codes; ranges are fixed, so runs end at their borders and a task has a bounded number of ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import earth
from . import coverage

#: Bits of the codes within a range.
RANGE_BITS = 20
_MASKS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def degrees(level: int) -> float:
    return 360.0 / (1 << level)


def spread(x: Column) -> Column:
    """The bits of a number of 31 bits at every second place."""
    x = x.cast("long")
    for shift, mask in _MASKS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def code(row: Column, col: Column, level: int) -> Column:
    """The Morton code of a cell whose row and column count from the equator and Greenwich."""
    half = 1 << (level - 1)
    return spread(col + half).bitwiseOR(F.shiftleft(spread(row + half), 1))


def run_of(row: Column, col: Column, level: int, finest: int) -> tuple[Column, Column]:
    """First code, and the one after the last, of a cell at the finest level."""
    at, bits = code(row, col, level), 2 * (finest - level)
    return F.shiftleft(at, bits), F.shiftleft(at + 1, bits)


def segments(runs: DataFrame, by: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """(by, part, lo, hi, n0, n1): stretches of codes that as many runs (by, side 0 or 1, lo, hi) of either side cover, in order within each range ``part``.

    Ends at one code are added up before they are shuffled, so runs that many sensors share cost one row a task.
    """
    at = runs.withColumn("part", F.explode(F.sequence(F.shiftright("lo", bits), F.shiftright(F.col("hi") - 1, bits))))
    low, high = F.greatest("lo", F.shiftleft("part", bits)), F.least("hi", F.shiftleft(F.col("part") + 1, bits))
    side = [F.when(F.col("side") == i, 1).otherwise(0) for i in (0, 1)]
    ends = F.array(*(F.struct(c.alias("at"), (s * side[0]).alias("d0"), (s * side[1]).alias("d1")) for c, s in ((low, 1), (high, -1))))
    changes = at.select(*by, "part", F.explode(ends).alias("e")).groupBy(*by, "part", "e.at").agg(F.sum("e.d0").alias("d0"), F.sum("e.d1").alias("d1"))
    order = Window.partitionBy(*by, "part").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = changes.select(*by, "part", F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), F.sum("d0").over(so_far).alias("n0"), F.sum("d1").over(so_far).alias("n1"))
    return out.where("hi IS NOT NULL")


def _merged(parts: DataFrame, by: list[str], value: list[str]) -> DataFrame:
    """Neighbouring stretches of equal values as one."""
    order = Window.partitionBy(*by, "part").orderBy("lo")
    same = F.lag("hi").over(order) == F.col("lo")
    for v in value:
        same &= F.lag(v).over(order) == F.col(v)
    fresh = parts.withColumn("fresh", F.when(same, 0).otherwise(1))
    marked = fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "part", "island", *value).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*by, "lo", "hi", *value)


def combined(runs: DataFrame, by: list[str], keep: Callable[[Column, Column], Column], bits: int = RANGE_BITS) -> DataFrame:
    """(by, lo, hi): the codes where ``keep``, of how many runs of side 0 and of side 1 cover them, holds, as few runs as the ranges allow."""
    return _merged(segments(runs, by, bits).where(keep(F.col("n0"), F.col("n1"))), by, [])


def united(runs: DataFrame, by: list[str], bits: int = RANGE_BITS) -> DataFrame:
    return combined(runs, by, lambda a, b: a + b > 0, bits)


def common(runs: DataFrame, by: list[str], bits: int = RANGE_BITS) -> DataFrame:
    return combined(runs, by, lambda a, b: (a > 0) & (b > 0), bits)


def without(runs: DataFrame, by: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """What side 0 covers and side 1 doesn't."""
    return combined(runs, by, lambda a, b: (a > 0) & (b == 0), bits)


def depth(runs: DataFrame, by: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """(by, lo, hi, depth): how many runs cover each stretch."""
    return _merged(segments(runs, by, bits).where("n0 + n1 > 0").withColumn("depth", F.col("n0") + F.col("n1")), by, ["depth"])


def cells(runs: DataFrame, by: list[str], finest: int) -> DataFrame:
    """(by, level, row, col): the largest cells that runs are made of, at most three of a level at either end of a run."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = (batch.column(n).to_numpy() for n in ("lo", "hi"))
            at, found = np.arange(len(lo)), []
            for level in range(finest, -1, -1):
                low, high = (lo + 3) >> 2, hi >> 2  # in cells of the next level
                over = (low > high) | (level == 0)
                for a, b in ((lo, np.where(over, hi, low << 2)), (np.where(over, hi, high << 2), hi)):
                    n = np.maximum(b - a, 0)
                    which = np.repeat(np.arange(len(n)), n)
                    found.append((at[which], np.full(len(which), level, np.int32), a[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)))
                on = ~over & (low < high)
                at, lo, hi = at[on], low[on], high[on]
            which, level, at_code = (np.concatenate(x) for x in zip(*found, strict=True))
            half = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
            col, row = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
            for bit in range(finest):
                col |= (at_code >> (2 * bit) & 1) << bit
                row |= (at_code >> (2 * bit + 1) & 1) << bit
            own = batch.select(by).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(level), pa.array(row - half), pa.array(col - half)], names=[*by, "level", "row", "col"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.select(*by).schema.fields)
    return runs.mapInArrow(split, f"{kinds}{', ' if by else ''}level int, row long, col long")


def area(runs: DataFrame, by: list[str], finest: int) -> DataFrame:
    """(by, area_m2) on the sphere."""
    res = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    own = earth.MEAN**2 * F.radians(res) * (F.sin(F.radians((F.col("row") + 1) * res)) - F.sin(F.radians(F.col("row") * res)))
    return cells(runs, by, finest).groupBy(*by).agg(F.sum(own).alias("area_m2"))


def ring_cells(tasks: DataFrame, level: int, finest: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, level, row, col, az, dist_m, pass_max, keep): the cells that make up the rings of tasks (site_id, latitude, longitude, z_min, pass_max), of a level where
    they lie wholly inside, else of the finest: so rings of different levels neither overlap nor leave gaps but by half a finest cell.
    """
    res, fine, more = degrees(level), degrees(finest), 1 << (finest - level)
    half = earth.MEAN * np.radians(res) * 0.7072  # from a cell's centre to its corner, at most
    wide = tasks.withColumn("__wide", F.col("pass_max") + half)
    own = coverage.site_cells(wide, F.col("__wide"), res, keep=("latitude", "longitude", "z_min", "pass_max", *keep)).where(F.col("dist_m") > F.col("z_min") - half)
    inside = (F.col("dist_m") - half > F.col("z_min")) | (F.col("z_min") == 0)
    own = own.withColumn("__whole", inside & (F.col("dist_m") + half <= F.col("pass_max")))
    columns = ["site_id", "level", "row", "col", "az", "dist_m", "pass_max", *keep]
    whole = own.where("__whole").withColumn("level", F.lit(level)).select(columns)
    each = lambda c: F.explode(F.sequence(F.col(c) * more, F.col(c) * more + more - 1))
    parts = own.where("NOT __whole").drop("dist_m", "az").withColumn("row", each("row")).withColumn("col", each("col"))
    lat, lon = coverage.centre(F.col("row"), fine), coverage.centre(F.col("col"), fine)
    parts = parts.withColumn("dist_m", earth.sphere_distance(F.col("latitude"), F.col("longitude"), lat, lon)).where("dist_m <= pass_max AND (dist_m > z_min OR (z_min = 0 AND dist_m = 0))")
    return whole.unionByName(parts.withColumns({"az": earth.sphere_inverse(F.col("latitude"), F.col("longitude"), lat, lon), "level": F.lit(finest)}).select(columns))
