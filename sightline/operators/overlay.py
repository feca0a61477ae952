"""Overlay of polygons themselves: union, intersection, difference and depth of outlines in degrees, exact on their edges.

Every edge is cut by the rows and columns of a grid and weighs +1 where its polygon lies above it and -1 where it lies below.  What covers the lower left
corner of a square is a sum over the crossings of the row's lower line further west, one window over the occupied squares of a row; squares
between them that no edge touches come out of the same window as whole rectangles, so rows follow outlines and not areas.
Inside a square a sweep from west to east gives trapezoids.

Polygons are valid (rings don't cross, parts of one row don't overlap) and hold no pole.  Rings may be of either orientation, may share edges with others, and
may go past 180 degrees, where they are cut.  Null or empty polygons, rings of under three points and rings with null points cover nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import earth
from ..sources.files import dealt, saved
from .blocks import geodesic

#: Degrees of a square; pieces of edges in a square, above which it is cut to narrower strips.
SIZE, PIECES = 1.0, 256
#: Pairs of lines that a task looks at at a time.
PAIRS = 1_000_000
#: Degrees below which heights and widths count as nothing (a hundredth of a millimetre).
TINY = 1e-10
_EDGE = ("x0", "y0", "x1", "y1")
_SETS = {
    "depth": lambda n0, n1: (n0, n1),
    "union": lambda n0, n1: (int(n0 > 0 or n1 > 0), 0),
    "intersection": lambda n0, n1: (int(n0 > 0 and n1 > 0), 0),
    "difference": lambda n0, n1: (int(n0 > 0 and n1 <= 0), 0),
}


def edges(shapes: DataFrame, by: list[str]) -> DataFrame:
    """(by, x0, y0, x1, y1, d0, d1): edges of rows (by, side 0 or 1, polygons), from west to east, with their weight on either side."""
    ring = shapes.select(*by, "side", F.explode("polygons").alias("rings")).select(*by, "side", F.posexplode("rings").alias("at", "r"))
    ring = ring.where("size(r) > 2 AND NOT exists(r, p -> p IS NULL OR p.lon IS NULL OR p.lat IS NULL OR isnan(p.lon) OR isnan(p.lat))").withColumn("r", F.concat("r", F.slice("r", 1, 1)))
    n = F.greatest(F.size("r") - 1, F.lit(0))  # also told of rings that are left out
    pairs = F.arrays_zip(F.slice("r", F.lit(1), n).alias("a"), F.slice("r", F.lit(2), n).alias("b"))
    o = F.get("r", F.lit(0))
    turn = lambda e: (e["a"]["lon"] - o["lon"]) * (e["b"]["lat"] - o["lat"]) - (e["b"]["lon"] - o["lon"]) * (e["a"]["lat"] - o["lat"])
    turned = F.aggregate(pairs, F.lit(0.0), lambda total, e: total + turn(e))
    way = F.when((turned > 0) == (F.col("at") == 0), 1).otherwise(-1)
    e = ring.select(*by, "side", pairs.alias("pairs"), way.alias("way")).select(*by, "side", "way", F.explode("pairs").alias("e"))  # beside the explode it would be told anew for each edge
    a, b = F.col("e.a"), F.col("e.b")
    back = (a["lon"] > b["lon"]) | ((a["lon"] == b["lon"]) & (a["lat"] < b["lat"]))
    pick = lambda n: (F.when(back, b[n]).otherwise(a[n]).cast("double"), F.when(back, a[n]).otherwise(b[n]).cast("double"))
    (x0, x1), (y0, y1) = pick("lon"), pick("lat")
    d = F.when(back, -F.col("way")).otherwise(F.col("way"))
    weights = [F.when(F.col("side") == i, d).otherwise(0).cast("long").alias(f"d{i}") for i in (0, 1)]
    return e.select(*by, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), *weights).where("x0 < x1 OR y0 > y1")


def piece_edges(pieces: DataFrame, by: list[str], side: int = 0) -> DataFrame:
    """The edges of an overlay's pieces, each counted once, as one side of another overlay: sides that pieces share cancel there."""
    one, other = F.lit(1).cast("long"), F.lit(0).cast("long")
    line = lambda low, d: F.struct(F.col("x0").alias("x0"), F.col(f"{low}0").alias("y0"), F.col("x1").alias("x1"), F.col(f"{low}1").alias("y1"), d.alias("d"))
    # A west side heads south, an east side north; both are kept from north to south.
    wall = lambda x, i, d: F.struct(F.col(x).alias("x0"), F.col(f"hi{i}").alias("y0"), F.col(x).alias("x1"), F.col(f"lo{i}").alias("y1"), d.alias("d"))
    every = pieces.select(*by, F.explode(F.array(line("lo", one), line("hi", -one), wall("x0", 0, one), wall("x1", 1, -one))).alias("e")).select(*by, "e.*")
    weights = (F.col("d"), other) if side == 0 else (other, F.col("d"))
    return every.where("x0 < x1 OR y0 > y1").select(*by, *_EDGE, weights[0].alias("d0"), weights[1].alias("d1"))


def _at(x: Column, e: tuple[str, ...] = _EDGE) -> Column:
    x0, y0, x1, y1 = (F.col(c) for c in e)
    return y0 + (x - x0) * ((y1 - y0) / (x1 - x0))


def _crossings(e: DataFrame, by: list[str], size: float) -> DataFrame:
    """(by, row, x, d0, d1): where edges cross rows' lower lines, and by how much what lies just below the line changes there going east.

    What lies past 180 degrees on either side moves round, and the western end of the line starts with what that leaves open.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = (F.floor(low / size) + 1).cast("int"), F.floor(high / size).cast("int")
    rows = e.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    line = F.col("row") * size
    x = F.when(F.col("x0") == F.col("x1"), F.col("x0")).when(line == F.col("y1"), F.col("x1")).when(line == F.col("y0"), F.col("x0")).otherwise(F.col("x0") + (line - F.col("y0")) * ((F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))))
    sign = F.when(F.col("y0") > F.col("y1"), 1).otherwise(-1)
    found = rows.select(*by, "row", x.alias("x"), (F.col("d0") * sign).alias("d0"), (F.col("d1") * sign).alias("d1"))
    round_ = F.floor((F.col("x") + 180) / 360).cast("int")  # 0, or 1 and -1 past the date line
    home = F.struct((F.col("x") - 360.0 * round_).alias("x"), F.col("d0").alias("d0"), F.col("d1").alias("d1"))
    left_open = F.struct(F.lit(-180.0).alias("x"), (-round_ * F.col("d0")).alias("d0"), (-round_ * F.col("d1")).alias("d1"))
    both = found.select(*by, "row", F.explode(F.when(round_ == 0, F.array(home)).otherwise(F.array(home, left_open))).alias("c")).select(*by, "row", "c.*")
    return both.groupBy(*by, "row", "x").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).where("d0 <> 0 OR d1 <> 0")


def _pieces(e: DataFrame, by: list[str], size: float) -> DataFrame:
    """(by, row, col, x0, y0, x1, y1, d0, d1): edges cut by rows and columns; equal pieces are one, with their weights' sums.  Upright edges lie in no strip's inside."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.floor(low / size).cast("int")
    rows = e.where("x0 < x1").withColumn("row", F.explode(F.sequence(first, F.greatest(first, (F.ceil(high / size) - 1).cast("int")))))
    slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))

    def end(x: str, y: str) -> Column:
        to = F.least(F.greatest(F.col(y), F.col("row") * size), (F.col("row") + 1) * size)
        return F.struct(F.when(to == F.col(y), F.col(x)).otherwise(F.col("x0") + (to - F.col("y0")) / slope).alias("x"), to.alias("y"))

    cut = rows.select(*by, "row", "d0", "d1", end("x0", "y0").alias("a"), end("x1", "y1").alias("b"))
    cut = cut.select(*by, "row", "d0", "d1", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1")).where("x0 < x1")
    first = F.floor(F.col("x0") / size).cast("int")
    cut = cut.withColumn("col", F.explode(F.sequence(first, F.greatest(first, (F.ceil(F.col("x1") / size) - 1).cast("int")))))
    cut = _within(cut, F.col("col") * size, (F.col("col") + 1) * size)
    across = int(round(360 / size))
    shift = F.floor((F.col("col") + across / 2) / across).cast("int")
    cut = cut.withColumns({"col": F.col("col") - shift * across, "x0": F.col("x0") - 360.0 * shift, "x1": F.col("x1") - 360.0 * shift})
    return cut.groupBy(*by, "row", "col", *_EDGE).agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1")).where("d0 <> 0 OR d1 <> 0")


def _within(e: DataFrame, left: Column, right: Column) -> DataFrame:
    """Edges from a western to an eastern border; what both sides of a border have ends at the same height."""
    a, b = F.greatest("x0", left), F.least("x1", right)
    ya, yb = F.when(a == F.col("x0"), F.col("y0")).otherwise(_at(a)), F.when(b == F.col("x1"), F.col("y1")).otherwise(_at(b))
    return e.withColumns({"x0": a, "y0": ya, "x1": b, "y1": yb}).where("x0 < x1")


def _laid(e: DataFrame, by: list[str], size: float, pieces: int) -> tuple[DataFrame, DataFrame]:
    """(rest, full): the rectangles of a row that no edge touches (by, row, right, next, n0, n1), and the items of strips, pieces of edges and crossings of the lower line with what
    covers the strip's lower left corner, in tasks, strip by strip."""
    across = int(round(360 / size))
    if abs(across * size - 360) > 1e-9 or across % 2:
        raise ValueError("size must divide 180 degrees")
    e = saved(e, "edges")  # read twice
    cut, crossed = saved(_pieces(e, by, size), "pieces"), _crossings(e, by, size).withColumn("col", F.floor(F.col("x") / size).cast("int"))
    hot = cut.groupBy(*by, "row", "col").agg(F.count("*").alias("n")).where(F.col("n") > pieces).withColumn("strips", F.pow(2.0, F.ceil(F.log2(F.col("n") / pieces))).cast("int"))
    hot = hot.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("row").alias("__row"), F.col("col").alias("__col"), "strips")
    key = [*(F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by), F.col("row") == F.col("__row"), F.col("col") == F.col("__col")]
    gone = (*(f"__{b}" for b in by), "__row", "__col")
    cut, crossed = (t.join(hot, key, "left").drop(*gone).withColumn("strips", F.coalesce("strips", F.lit(1))) for t in (cut, crossed))
    width = size / F.col("strips")
    strip = lambda x: F.least(F.greatest(F.floor((x - F.col("col") * size) / width), F.lit(0)), F.col("strips") - 1).cast("int")
    left, right = F.col("col") * size + F.col("strip") * width, F.col("col") * size + (F.col("strip") + 1) * width
    cut = _within(cut.withColumn("strip", F.explode(F.sequence(strip(F.col("x0")), strip(F.col("x1"))))), left, right)
    none = F.lit(None).cast("double")
    cut = cut.select(*by, "row", left.alias("left"), right.alias("right"), *_EDGE, "d0", "d1")
    crossed = crossed.withColumn("strip", strip(F.col("x"))).select(*by, "row", left.alias("left"), right.alias("right"), F.col("x").alias("x0"), none.alias("y0"), none.alias("x1"), none.alias("y1"), "d0", "d1")
    items = saved(cut.unionByName(crossed), "items")

    opens = [F.sum(F.when(F.col("x1").isNull(), F.col(d)).otherwise(0)).alias(f"s{i}") for i, d in enumerate(("d0", "d1"))]
    line = Window.partitionBy(*by, "row").orderBy("left")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    strips = items.groupBy(*by, "row", "left", "right").agg(*opens)
    strips = strips.withColumns({f"b{i}": F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)) for i in (0, 1)} | {"next": F.coalesce(F.lead("left").over(line), F.lit(180.0))})
    strips = saved(strips, "strips")

    rest = strips.where(F.col("next") > F.col("right") + TINY).withColumns({f"n{i}": F.col(f"b{i}") + F.col(f"s{i}") for i in (0, 1)})

    starts = strips.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("row").alias("__row"), F.col("left").alias("__left"), "b0", "b1")
    full = items.join(starts, [*(F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by), F.col("row") == F.col("__row"), F.col("left") == F.col("__left")]).drop(*(f"__{b}" for b in by), "__row", "__left")
    # Named number of tasks: strips are few bytes and much work, which adaptive execution would put into one task.
    tasks = max(1, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = full.withColumn("__group", F.xxhash64(*by, "row", "left")).repartition(tasks, "__group").sortWithinPartitions("__group", *by, "row", "left")
    return rest, full


def _by_strip(batches: Iterator[pa.RecordBatch], done: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``done`` of tables of whole strips and where each ends; a task holds a batch and one strip."""
    kept: pa.Table | None = None  # of the strip that the next batch may go on with
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if kept is None else pa.concat_tables([kept, t])
        if not len(t):
            continue
        new = np.zeros(len(t) - 1, bool)
        for n in ("__group", "row", "left"):
            v = t.column(n).to_numpy()
            new |= v[1:] != v[:-1]
        stops = [int(i) + 1 for i in np.flatnonzero(new)]
        if stops:
            yield from done(t, stops)
        kept = t.slice(stops[-1] if stops else 0)
    if kept is not None and len(kept):
        yield from done(kept, [len(kept)])


_COLUMNS = ("row", "left", "right", *_EDGE, "d0", "d1", "b0", "b1")


def overlay(e: DataFrame, by: list[str], what: str = "depth", size: float = SIZE, pieces: int = PIECES) -> DataFrame:
    """(by, x0, x1, lo0, lo1, hi0, hi1, n0, n1): trapezoids between two longitudes, from the lower line's latitudes at both to the upper line's.

    ``e`` are edges (see ``edges``).  For ``depth`` n0 and n1 count the polygons of either side; ``union``, ``intersection`` and ``difference`` (side 0 without side 1) have n0 = 1.
    Trapezoids don't overlap.  ``size`` divides 360; a square with more than so many ``pieces`` of edges becomes so many more strips, so a
    task's work follows the edges that one strip of a row has.  No result depends on ``size`` or ``pieces`` but in where trapezoids are cut.
    """
    if what not in _SETS:
        raise ValueError(f"no such set: {what}")
    rest, full = _laid(e, by, size, pieces)
    inside = {"depth": "n0 <> 0 OR n1 <> 0", "union": "n0 > 0 OR n1 > 0", "intersection": "n0 > 0 AND n1 > 0", "difference": "n0 > 0 AND n1 <= 0"}[what]
    counts = ("n0", "n1") if what == "depth" else ("1L", "0L")
    rest = rest.where(inside).selectExpr(*(f"`{b}`" for b in by), "right AS x0", "next AS x1", f"row * {size}D AS lo0", f"row * {size}D AS lo1", f"(row + 1) * {size}D AS hi0", f"(row + 1) * {size}D AS hi1", f"{counts[0]} AS n0", f"{counts[1]} AS n1")

    schema, label = rest.schema, _SETS[what]
    names = schema.names

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table, stops: list[int]) -> Iterator[pa.RecordBatch]:
            arrays = {n: t.column(n).to_numpy() for n in _COLUMNS}
            out: list[tuple] = []
            of: list[int] = []
            for start, stop in zip([0, *stops], stops):
                bottom = float(arrays["row"][start]) * size
                found = _strip({n: a[start:stop] for n, a in arrays.items()}, bottom, bottom + size, label)
                out += found
                of += [start] * len(found)
            if out:
                values = dict(zip(("x0", "x1", "lo0", "lo1", "hi0", "hi1", "n0", "n1"), zip(*out)))
                columns = [t.column(n).take(pa.array(of)).combine_chunks() if n in by else pa.array(values[n], pa.int64() if n in ("n0", "n1") else pa.float64()) for n in names]
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

        return _by_strip(batches, done)

    return full.mapInArrow(swept, schema).unionByName(rest)


def _strip(g: dict[str, np.ndarray], bottom: float, top: float, label) -> list[tuple]:
    """Trapezoids of one strip: between two ends or crossings next to each other no lines cross, so the weights add up from the bottom."""
    left, right = float(g["left"][0]), float(g["right"][0])
    is_piece = ~np.isnan(g["x1"])
    x0, y0, x1, y1 = (g[n][is_piece] for n in _EDGE)
    slope = (y1 - y0) / (x1 - x0)
    weights = np.column_stack([g["d0"], g["d1"]]).astype(np.int64)
    d, cx, cd = weights[is_piece], g["x0"][~is_piece], weights[~is_piece]
    order = np.argsort(cx)
    cx, cd = cx[order], np.vstack([np.zeros((1, 2), np.int64), np.cumsum(cd[order], axis=0)])
    base = np.array([g["b0"][0], g["b1"][0]], np.int64)
    stops = np.unique(np.clip(np.concatenate([[left, right], x0, x1, cx]), left, right))
    stops = stops[np.concatenate([[True], np.diff(stops) > TINY / 100])].tolist()
    xs, ys, rises = x0.tolist(), y0.tolist(), slope.tolist()
    out: list[tuple] = []
    open_: dict[tuple, float] = {}

    def height(i: int, x: float) -> float:
        return bottom if i == -1 else top if i == -2 else ys[i] + (x - xs[i]) * rises[i]

    def close(found: dict[tuple, float], x: float) -> None:
        for (low, high, n), since in open_.items():
            if (low, high, n) not in found:
                out.append((since, x, height(low, since), height(low, x), height(high, since), height(high, x), *n))

    for a, b in zip(stops[:-1], stops[1:]):
        middle = (a + b) / 2
        active = np.flatnonzero((x0 <= middle) & (x1 >= middle))
        start = base + cd[np.searchsorted(cx, middle)]
        while a < b:
            step = min(TINY, (b - a) / 4)
            y_a, y_b = (y0[active] + (x - x0[active]) * slope[active] for x in (a + step, b))
            at = np.lexsort((y_b, y_a))
            y_b, lines = y_b[at], active[at]
            swap = np.flatnonzero(y_b[:-1] > y_b[1:] + TINY / 100)  # the first crossing is one of neighbours
            till = b
            if len(swap):
                under, over = lines[swap], lines[swap + 1]
                gap = height_difference(x0, y0, slope, under, over, a)
                x = a + gap / (slope[under] - slope[over])
                x = x[(x > a + step) & (x < b - step)]
                till = float(x.min()) if len(x) else b
            n = (start + np.cumsum(d[lines], axis=0)).tolist()
            found: dict[tuple, float] = {}
            low, state = -1, label(*map(int, start))
            for i, line in enumerate([*lines.tolist(), -2]):
                following = label(*n[i]) if line != -2 else None
                if following == state:
                    continue
                if state != (0, 0) and (height(line, a) - height(low, a) > TINY or height(line, till) - height(low, till) > TINY):
                    found[low, line, state] = open_.get((low, line, state), a)
                low, state = line, following
            close(found, a)
            open_ = found
            a = till
    close({}, right)
    return out


def areas(e: DataFrame, by: list[str], sets: bool = False, size: float = SIZE, pieces: int = PIECES) -> DataFrame:
    """(by, n0, n1, m2): square metres on the sphere of what ``overlay`` covers so often, without its pieces; with ``sets`` n0 and n1 are 1 where any polygon of the side is.

    An area is a sum over lines: each stretch of a line between two changes of what lies below it counts for what is below and against what is above.  So of a strip's lines
    only pairs are looked at, all at once, and the work follows pairs; pieces and the sweep that finds them follow crossings times lines.
    """
    rest, full = _laid(e, by, size, pieces)
    shape = [F.lit(0.0).alias("x0"), (F.col("next") - F.col("right")).alias("x1"), *((F.col("row") * size).alias(f"lo{i}") for i in (0, 1)), *(((F.col("row") + 1) * size).alias(f"hi{i}") for i in (0, 1))]
    counts = [(F.col(n) > 0).cast("long").alias(n) if sets else F.col(n).cast("long").alias(n) for n in ("n0", "n1")]
    rest = rest.select(*by, *counts, *shape).select(*by, "n0", "n1", piece_area().alias("m2"))
    names = [*by, "n0", "n1", "m2"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table, stops: list[int]) -> Iterator[pa.RecordBatch]:
            arrays, of, out = {n: t.column(n).to_numpy() for n in _COLUMNS}, [], []
            for start, stop in zip([0, *stops], stops):
                out.append(_strip_areas({n: a[start:stop] for n, a in arrays.items()}, float(arrays["row"][start]) * size, size, sets))
                of.append(np.full(len(out[-1][2]), start))
            n0, n1, m2 = (np.concatenate(v) for v in zip(*out, strict=True))
            own = [t.column(n).take(pa.array(np.concatenate(of))).combine_chunks() for n in by]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own), pa.array(n0), pa.array(n1), pa.array(m2)], names)

        return _by_strip(batches, done)

    found = full.mapInArrow(summed, rest.select(names).schema).unionByName(rest.select(names))
    return found.where("n0 <> 0 OR n1 <> 0").groupBy(*by, "n0", "n1").agg(F.sum("m2").alias("m2"))


def _strip_areas(g: dict[str, np.ndarray], bottom: float, size: float, sets: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n0, n1, square metres) of one strip: integrals of the sine of latitude below lines, over that of the lower line, for what lies below them and against what lies above."""
    left, right = float(g["left"][0]), float(g["right"][0])
    is_piece = ~np.isnan(g["x1"])
    x0, y0, x1, y1 = (g[n][is_piece] for n in _EDGE)
    slope = (y1 - y0) / (x1 - x0)
    weights = np.column_stack([g["d0"], g["d1"]]).astype(np.int64)
    d, cx, cd = weights[is_piece], np.clip(g["x0"][~is_piece], left, right), weights[~is_piece]
    order = np.argsort(cx)
    cx, cd = cx[order], cd[order]
    base = np.array([g["b0"][0], g["b1"][0]], np.int64)
    so_far = np.vstack([base, base + np.cumsum(cd, axis=0)])
    n = len(x0)
    stretches = []  # (line, from, to, what is below)

    def along(line: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray, which: np.ndarray, x: np.ndarray, change: np.ndarray) -> None:
        """Stretches of lines between two places, from what lies below at the start and its changes."""
        at = np.lexsort((x, which))
        which, x, change = which[at], x[at], change[at]
        first = np.searchsorted(which, np.arange(len(line)))
        count = np.diff(np.append(first, len(which)))
        place = first + np.arange(len(line))  # a line's first stretch among all
        own = np.repeat(np.arange(len(line)), count + 1)
        steps, low = np.empty((len(own), 2), np.int64), np.empty(len(own))
        rest = np.ones(len(own), bool)
        rest[place] = False
        steps[rest], low[rest] = change, x
        total = np.zeros((len(line), 2), np.int64)
        sums = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(change, axis=0)])
        total[1:] = (sums[first[1:]] - sums[first[:-1]])[: len(line) - 1]
        steps[place], low[place] = start, begin
        steps[place[1:]] -= start[:-1] + total[1:]  # each line's sums begin anew
        state = np.cumsum(steps, axis=0)
        high = np.append(low[1:], 0.0)
        high[np.append(place[1:], len(own)) - 1] = end
        stretches.append((line[own], low, high, state))

    # The upper line, below which everything is that begins and has not ended.
    x, change = np.concatenate([cx, x0, x1]), np.concatenate([cd, d, -d])
    along(np.array([-1]), np.array([left]), np.array([right]), base[None], np.zeros(len(x), np.int64), x, change)
    for low in range(0, n, max(1, PAIRS // max(n, 1))):
        i = np.arange(low, min(n, low + max(1, PAIRS // n)))
        a, b = np.maximum(x0[i, None], x0), np.minimum(x1[i, None], x1)
        mine, other = np.nonzero((b > a) & (np.arange(n) != i[:, None]))
        a, b, line = a[mine, other], b[mine, other], i[mine]
        over = lambda x: (y0[line] + (x - x0[line]) * slope[line]) - (y0[other] + (x - x0[other]) * slope[other])  # noqa: E731, B023
        at_a, at_b = over(a), over(b)
        flat = (at_a == 0) & (at_b == 0)  # one line twice: in the order of their numbers
        cross = a + np.where(at_a * at_b < 0, at_a / np.where(at_a == at_b, 1, at_a - at_b), 0) * (b - a)
        begin, end = np.where((at_a < 0) & (at_b > 0), cross, a), np.where((at_a > 0) & (at_b < 0), cross, b)
        below = (np.where(flat, other < line, (at_a > 0) | (at_b > 0))) & (end > begin)
        mine, line, other, begin, end = mine[below], line[below], other[below], begin[below], end[below]
        whole = begin <= x0[line]
        start = so_far[np.searchsorted(cx, x0[i], "right")].copy()
        for k in (0, 1):
            start[:, k] += np.bincount(mine[whole], d[other[whole], k], len(i)).astype(np.int64)
        later, gone = ~whole, end < x1[line]
        f, u = np.searchsorted(cx, x0[i], "right"), np.searchsorted(cx, x1[i], "left")
        size_ = np.maximum(u - f, 0)
        at = np.repeat(f, size_) + np.arange(size_.sum()) - np.repeat(np.cumsum(size_) - size_, size_)
        along(i, x0[i], x1[i], start, np.concatenate([mine[later], mine[gone], np.repeat(np.arange(len(i)), size_)]), np.concatenate([begin[later], end[gone], cx[at]]), np.concatenate([d[other[later]], -d[other[gone]], cd[at]]))
    line, low, high, state = (np.concatenate(v) for v in zip(*stretches, strict=True))
    real = high > low
    line, low, high, state = line[real], low[real], high[real], state[real]
    top = line < 0
    y_a, y_b = (np.where(top, bottom + size, np.append(y0, 0.0)[line] + (x - np.append(x0, 0.0)[line]) * np.append(slope, 0.0)[line]) for x in (low, high))
    middle, half = np.radians((y_a + y_b) / 2), np.radians((y_b - y_a) / 2)
    small = np.abs(half) < 1e-9
    under = np.radians(high - low) * (np.sin(middle) * np.where(small, 1.0, np.sin(half) / np.where(small, 1.0, half)) - math.sin(math.radians(bottom)))
    above = state + np.where(top[:, None], 0, np.vstack([d, np.zeros((1, 2), np.int64)])[line])
    state, value = np.vstack([state, above[~top]]), np.concatenate([under, -under[~top]])
    if sets:
        state = (state > 0).astype(np.int64)
    least = state.min(axis=0)
    wide = int(state[:, 1].max() - least[1]) + 1
    code, of = np.unique((state[:, 0] - least[0]) * wide + state[:, 1] - least[1], return_inverse=True)
    return code // wide + least[0], code % wide + least[1], np.bincount(of, value) * earth.MEAN**2


def height_difference(x0: np.ndarray, y0: np.ndarray, slope: np.ndarray, under: np.ndarray, over: np.ndarray, x: float) -> np.ndarray:
    """How far lines lie above others at a longitude."""
    return (y0[over] + (x - x0[over]) * slope[over]) - (y0[under] + (x - x0[under]) * slope[under])


def piece_area() -> Column:
    """Square metres of an overlay's piece on the sphere, whose sides are straight in degrees."""

    def below(low: str) -> Column:
        middle, half = F.radians((F.col(f"{low}0") + F.col(f"{low}1")) / 2), F.radians((F.col(f"{low}1") - F.col(f"{low}0")) / 2)
        return F.sin(middle) * F.when(F.abs(half) < 1e-9, 1.0).otherwise(F.sin(half) / half)

    return earth.MEAN**2 * F.radians(F.col("x1") - F.col("x0")) * (below("hi") - below("lo"))


def circles(sites: DataFrame, by: list[str], corners: int = 128) -> DataFrame:
    """(by, polygons): the geodesic circle of so many corners round each row's latitude and longitude at its ``dist`` in metres."""
    kind = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))))
    rows = dealt(sites.select(*by, *(F.col(c).cast("double") for c in ("latitude", "longitude", "dist"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lat, lon, dist = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False).astype(float), corners) for c in ("latitude", "longitude", "dist"))
            lat2, lon2 = geodesic(lat, lon, np.tile(np.arange(corners) * (360.0 / corners), n), dist)
            found = pa.StructArray.from_arrays([pa.array(lon2), pa.array(lat2)], names=["lon", "lat"])
            for step, many in ((corners, n * corners), (1, n), (1, n)):  # corners to rings, rings to parts, parts to polygons
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, many + 1, step), pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*batch.select(by).columns, found], names=[*by, "polygons"])

    return rows.mapInArrow(run, T.StructType([*rows.select(*by).schema.fields, T.StructField("polygons", kind)]))
