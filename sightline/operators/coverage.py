"""Coverage as sets of cells: union, depth, intersection, difference, area, clipping, and outlines for export.

Cells are those of one global grid.  A cell's state is looked up from its own side: of each sensor all cells within
reach, the ray and sample that a cell's centre falls on, and the surface there, so nothing between rays is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import earth
from ..sources.files import few, saved

#: Corners on the side of the blocks that outlines are followed in by one task.
SIDE = 256


def centre(index: Column, res: float) -> Column:
    return (index + 0.5) * res


def site_cells(sites: DataFrame, reach: Column, res: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, row, col, az, dist_m, keep) for every cell of so many degrees whose centre lies within reach of a site (latitude, longitude).

    Only the rows and columns that a circle on the sphere spans are listed; columns wrap at the date line, and round a pole all are taken.
    """
    across = int(round(360 / res))
    d = reach / earth.MEAN
    top = F.radians(F.abs(F.col("latitude"))) + d
    wide = F.when(top < math.pi / 2, F.degrees(F.asin(F.least(F.lit(1.0), F.sin(d) / F.cos(F.radians("latitude")))))).otherwise(180.0)
    index = lambda v: F.floor(v / res).cast("int")
    low, high = F.greatest(F.col("latitude") - F.degrees(d), F.lit(-90.0)), F.least(F.col("latitude") + F.degrees(d), F.lit(90.0) - res / 2)
    first = index(F.col("longitude") - wide)
    last = F.least(index(F.col("longitude") + wide), first + (across - 1))
    rows = sites.withColumn("__reach", reach).withColumn("__cols", F.sequence(first, last)).withColumn("row", F.explode(F.sequence(index(low), index(high)))).withColumn("col", F.explode("__cols"))
    lat, lon = centre(F.col("row"), res), centre(F.col("col"), res)
    rows = rows.withColumn("dist_m", earth.sphere_distance(F.col("latitude"), F.col("longitude"), lat, lon)).where(F.col("dist_m") <= F.col("__reach"))
    az = earth.sphere_inverse(F.col("latitude"), F.col("longitude"), lat, lon)
    wrapped = (F.pmod(F.col("col") + across // 2, F.lit(across)) - across // 2).cast("int")
    return rows.select("site_id", "row", wrapped.alias("col"), az.alias("az"), "dist_m", *keep)


def cells_of_site(latitude: float, longitude: float, reach: float, res: float, at_once: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """``site_cells`` of one site in a task: (row, col, az, dist_m), some lines of cells at a time."""
    across, d = int(round(360 / res)), reach / earth.MEAN
    wide = math.degrees(math.asin(min(1.0, math.sin(d) / math.cos(math.radians(latitude))))) if abs(math.radians(latitude)) + d < math.pi / 2 else 180.0
    index = lambda v: math.floor(v / res)
    first = index(longitude - wide)
    cols = np.arange(first, min(index(longitude + wide), first + across - 1) + 1)
    lines = np.arange(index(max(latitude - math.degrees(d), -90.0)), index(min(latitude + math.degrees(d), 90.0 - res / 2)) + 1)
    lon = (cols + 0.5) * res
    b, turn, p1 = np.sin(np.radians(lon - longitude) / 2), np.radians(lon - longitude), np.radians(latitude)
    for low in range(0, len(lines), max(1, at_once // len(cols))):
        row = lines[low : low + max(1, at_once // len(cols)), None]
        lat = (row + 0.5) * res
        p2, a = np.radians(lat), np.sin(np.radians(lat - latitude) / 2)
        dist = 2 * earth.MEAN * np.arcsin(np.sqrt(a * a + np.cos(p1) * np.cos(p2) * b * b))
        y, x = np.nonzero(dist <= reach)
        way = np.arctan2((np.sin(turn) * np.cos(p2))[y, x], (np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(turn))[y, x])
        yield row[y, 0].astype(np.int32), ((cols[x] + across // 2) % across - across // 2).astype(np.int32), np.where(way < 0, way + 2 * math.pi, way), dist[y, x]


def gathered(cells: DataFrame, rays: DataFrame, ray: list[str], values: tuple[str, ...] = ("mva",)) -> DataFrame:
    """``cells`` (ray columns, r_idx, ...) with mva from ``rays`` (ray columns, mva array, or arrays of other ``values``): one equi-join by ray; samples beyond a ray's end give no row.

    Rays are many times the bytes of the table that they are made of, which the optimiser can't tell, so it must not broadcast them:
    they stay as they were dealt out for the sweep, and the cells come to them.
    """
    found = cells.join(rays.select(*ray, *(F.col(v).alias(f"__{v}") for v in values)).hint("merge"), ray)
    return found.withColumns({v: F.get(f"__{v}", F.col("r_idx")) for v in values}).drop(*(f"__{v}" for v in values)).where(f"{values[0]} IS NOT NULL")


def seen_at(cells: DataFrame, altitudes: DataFrame, *by: str) -> DataFrame:
    """(by, alt_m): keys of cells with the altitudes of targets seen over them; the lowest surface of each key decides, so altitudes come after the shuffle."""
    lowest = cells.groupBy(*by).agg(F.min("mva").alias("lowest"))
    return lowest.join(few(altitudes), F.col("lowest") <= F.col("alt_m").cast("float")).drop("lowest")


def united(cells: DataFrame, altitudes: list[float]) -> DataFrame:
    """(alt_m, row, col, depth): cells that any sensor sees and how many do, of rows (site_id, row, col, mva), one for each sensor and cell."""
    counts = [F.count_if(F.col("mva") <= F.lit(float(a)).cast("float")).alias(f"n{i}") for i, a in enumerate(altitudes)]
    each = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alt_m"), F.col(f"n{i}").alias("depth")) for i, a in enumerate(altitudes))))
    return cells.groupBy("row", "col").agg(*counts).select("row", "col", each.alias("e")).select("e.alt_m", "row", "col", "e.depth").where("depth > 0")


def ring_clipped(cells: DataFrame, low: Column, high: Column) -> DataFrame:
    return cells.where((F.col("r_m") >= low) & (F.col("r_m") <= high))


def cell_area(row: Column, res: float) -> Column:
    """Square metres of a cell on the sphere; cells narrow towards the poles."""
    return earth.MEAN**2 * math.radians(res) * (F.sin(F.radians((row + 1) * res)) - F.sin(F.radians(row * res)))


def area(cells: DataFrame, res: float, *by: str) -> DataFrame:
    return cells.groupBy(*by).agg(F.count("*").alias("cells"), F.sum(cell_area(F.col("row"), res)).alias("area_m2"))


def in_polygon_circle(cells: DataFrame, sites: DataFrame, range_m: Column, res: float, corners: int = 128) -> DataFrame:
    """``cells`` (site_id, row, col, az, ...) whose centre lies in the polygon of so many geodesic corners round the site at a range.

    A site's cells come to its ring, which is not broadcast: corners are many times the bytes of the sites, which the optimiser can't tell.
    The polygon is convex in degrees, counted from the site so that it may cross the date line, and a point can only be beyond the edges next to its own direction, so three are tested.
    """
    spread = sites.select("site_id", "latitude", "longitude", range_m.cast("double").alias("dist"), F.explode(F.sequence(F.lit(0), F.lit(corners - 1))).alias("i")).withColumn("az", F.col("i") * (360.0 / corners))
    corner = F.struct("i", (F.col("lon2") - F.col("longitude")).alias("x"), F.col("lat2").alias("y"))
    ring = earth.with_geodesic(spread, "latitude", "longitude", "az", "dist").groupBy("site_id").agg(F.array_sort(F.collect_list(corner)).alias("__ring"), F.first("longitude").alias("__lon"))
    x, y = F.pmod(centre(F.col("col"), res) - F.col("__lon") + 180, F.lit(360.0)) - 180, centre(F.col("row"), res)
    at = F.floor(F.col("az") / (2 * math.pi / corners)).cast("int")

    def inside(step: Column) -> Column:
        a, b = F.get("__ring", F.pmod(at + step, F.lit(corners))), F.get("__ring", F.pmod(at + step + 1, F.lit(corners)))
        return (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) <= 0

    return cells.join(ring.hint("merge"), "site_id").where(inside(F.lit(-1)) & inside(F.lit(0)) & inside(F.lit(1))).drop("__ring", "__lon")


def paths(cells: DataFrame, by: list[str], side: int = SIDE) -> DataFrame:
    """(by, r0, c0, turn, r1, c1, end_turn, closed, bends, area): the outlines of each group's cells, with the set on the left, cut where they leave a block of corners.

    ``cells`` are a set: each once.  An edge begins at a corner and is named by its direction there: turn 0 east, 1 north, 2 west, 3 south.  What
    begins and ends at a corner follows from the four cells round it, so a block needs its own cells and those at two of its sides.  Where cells touch
    at a corner only, the sharpest left turn comes next.  A task has one block; a path is a row with its bends (r, c, turn): ``closed`` if it is a whole ring.
    """
    block = lambda c: F.explode(F.array_distinct(F.array(F.floor(F.col(c) / side), F.floor((F.col(c) + 1) / side))))
    dealt = cells.select(*by, F.col("row").cast("int"), F.col("col").cast("int")).withColumn("__y", block("row")).withColumn("__x", block("col"))
    bend = pa.struct([(n, pa.int32()) for n in ("r", "c", "turn")])

    def cut(table: pa.Table) -> pa.Table:
        row, col = (table.column(n).to_numpy().astype(np.int64) for n in ("row", "col"))
        (r_low, r_high), (c_low, c_high) = ((max(b * side, v.min()), min(b * side + side - 1, v.max() + 1)) for b, v in ((table.column(n)[0].as_py(), v) for n, v in (("__y", row), ("__x", col))))
        h, w = r_high - r_low + 1, c_high - c_low + 1
        grid = np.zeros((h + 1, w + 1), bool)
        grid[row - r_low + 1, col - c_low + 1] = True
        sw, se, nw, ne = grid[:-1, :-1], grid[:-1, 1:], grid[1:, :-1], grid[1:, 1:]
        out, ending = np.stack([ne & ~se, nw & ~ne, sw & ~nw, se & ~sw]), np.stack([nw & ~sw, sw & ~se, se & ~ne, ne & ~nw])
        turn, y, x = np.nonzero(out)
        n = len(turn)
        number = np.full(out.shape, -1)
        number[out] = np.arange(n)
        to_y, to_x = y + np.array([0, 1, 0, -1])[turn], x + np.array([1, 0, -1, 0])[turn]
        inside = np.flatnonzero((to_y >= 0) & (to_y < h) & (to_x >= 0) & (to_x < w))
        t, ends = turn[inside], (to_y[inside], to_x[inside])
        onward = np.where(out[((t + 1) % 4, *ends)], (t + 1) % 4, np.where(out[(t, *ends)], t, (t + 3) % 4))
        before = np.full(n, -1)
        before[number[(onward, *ends)]] = inside

        def headed() -> tuple[np.ndarray, np.ndarray]:
            head, away = np.where(before < 0, np.arange(n), before), (before >= 0).astype(np.int64)
            for _ in range(n.bit_length()):
                head, away = head[head], away + away[head]
            return head, away

        head, away = headed()
        whole = np.zeros(n, bool)
        if (round_ := before[head] >= 0).any():  # rings within the block begin at their first edge
            least, back = np.arange(n), np.where(round_, before, np.arange(n))
            for _ in range(n.bit_length()):
                least, back = np.minimum(least, least[back]), back[back]
            whole[round_ & (least == np.arange(n))] = True
            before[whole] = -1
            head, away = headed()
        order = np.lexsort((away, head))
        first = np.flatnonzero(np.diff(head[order], prepend=-1))
        last = np.append(first[1:], n)[: len(first)]  # none where all cells are within the set
        r, c = y[order] + r_low, x[order] + c_low
        r1, c1, turn = to_y[order] + r_low, to_x[order] + c_low, turn[order]
        bent = ~ending[(turn, y[order], x[order])]
        sums = np.concatenate([[0], np.cumsum(bent)])
        bends = pa.StructArray.from_arrays([pa.array(v[bent].astype(np.int32)) for v in (r, c, turn)], fields=list(bend))
        ends = np.append(sums[first], sums[-1]).astype(np.int32)
        ints = {"r0": r[first], "c0": c[first], "turn": turn[first], "r1": r1[last - 1], "c1": c1[last - 1], "end_turn": turn[last - 1]}
        area = np.add.reduceat(c * r1 - c1 * r, first) if n else np.zeros(0, np.int64)
        keys = table.select(by).take(pa.array(np.zeros(len(first), np.int64)))
        own = [*keys.columns, *(pa.array(v.astype(np.int32)) for v in ints.values()), pa.array(whole[order][first]), pa.ListArray.from_arrays(pa.array(ends), bends), pa.array(area)]
        return pa.table(own, names=[*by, *ints, "closed", "bends", "area"])

    ints = [T.StructField(n, T.IntegerType()) for n in ("r0", "c0", "turn", "r1", "c1", "end_turn")]
    corner = T.StructType([T.StructField(n, T.IntegerType()) for n in ("r", "c", "turn")])
    more = [T.StructField("closed", T.BooleanType()), T.StructField("bends", T.ArrayType(corner)), T.StructField("area", T.LongType())]
    return dealt.groupBy(*by, "__y", "__x").applyInArrow(cut, T.StructType([*cells.select(*by).schema.fields, *ints, *more]))


def outlines(cells: DataFrame, by: list[str], side: int = SIDE) -> DataFrame:
    """Closed rings round each group's cells: (by, ring, hole, vertices, edges, twice_area).  A row is one ring; its vertices are its bends, the first again at the end.

    Rings have the set on their left, so holes turn the other way round.  Columns are counted from Greenwich, so what crosses the date line
    has a ring on either side that ends there.  A ring is named by the least of its bends' hashes, whatever the partitioning and the blocks.

    Each path across blocks is joined with the one that follows; then pointers double until every path knows the least bend of its ring and how far
    it is.  So rounds grow with the logarithm of the blocks that a ring crosses, and only rows for crossings are shuffled in them, not edges.
    """
    hashes = F.transform("bends", lambda b: F.xxhash64(*by, b["r"], b["c"], b["turn"]))
    p = paths(cells, by, side).withColumn("__h", hashes).withColumn("own", F.array_min("__h"))
    p = saved(p.withColumn("at", F.array_position("__h", F.col("own")).cast("int")).withColumn("id", F.xxhash64(*by, "r0", "c0", "turn")).drop("__h"), "paths")
    open_ = p.where("NOT closed")
    after = open_.select(*(F.col(b).alias(f"__{b}") for b in by), F.col("r0").alias("__r"), F.col("c0").alias("__c"), F.col("turn").alias("next_turn"), F.col("id").alias("next"))
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    joined = open_.select(*by, "id", "end_turn", "r1", "c1", "own").join(after, [*same, F.col("r1") == F.col("__r"), F.col("c1") == F.col("__c")])
    left = F.pmod(F.col("next_turn") - F.col("end_turn"), F.lit(4))  # 0: straight on, 1: left, 3: right
    none = F.lit((1 << 63) - 1)  # a path without a bend
    hops = saved(joined.groupBy("id").agg(F.min_by("next", left).alias("next"), F.coalesce(F.first("own"), none).alias("low")).withColumn("away", F.lit(0)), "hops")
    span = 1

    def doubled(hops: DataFrame, span: int) -> DataFrame:
        ahead = hops.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("low").alias("__low"), F.col("away").alias("__away"))
        better = F.col("__low") < F.col("low")
        return hops.join(ahead, "next").select("id", F.col("__next").alias("next"), F.when(better, F.col("__low")).otherwise(F.col("low")).alias("low"), F.when(better, F.col("__away") + span).otherwise(F.col("away")).alias("away"), better.alias("moved"))

    while True:  # two doublings a table
        step = saved(doubled(doubled(hops, span).drop("moved"), 2 * span), "hops")
        span *= 4
        hops = step.drop("moved")
        if step.where("moved").limit(1).count() == 0:
            break
    own = [*by, "bends", "at", "area"]
    placed = open_.join(hops.select("id", "low", "away"), "id").select(*own, F.col("low").alias("ring"), (-F.col("away")).alias("place")).unionByName(p.where("closed").select(*own, F.col("own").alias("ring"), F.lit(0).alias("place")))
    part = F.struct(F.when(F.col("place") == 0, F.lit(-(1 << 31))).otherwise(F.col("place")).alias("place"), "at", "bends")
    rings = placed.groupBy(*by, "ring").agg(F.array_sort(F.collect_list(part)).alias("v"), F.sum(F.size("bends")).alias("edges"), F.sum("area").alias("twice_area"))
    every, skip = F.flatten(F.transform("v", lambda x: x["bends"])), F.col("v")[0]["at"] - 1
    rings = rings.select(*by, "ring", "edges", "twice_area", every.alias("v"), skip.alias("skip"))
    turned = F.concat(F.slice("v", F.col("skip") + 1, F.size("v")), F.slice("v", F.lit(1), F.col("skip") + 1))
    vertices = F.transform(turned, lambda b: F.struct(b["r"].alias("row"), b["c"].alias("col")))
    return rings.select(*by, "ring", (F.col("twice_area") < 0).alias("hole"), vertices.alias("vertices"), "edges", "twice_area")


def polygons(cells: DataFrame, by: list[str], res: float, simplify: float = 0.0) -> DataFrame:
    """(by, polygons): each group's outline in degrees: shells, each with its holes.  ``simplify`` leaves out bends that are nearer to the rest, in cells.

    A hole belongs to the ring that bounds the run of cells to the left of its leftmost edge, or to that ring's shell if it is a
    hole too; rings of one run are neighbours in a window over one line of the grid.
    """
    rings = saved(outlines(cells, by), "outlines")
    pairs = F.arrays_zip(F.slice("vertices", F.lit(1), F.size("vertices") - 1).alias("a"), F.slice("vertices", F.lit(2), F.size("vertices") - 1).alias("b"))
    e = rings.select(*by, "ring", F.explode(pairs).alias("e")).select(*by, "ring", F.col("e.a.row").alias("r0"), F.col("e.b.row").alias("r1"), F.col("e.a.col").alias("col")).where("r0 <> r1")
    up = e.select(*by, "ring", F.when(F.col("r1") > F.col("r0"), 1).otherwise(3).alias("turn"), "col", F.explode(F.sequence(F.least("r0", "r1"), F.greatest("r0", "r1") - 1)).alias("row"))
    line = Window.partitionBy(*by, "row").orderBy("col", F.desc("turn"))  # north: the set lies west; south: east
    up = up.withColumn("before", F.lag("ring").over(line)).where("turn = 1")
    first = up.groupBy(*by, "ring").agg(F.min_by("before", F.struct("col", "row")).alias("parent"))
    rings = saved(rings.join(first.withColumnsRenamed({b: f"__{b}" for b in by} | {"ring": "__ring"}), [*(F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by), F.col("ring") == F.col("__ring")]).drop(*(f"__{b}" for b in by), "__ring"), "rings")
    owner = rings.select("ring", F.when(F.col("hole"), F.col("parent")).otherwise(F.col("ring")).alias("owner"), "hole")
    while True:  # holes within the reach of holes: owners are followed to their own
        above = owner.select(F.col("ring").alias("owner"), F.col("owner").alias("up"), F.col("hole").alias("by_hole"))
        step = saved(owner.join(above, "owner").select("ring", F.when(F.col("by_hole"), F.col("up")).otherwise(F.col("owner")).alias("owner"), "hole", "by_hole"), "owners")
        owner = step.drop("by_hole")
        if step.where("by_hole").limit(1).count() == 0:
            break
    whole = rings.join(owner.select("ring", "owner"), "ring")
    degrees = lambda v: F.transform(v, lambda p: F.struct((p["col"] * res).alias("lon"), (p["row"] * res).alias("lat")))
    if simplify:
        whole = simplified(whole, simplify)
    one = whole.groupBy(*by, "owner").agg(F.array_sort(F.collect_list(F.struct("hole", "ring", degrees(F.col("vertices")).alias("points")))).alias("rings"))
    parts = one.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("owner", F.transform("rings", lambda r: r["points"]).alias("rings")))).alias("parts"))
    return parts.select(*by, F.transform("parts", lambda p: p["rings"]).alias("polygons"))


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """Rings with fewer vertices: those stay that keep the rest within the tolerance (in cells) of the new edges, and at least three.

    A ring is a row; each is split at its farthest vertex, over and over.
    """

    @F.pandas_udf(rings.schema["vertices"].dataType)
    def fewer(columns: pd.Series) -> pd.Series:
        out = []
        for ring in columns:
            points = np.array([(p["row"], p["col"]) for p in ring], float)
            n = len(points) - 1
            far = int(np.argmax(((points[:n] - points[0]) ** 2).sum(axis=1)))
            keep, spans = {0, far, n}, [(0, far), (far, n)]
            while spans:
                a, b = spans.pop()
                if b - a < 2:
                    continue
                way, rest = points[b] - points[a], points[a + 1 : b] - points[a]
                off = np.abs(way[0] * rest[:, 1] - way[1] * rest[:, 0]) / max(float(np.hypot(*way)), 1e-12)
                k = a + 1 + int(np.argmax(off))
                if off.max() > tolerance or len(keep) < 4:
                    keep.add(k)
                    spans += [(a, k), (k, b)]
            out.append([ring[i] for i in sorted(keep)])
        return pd.Series(out)

    return rings.withColumn("vertices", fewer("vertices"))


def cells_inside(outlines_: DataFrame, by: list[str], res: float) -> DataFrame:
    """(by, row, col): cells whose centre lies inside polygons (rows by, polygons in degrees): the way back from outlines to cells.

    Every edge gives its crossing of each line of centres; of a polygon and line the crossings are paired from the left.
    """
    ring = outlines_.select(*by, F.posexplode("polygons").alias("part", "rings")).select(*by, "part", F.explode("rings").alias("r"))
    pairs = F.arrays_zip(F.slice("r", 1, F.size("r") - 1).alias("a"), F.slice("r", 2, F.size("r") - 1).alias("b"))
    e = ring.where("size(r) > 3").select(*by, "part", F.explode(pairs).alias("e")).where("e.a.lat <> e.b.lat")
    a, b = F.col("e.a"), F.col("e.b")
    low, high = F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])
    first, last = F.ceil(low / res - 0.5).cast("int"), (F.ceil(high / res - 0.5) - 1).cast("int")
    e = e.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last))))
    x = a["lon"] + (centre(F.col("row"), res) - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
    lines = e.withColumn("x", x).groupBy(*by, "part", "row").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a line of one polygon
    lines = lines.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("x") - 2, F.lit(2))))
    first, last = F.ceil(F.get("x", F.col("i")) / res - 0.5).cast("int"), (F.ceil(F.get("x", F.col("i") + 1) / res - 0.5) - 1).cast("int")
    return lines.withColumn("col", F.explode(F.when(first <= last, F.sequence(first, last)))).select(*by, "row", "col").distinct()
