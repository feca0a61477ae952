"""Sets of cells of several sizes as runs of codes: the same answers as cell by cell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import earth
from sightline.operators import intervals as I

FINEST = 8


@pytest.fixture(scope="module")
def random_cells():
    """Cells (group, side, level, row, col) that overlap, nest and touch, in four corners of the world."""
    random, out = np.random.default_rng(9), []
    for _ in range(500):
        level = int(random.integers(4, FINEST + 1))
        half = 1 << (level - 1)
        out.append(("ab"[random.integers(2)], int(random.integers(2)), level, int(random.integers(-half // 2, half // 2)), int(random.integers(-half, half))))
    return out + [("a", 0, FINEST, r, c) for r in range(-20, 20) for c in range(40)]


def runs(spark, cells):
    t = spark.createDataFrame(cells, "g string, side int, level int, row int, col int")
    out = None
    for level in range(4, FINEST + 1):
        lo, hi = I.run_of(F.col("row"), F.col("col"), level, FINEST)
        part = t.where(F.col("level") == level).select("g", "side", lo.alias("lo"), hi.alias("hi"))
        out = part if out is None else out.unionByName(part)
    return out


def flat(cells):
    """{group: [fine cells of side 0 with their counts, those of side 1]}"""
    out = {}
    for g, side, level, row, col in cells:
        k = 1 << (FINEST - level)
        for r in range(row * k, row * k + k):
            for c in range(col * k, col * k + k):
                d = out.setdefault(g, ({}, {}))[side]
                d[r, c] = d.get((r, c), 0) + 1
    return out


def expanded(spark, found, more=()):
    out = {}
    for r in I.cells(found, ["g", *more], FINEST).collect():
        k = 1 << (FINEST - r.level)
        own = [(y, x) for y in range(r.row * k, r.row * k + k) for x in range(r.col * k, r.col * k + k)]
        d = out.setdefault(r.g, {})
        for p in own:
            assert p not in d
            d[p] = r[more[0]] if more else 1
    return out


@pytest.mark.parametrize("bits", [6, 20])
def test_sets_are_those_of_cells(spark, random_cells, bits):
    r, want = runs(spark, random_cells).cache(), flat(random_cells)
    for way, of in ((I.united, lambda a, b: set(a) | set(b)), (I.common, lambda a, b: set(a) & set(b)), (I.without, lambda a, b: set(a) - set(b))):
        got = expanded(spark, way(r, ["g"], bits))
        assert {g: set(c) for g, c in got.items()} == {g: of(*sides) for g, sides in want.items()}
    counts = expanded(spark, I.depth(r, ["g"], bits), ("depth",))
    assert counts == {g: {p: a.get(p, 0) + b.get(p, 0) for p in set(a) | set(b)} for g, (a, b) in want.items()}


def test_runs_are_few_and_areas_true(spark, random_cells):
    r, want = runs(spark, random_cells), flat(random_cells)
    found = I.united(r, ["g"], 2 * FINEST)
    rows = found.orderBy("g", "lo").collect()
    assert all(a.g != b.g or a.hi < b.lo for a, b in zip(rows, rows[1:])) and len(rows) < sum(len(set(a) | set(b)) for a, b in want.values()) / 3
    res = math.radians(I.degrees(FINEST))
    for x in I.area(found, ["g"], FINEST).collect():
        cells = set(want[x.g][0]) | set(want[x.g][1])
        assert x.area_m2 == pytest.approx(sum(earth.MEAN**2 * res * (math.sin((y + 1) * res) - math.sin(y * res)) for y, _ in cells), rel=1e-9)


def test_a_square_of_any_size_is_few_runs(spark):
    """Rows follow the outline: sixteen times the cells make four times the runs at most."""
    sizes = []
    for side in (37, 148):
        sizes.append(I.united(runs(spark, [("a", 0, FINEST, r, c) for r in range(-64, side - 64) for c in range(-100, side - 100)]), ["g"]).count())
    assert sizes[1] < 5 * sizes[0] and sizes[1] < 148 * 148 / 20


def test_rings_of_two_levels_share_a_border(spark):
    """Fine inside, coarse outside: no cell twice, none missing, by the finest cells' centres."""
    t = spark.createDataFrame([(1, 48.3, 179.9, 0.0, 20_000.0), (2, -71.0, 10.0, 0.0, 20_000.0)], "site_id long, latitude double, longitude double, z_min double, pass_max double")
    outer = t.select("site_id", "latitude", "longitude", F.col("pass_max").alias("z_min"), (F.col("pass_max") * 2.5).alias("pass_max"))
    fine, level = 15, 13
    both = I.ring_cells(t, fine, fine).unionByName(I.ring_cells(outer, level, fine))
    seen = {}
    for r in both.collect():
        k = 1 << (fine - r.level)
        for y in range(r.row * k, r.row * k + k):
            for x in range(r.col * k, r.col * k + k):
                assert (r.site_id, y, x) not in seen
                seen[r.site_id, y, x] = r.level
    res = I.degrees(fine)
    want = t.withColumn("pass_max", F.col("pass_max") * 2.5)
    from sightline.operators import coverage

    near = {(r.site_id, r.row, r.col): r.dist_m for r in coverage.site_cells(want, F.col("pass_max"), res).collect()}
    assert set(seen) == set(near) and {v for v in seen.values()} == {fine, level}
    assert all(near[k] > 20_000 - 1 for k, v in seen.items() if v == level)
