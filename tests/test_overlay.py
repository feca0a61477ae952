"""Overlay of polygons: areas by inclusion and exclusion, shared edges, holes, the date line, and the same answer on any grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import earth
from sightline.operators import overlay as O

SCHEMA = "g string, side int, polygons array<array<array<struct<lon: double, lat: double>>>>"


def box(x0, y0, x1, y1, turn=False):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return ring[::-1] if turn else ring


def shapes(spark, rows):
    return spark.createDataFrame([(g, s, None if p is None else [[[None if q is None else dict(lon=float(q[0]), lat=float(q[1])) for q in ring] for ring in part] for part in p]) for g, s, p in rows], SCHEMA)


def found(spark, rows, what="depth", **more):
    """{(group, n0, n1): area in square degrees}"""
    flat = (F.col("x1") - F.col("x0")) * (F.col("hi0") - F.col("lo0") + F.col("hi1") - F.col("lo1")) / 2
    got = O.overlay(O.edges(shapes(spark, rows), ["g"]), ["g"], what, **more).groupBy("g", "n0", "n1").agg(F.sum(flat).alias("a")).collect()
    return {(r.g, r.n0, r.n1): r.a for r in got}


def test_boxes_that_share_edges_and_overlap(spark):
    rows = [("a", 0, [[box(0, 0, 3, 2)]]), ("a", 0, [[box(3, 0, 4, 2, True)]]), ("a", 1, [[box(2.5, 1.5, 5.25, 4)]]), (None, 0, [[box(0.25, 0.25, 0.5, 0.5)]])]
    got = found(spark, rows)
    assert got == pytest.approx({("a", 1, 0): 8 - 0.75, ("a", 1, 1): 0.75, ("a", 0, 1): 2.75 * 2.5 - 0.75, (None, 1, 0): 0.0625})
    for what, area in (("union", 8 + 2.75 * 2.5 - 0.75), ("intersection", 0.75), ("difference", 7.25)):
        assert found(spark, rows, what)["a", 1, 0] == pytest.approx(area)


def test_copies_holes_and_shapes_within(spark):
    holed = [[box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(4, 4, 5, 5)]]  # an island in its hole
    got = found(spark, [("h", 0, holed)] * 3 + [("h", 1, [[box(1, 1, 9, 9, True)]])])
    assert got == pytest.approx({("h", 3, 0): 36, ("h", 3, 1): 29, ("h", 0, 1): 35})


def test_past_the_date_line(spark):
    rows = [("e", 0, [[box(178.5, 0.5, 182.5, 3.5)]]), ("e", 0, [[box(-181.25, 1.5, -179, 2)]]), ("e", 1, [[box(-178, -1, -177, 5)]])]
    got = O.overlay(O.edges(shapes(spark, rows), ["g"]), ["g"]).cache()
    assert got.where("x0 < -180 OR x1 > 180").count() == 0
    flat = found(spark, rows)
    both = 2.25 * 0.5
    assert flat == pytest.approx({("e", 1, 0): 12 - both - 0.5 * 3, ("e", 2, 0): both, ("e", 1, 1): 1.5, ("e", 0, 1): 6 - 1.5})


def test_what_covers_nothing(spark):
    rows = [("n", 0, None), ("n", 0, []), ("n", 1, [[]]), ("n", 0, [[[]]]), ("n", 0, [[[(0, 0), (1, 1)]]]), ("n", 0, [[[(0, 0), None, (1, 1), (2, 0)]]]), ("n", 0, [[[(1, 1), (1, 1), (1, 1), (1, 1)]]])]
    assert found(spark, rows) == {}
    assert O.overlay(O.edges(shapes(spark, []), ["g"]), ["g"]).count() == 0
    with pytest.raises(ValueError):
        O.overlay(O.edges(shapes(spark, rows), ["g"]), ["g"], size=0.7)


def clipped(a, b):
    """The part of a convex ring within a convex ring, half plane by half plane."""
    for p, q in zip(b, np.roll(b, -1, axis=0)):
        side = (q[0] - p[0]) * (a[:, 1] - p[1]) - (q[1] - p[1]) * (a[:, 0] - p[0]) if len(a) else np.array([])
        out = []
        for i in range(len(a)):
            j = (i + 1) % len(a)
            if side[i] >= 0:
                out.append(a[i])
            if (side[i] >= 0) != (side[j] >= 0):
                out.append(a[i] + (a[j] - a[i]) * side[i] / (side[i] - side[j]))
        a = np.array(out).reshape(-1, 2)
    return a


def area(a):
    x, y = a[:, 0], a[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2 if len(a) else 0.0


def test_circles_by_inclusion_and_exclusion(spark):
    random, t = np.random.default_rng(4), np.arange(40) * (2 * math.pi / 40)
    rings = [np.c_[x + r * np.cos(t), y + r * np.sin(t)] for x, y, r in zip(random.uniform(0, 6, 6), random.uniform(-3, 3, 6), random.uniform(1, 3, 6))]
    union = 0.0
    for chosen in range(1, 64):
        some = [rings[i] for i in range(6) if chosen >> i & 1]
        part = some[0]
        for other in some[1:]:
            part = clipped(part, other)
        union -= (-1) ** len(some) * area(part)
    rows = [("c", i % 2, [[[tuple(p) for p in r]]]) for i, r in enumerate(rings)]
    assert found(spark, rows, "union")["c", 1, 0] == pytest.approx(union, rel=1e-9)
    deep = found(spark, rows)
    assert sum((n0 + n1) * a for (_, n0, n1), a in deep.items()) == pytest.approx(sum(map(area, rings)), rel=1e-9)
    for size, pieces in ((0.25, 256), (4.0, 8), (2.0, 2)):
        again = found(spark, rows, size=size, pieces=pieces)
        assert {k: v for k, v in again.items() if v > 1e-9} == pytest.approx({k: v for k, v in deep.items() if v > 1e-9}, rel=1e-8)


def test_pieces_are_shapes_again_and_rows_follow_outlines(spark):
    rows = [("p", 0, [[box(0.3, 0.3, 60.7, 40.2)]]), ("p", 0, [[[(5, 5), (70, 20), (30, 50)]]])]
    first = O.overlay(O.edges(shapes(spark, rows), ["g"]), ["g"], "union").cache()
    assert first.count() < 1200  # of 3000 squares within
    again = O.overlay(O.piece_edges(first, ["g"]), ["g"], size=2.0).groupBy("n0", "n1").agg(F.sum(O.piece_area()).alias("a")).collect()
    alone = O.overlay(O.edges(shapes(spark, rows[:1]), ["g"]), ["g"]).agg(F.sum(O.piece_area())).first()[0]
    assert [(r.n0, r.n1) for r in again] == [(1, 0)]
    assert again[0].a == pytest.approx(first.agg(F.sum(O.piece_area())).first()[0], rel=1e-9)
    want = earth.MEAN**2 * math.radians(60.4) * (math.sin(math.radians(40.2)) - math.sin(math.radians(0.3)))
    assert alone == pytest.approx(want, rel=1e-12)
