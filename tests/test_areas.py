"""Areas of an overlay by its lines: those of its pieces, whatever the grid, and without the sweep that finds pieces."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline import plans, registry  # noqa: F401
from sightline.operators import overlay as O

from .test_overlay import box, shapes


def by_pieces(spark, rows, **more):
    got = O.overlay(O.edges(shapes(spark, rows), ["g"]), ["g"], **more).groupBy("g", "n0", "n1").agg(F.sum(O.piece_area()).alias("m2"))
    return {(r.g, r.n0, r.n1): r.m2 for r in got.collect() if abs(r.m2) > 1}


def by_lines(spark, rows, **more):
    return {(r.g, r.n0, r.n1): r.m2 for r in O.areas(O.edges(shapes(spark, rows), ["g"]), ["g"], **more).collect() if abs(r.m2) > 1}


def test_areas_are_those_of_the_pieces(spark, monkeypatch):
    """Circles, copies, shared edges, holes, an island, lines through one point, the date line, rectangles between squares, and a null group."""
    random, t = np.random.default_rng(7), np.arange(40) * (2 * math.pi / 40)
    rings = [np.c_[x + r * np.cos(t), y + r * np.sin(t)] for x, y, r in zip(random.uniform(0, 6, 9), random.uniform(-3, 3, 9), random.uniform(0.3, 3, 9))]
    rows = [("c", i % 2, [[[tuple(p) for p in r]]]) for i, r in enumerate(rings)] + [("c", 0, [[[tuple(p) for p in rings[0]]]])] * 2
    rows += [("a", 0, [[box(0, 0, 3, 2)]]), ("a", 0, [[box(3, 0, 4, 2, True)]]), ("a", 1, [[box(2.5, 1.5, 5.25, 4)]]), (None, 0, [[box(0.25, 0.25, 0.5, 0.5)]]), ("a", 1, [[box(20, 0.5, 60, 9)]])]
    rows += [("h", 0, [[box(0, 0, 10, 10), box(2, 2, 8, 8)], [box(4, 4, 5, 5)]])] * 3 + [("h", 1, [[box(1, 1, 9, 9, True)]])]
    rows += [("s", k % 2, [[[(0, 0), (math.cos(k), math.sin(k)), (math.cos(k + 0.9), math.sin(k + 0.9))]]]) for k in range(7)]
    rows += [("e", 0, [[box(178.5, 0.5, 182.5, 3.5)]]), ("e", 0, [[box(-181.25, 1.5, -179, 2)]]), ("e", 1, [[box(-178, -1, -177, 5)]])]
    want = by_pieces(spark, rows)
    assert len(want) > 20
    for more in ({}, {"size": 4.0, "pieces": 8}):
        assert by_lines(spark, rows, **more) == pytest.approx(want, rel=1e-9, abs=1)
    monkeypatch.setattr(O, "PAIRS", 50)
    assert by_lines(spark, rows) == pytest.approx(want, rel=1e-9, abs=1)
    sets = {}
    for (g, n0, n1), m2 in want.items():
        sets[g, int(n0 > 0), int(n1 > 0)] = sets.get((g, int(n0 > 0), int(n1 > 0)), 0) + m2
    assert by_lines(spark, rows, sets=True) == pytest.approx(sets, rel=1e-9, abs=1)
    assert by_lines(spark, []) == {}


def test_a_dense_strip_is_not_swept_line_by_line():
    """400 lines and some 40,000 crossings, at each of which the sweep sorted all lines again."""
    n, random = 400, np.random.default_rng(1)
    lines = {"x0": np.zeros(n), "y0": np.linspace(0.01, 0.99, n), "x1": np.ones(n), "y1": random.uniform(0.01, 0.99, n), "d0": np.where(np.arange(n) % 2, 1, -1), "d1": np.zeros(n, int)}
    g = {**lines, "left": np.zeros(n), "right": np.ones(n), "b0": np.full(n, 3), "b1": np.zeros(n, int)}
    began = time.perf_counter()
    n0, n1, m2 = O._strip_areas(g, 0.0, 1.0, False)
    assert time.perf_counter() - began < 5
    assert m2.sum() == pytest.approx(O.earth.MEAN**2 * math.radians(1) * math.sin(math.radians(1)), rel=1e-9) and not n1.any() and len(n0) > 5


@pytest.mark.parametrize("name", ["polygon_depth_area", "polygon_set_area"])
def test_edges_are_laid_out_once(spark, name, monkeypatch):
    """One pass over the lines gives all sets; no piece is made."""
    calls, real = [], O._laid
    monkeypatch.setattr(O, "_laid", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(O, "_strip", None)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
