"""Sweeps over blocks of terrain: the same whatever the blocks' size, and what sample after sample in plain Python gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import earth
from sightline.operators import blocks as B
from sightline.operators import viewshed as V

STEP = 0.1
KEYS = V.SHARED_RAY


@pytest.fixture(scope="module")
def world(spark):
    """Tiles of two resolutions, some overlapping, some on both sides of the date line, with empty cells; a site beside each, and one with a reach under a pixel."""
    tiles = [(1, 1, 10.0, 51.0, STEP), (2, 2, 10.0, 51.0, 2 * STEP), (3, 3, 11.0, 51.0, STEP), (4, 4, 179.0, 1.0, STEP), (5, 5, -180.0, 1.0, STEP), (6, 0, 10.0, 50.0, STEP)]
    random, cells = np.random.default_rng(2), []
    for i, _, _, _, step in tiles:
        n = round(1 / step)
        cells += [(i, r, c, [float(random.integers(0, 300)), None, float("nan")][random.choice(3, p=[0.9, 0.05, 0.05])]) for r in range(n) for c in range(n)]
    tasks = [(1, 50.51, 10.53, 310.0, 0, 1500.0, 38_000.0), (2, 0.42, 179.96, 250.0, 0, 1500.0, 30_000.0), (3, 0.31, -179.97, 40.0, 1, 900.0, 20_000.0), (4, -40.0, 3.0, 20.0, 0, 500.0, 9_000.0), (5, 50.2, 10.2, 100.0, 0, 500.0, 400.0)]
    t = spark.createDataFrame(tiles, "id long, ordinal long, min_lon double, max_lat double, step double")
    c = spark.createDataFrame(cells, "id long, row int, col int, elevation double")
    k = spark.createDataFrame(tasks, "site_id long, latitude double, longitude double, msl double, zone int, res_m double, pass_max double")
    return tiles, cells, tasks, t, c, V.with_shared_key(k).withColumn("radius", earth.effective_radius(F.col("latitude")))


def found(world, side):
    *_, t, c, k = world
    got = B.surfaces(k, B.mosaic(B.pieces(t, c, side), STEP, side), STEP, KEYS, side)
    return {(r.site_id, r.az_idx): (r.mva, r.ground) for r in got.collect()}


def plain(world, radii):
    tiles, cells, tasks, *_ = world
    grid, place = {}, {t[0]: t for t in tiles}
    for i, r, c, e in sorted(cells, key=lambda x: place[x[0]][1]):
        _, _, lon, lat, step = place[i]
        k = round(step / STEP)
        if e is not None and not math.isnan(e):
            for y in range(k):
                for x in range(k):
                    grid[round(lon / STEP) + c * k + x, round(lat / STEP) - (r + 1) * k + y] = e
    out, across = {}, round(360 / STEP)
    for site, lat, lon, msl, _, res, reach in tasks:
        n, rays = math.ceil(reach / res), min(math.ceil(2 * math.pi * reach / res), 14400)
        rays += rays % 2
        half = reach * 1.05
        dim = int(2 * half / res)
        for a in range(rays):
            steepest, mva, ground = -9999.0, [], []
            for i in range(n):
                r = i * (reach / max(n - 1, 1))
                col, row = (min(max(int(v), 0), dim - 1) for v in ((r * math.sin(a * (2 * math.pi / rays)) + half) / res, (half - r * math.cos(a * (2 * math.pi / rays))) / res))
                x, y = (col + 0.5) * res - half, half - (row + 0.5) * res
                la, lo = (float(v) for v in B.geodesic(np.float64(lat), np.float64(lon), np.degrees(np.arctan2(x, y)), np.hypot(x, y)))
                gx, gy = (lo / STEP - 0.5), la / STEP - 0.5
                total = weight = 0.0
                for p in (0, 1):
                    for q in (0, 1):
                        cx = (math.floor(gx) + p + across // 2) % across - across // 2
                        w, e = abs(1 - p - (gx - math.floor(gx))) * abs(1 - q - (gy - math.floor(gy))), grid.get((cx, math.floor(gy) + q))
                        if e is not None:
                            total, weight = total + w * e, weight + w
                e = total / weight if weight else 0.0
                safe = r or 0.1
                own = -9999.0 if i == 0 else (e - msl) / safe - safe / (2 * radii[site])
                steepest = max(steepest, own)
                mva.append(0.0 if i and own == steepest else max(0.0, msl + safe * (steepest + safe / (2 * radii[site])) - e))
                ground.append(e)
            out[site, a] = mva, ground
    return out


@pytest.mark.parametrize("side", [3, 10, 256])
def test_surfaces_as_sample_by_sample(world, side):
    radii = {r.site_id: r.radius for r in world[-1].collect()}
    got, want = found(world, side), plain(world, radii)
    assert got.keys() == want.keys()
    for k, (mva, ground) in want.items():
        assert np.allclose(got[k][1], ground, atol=1e-3) and np.allclose(got[k][0], mva, atol=0.05), k


def test_block_size_and_parts_change_nothing(world, monkeypatch):
    whole = found(world, 256)
    assert found(world, 4) == whole
    monkeypatch.setattr(B, "SAMPLES", 500)
    monkeypatch.setattr(B, "AT_ONCE", 70)
    assert found(world, 4) == whole


def test_both_sides_of_the_date_line_are_seen(world):
    """A sensor just west of the line has terrain of the tile east of it, and the other way round."""
    got = found(world, 10)
    assert any(max(g) > 0 for (s, a), (_, g) in got.items() if s == 2 and 20 < a < 40) and any(max(g) > 0 for (s, a), (_, g) in got.items() if s == 3 and a > 90)


def test_blocks_and_rays_are_shuffled_once(world):
    """Between the cuts and the surfaces: cuts and blocks by block, then cuts by ray; no single sample."""
    *_, t, c, k = world
    plan = B.surfaces(k, B.mosaic(B.pieces(t, c, 16), STEP, 16), STEP, KEYS, 16)._jdf.queryExecution().executedPlan().toString()
    by_ray = [x for x in plan.splitlines() if "Exchange hashpartitioning(site_id" in x]
    by_block = [x for x in plan.splitlines() if "Exchange hashpartitioning(bx" in x and "task" in x]
    assert len(by_ray) == 1 and len(by_block) == 2 and "Generate explode(sequence(0, (n_r" not in plan


def test_a_reach_of_one_sample(spark):
    """A zone as wide as a pixel has one sample a ray; its cells are looked up all the same."""
    tasks = spark.createDataFrame([(1, 50.0, 10.0, 100.0, 8e6, 0, 0.0, 500.0, 400.0)], "site_id long, latitude double, longitude double, msl double, radius double, zone int, z_min double, res_m double, pass_max double")
    flat = lambda s: s.withColumn("elevation", F.lit(0.0).cast("float"))
    cells = V.zone_cells(tasks, V.zone_surfaces(tasks, flat), 0.001).collect()
    assert len(cells) > 10 and {r.mva for r in cells} == {0.0}


def test_the_surface_is_zero_where_ground_is_the_horizon(spark):
    """Rising ground is seen everywhere, whatever the last bits of the sums."""
    from sightline.operators import sweep

    s = spark.range(400).select(F.col("id").alias("ray"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("r_idx")).withColumn("radius", 8.4e6 + F.col("ray") * 1.37)
    s = s.withColumn("msl", 3.7 + F.col("ray") * 0.31).withColumn("r_m", F.col("r_idx") * 333.3).withColumn("elevation", (F.col("r_idx") * F.col("r_idx") * 2.3).cast("float"))
    swept = sweep.surface(s, ["ray"]).where("r_idx > 0 AND elevation > msl")
    assert swept.count() > 8000 and swept.where("mva <> 0").count() == 0
    rays = s.groupBy("ray", "msl", "radius").agg(F.array_sort(F.collect_list(F.struct("r_idx", "elevation"))).alias("s")).select("ray", "msl", "radius", F.lit(333.3).alias("step_m"), F.transform("s", lambda x: x["elevation"]).alias("elevations"))
    at_once = {r.ray: r.mva for r in sweep.surface_of_rays(rays, ["ray"]).collect()}
    assert all(at_once[r.ray][r.r_idx] == r.mva for r in swept.collect())
