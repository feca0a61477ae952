"""Values worked out by hand or in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import earth, text
from sightline.operators import coverage, detection, sites, sweep, terrain
from sightline.sources.store import SurfaceStore


def test_msl_heights(spark):
    rows = spark.createDataFrame(
        [("clampToGround", 0.0, 50.0, 10.0), ("relativeToGround", 20.0, 50.0, 10.0), ("absolute", 200.0, 50.0, 10.0), ("absolute", 0.0, 50.0, 10.0), ("odd", 1.0, 50.0, 10.0), ("absolute", 200.0, None, 10.0)],
        "altitude_mode string, input_altitude double, ground double, height double",
    )
    assert [r.msl for r in sites.with_msl_height(rows).collect()] == [60.0, 80.0, 210.0, 60.0, 60.0, None]


def test_a_height_below_the_sea_has_no_horizon(spark):
    r = spark.createDataFrame([(-1.0, 100.0)], "a double, b double").select(earth.mutual_horizon(F.col("a"), F.col("b"), F.lit(6e6))).first()
    assert r[0] is None


def _samples(spark, ground, msl=20.0, step=100.0, radius=8.5e6):
    data = [(0, i, i * step, None if g is None else float(g), msl, radius) for i, g in enumerate(ground)]
    return spark.createDataFrame(data, "ray int, r_idx int, r_m double, elevation float, msl double, radius double")


def test_a_wall_casts_its_shadow(spark):
    swept = sweep.surface(_samples(spark, [0] * 10 + [120] + [0] * 10), ["ray"]).orderBy("r_idx").collect()
    assert all(r.mva == 0 for r in swept[:11])
    for r in swept[12:]:  # the line over the wall's top, 100 m above the sensor at 1000 m, less the curvature between
        line = 20 + r.r_m * (100 / 1000 - 1000 / (2 * 8.5e6) + r.r_m / (2 * 8.5e6))
        assert math.isclose(r.mva, line, rel_tol=1e-5)


def test_rays_as_arrays_give_the_same(spark):
    ground = np.random.default_rng(0).integers(0, 300, 200).tolist()
    ground[7] = None
    one = [r.mva for r in sweep.surface(_samples(spark, ground), ["ray"]).orderBy("r_idx").collect()]
    rays = spark.createDataFrame([(0, 20.0, 8.5e6, 100.0, [float("nan") if g is None else float(g) for g in ground]), (1, 5.0, 8.5e6, 100.0, [])], "ray int, msl double, radius double, step_m double, elevations array<float>")
    two = {r.ray: r.mva for r in sweep.surface_of_rays(rays, ["ray"]).collect()}
    assert two[0] == one and two[1] == []


def test_quantised(spark):
    r = spark.createDataFrame([(0.25,), (0.75,), (1e9,), (float("inf"),), (None,)], "m float").select(sweep.quantised(F.col("m")).alias("q")).collect()
    assert [x.q for x in r] == [0, 2, 65534, 65535, 65535]


def test_geodesic_along_the_equator(spark):
    row = spark.createDataFrame([(0.0, 0.0, 90.0, 100_000.0)], "lat double, lon double, az double, d double")
    r = earth.with_geodesic(row, "lat", "lon", "az", "d").first()
    assert abs(r.lon2 - 0.8983152841195214) < 1e-12 and abs(r.lat2) < 1e-12


def test_texts(spark):
    r = spark.createDataFrame([("#00ff10", 0.5)], "c string, o double").select(
        text.kml_color(F.col("c"), F.col("o")).alias("kml"), text.kml_color(F.lit("red"), F.col("o")).alias("bad"), text.css_color(F.lit("8000ff00")).alias("css"), text.escaped(F.lit("a<&>\"'")).alias("esc"),
        text.duration(F.lit(3725)).alias("d"), text.file_altitude(F.lit("02_cover-X Y-tgt_alt_150.5m_AGL_sh_12m.kml")).alias("f"), sites.fixed(F.lit(-0.05), 1).alias("half"), sites.fixed(F.lit(10.125), 2).alias("even"),
    ).first()
    assert (r.kml, r.bad, r.css.color, r.esc, r.d) == ("7f10ff00", "ff0000ff", "#00ff00", "a&lt;&amp;&gt;&quot;&#x27;", "1h 2m 5s")
    assert (r.f.altitude, r.f.reference, r.f.sensor_height, r.f.sensor) == (150.5, "agl", 12.0, "X Y")
    assert r.even == "10.12"


def test_scenarios_repeat_the_last_item(spark):
    items = spark.createDataFrame([(0, 1.0, 1.0, 100.0, None), (1, 1.0, 1.0, 100.0, None), (2, 2.0, 2.0, 100.0, None)], "ordinal int, lon double, lat double, altitude double, reference string")
    got = sorted((r.scenario, r.ordinal) for r in detection.scenarios(items, ["altitude", "reference"]).collect())
    assert got == [(0, 0), (0, 2), (1, 1), (1, 2)]


def test_an_outline_has_its_hole(spark):
    cells = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "g int, row int, col int")
    rings = coverage.outlines(cells, ["g"]).collect()
    assert sorted((r.hole, len(r.vertices)) for r in rings) == [(False, 5), (True, 5)]


def test_finished_tasks_go(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "1")], "filename string, state_hash string")
    done = spark.createDataFrame([("a", "1"), ("b", "0")], "filename string, state_hash string")
    assert [r.filename for r in sites.pending(t, done).collect()] == ["b"] and sites.pending(t, done, force=True).count() == 2


def test_fixed_decimals_are_exact(spark):
    """Rounded as Python rounds: by the number's binary value, not that of a product that looks like a half."""
    values = [2.675, 1.005, 0.125, 0.375, 2.5, 3.5, -2.675, -0.001, 0.0, 10.0, 1e6 + 0.005, 123456.785, 0.285, 1.115, 8.345, 45.1234565, 1e-9, 99.995, 4.35, 0.045]
    values += np.round(np.random.default_rng(0).uniform(-100, 100, 300), 3).tolist()
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(sites.fixed(F.col("v"), p).alias(f"p{p}") for p in (0, 1, 2, 6))).collect()
    assert all(r[f"p{p}"] == f"{r.v:.{p}f}" for r in rows for p in (0, 1, 2, 6))


def _flat(spark, lat, reach=49_500.0, res=0.05):
    """Cells of one sensor over flat ground, seen from a tower: all within reach."""
    s = spark.createDataFrame([(1, lat, 10.0)], "site_id long, latitude double, longitude double")
    rays = s.select("site_id", F.explode(F.sequence(F.lit(0), F.lit(125))).alias("az_idx")).withColumn("r_idx", F.explode(F.sequence(F.lit(0), F.lit(19))))
    rays = rays.withColumns({"r_m": F.col("r_idx") * (reach / 19), "elevation": F.lit(0.0).cast("float"), "msl": F.lit(100.0), "radius": F.lit(8.5e6)})
    cells = coverage.site_cells(s, F.lit(reach), res).withColumn("i", earth.ray_index(F.col("az"), F.col("dist_m"), F.lit(reach), F.lit(20), F.lit(126))).select("*", "i.*").drop("i")
    return coverage.gathered(cells, sweep.as_rays(sweep.surface(rays, ["site_id", "az_idx"]), ["site_id", "az_idx"]), ["site_id", "az_idx"])


@pytest.mark.parametrize("lat", [0.0, 45.3, -70.1])
def test_flat_ground_is_a_full_disc(spark, lat):
    """One ring without a hole, of the disc's own area, at any latitude."""
    res = 0.01 if abs(lat) < 60 else 0.02
    seen = _flat(spark, lat, res=res).where("mva <= 1000").select("row", "col", F.lit(1).alias("g"))
    (ring,) = coverage.outlines(seen, ["g"]).collect()
    assert not ring.hole
    disc = 2 * math.pi * earth.MEAN**2 * (1 - math.cos(49_500 / earth.MEAN))
    assert abs(coverage.area(seen, res).first().area_m2 / disc - 1) < 0.01


def test_cells_round_the_pole_and_the_date_line(spark):
    s = spark.createDataFrame([(1, 89.9, 0.0), (2, 0.0, 179.99)], "site_id long, latitude double, longitude double")
    cells = coverage.site_cells(s, F.lit(40_000.0), 0.1).collect()
    pole = {(r.row, r.col) for r in cells if r.site_id == 1}
    assert len(pole) == sum(r.site_id == 1 for r in cells) and {c for r, c in pole if r == 899} == set(range(-1800, 1800))
    far = {r.col for r in cells if r.site_id == 2}
    assert {1799, -1800} <= far and max(far) <= 1799 and min(far) >= -1800


def test_a_cell_area_by_hand(spark):
    """A tenth of a degree at the equator, at 60 degrees, and all cells of a row together."""
    a, b = spark.createDataFrame([(0,), (600,)], "r int").select(coverage.cell_area(F.col("r"), 0.1).alias("a")).orderBy(F.desc("a")).collect()
    side = math.radians(0.1) * earth.MEAN
    assert abs(a.a / side**2 - 1) < 1e-5 and abs(b.a / (side**2 * math.cos(math.radians(60.05))) - 1) < 1e-5


def _polygons(spark, cells, **more):
    rows = spark.createDataFrame([("k", r, c) for r, c in cells], "g string, row int, col int")
    found = coverage.polygons(rows, ["g"], 1.0, **more)
    return found, sorted(sorted(len(ring) for ring in p) for p in found.first().polygons)


def test_polygons_have_their_own_holes(spark):
    """An island in a lake on an island, a second hole, and cells that touch at a corner only; and the way back to the cells."""
    outer = {(r, c) for r in range(13) for c in range(13)}
    lake = {(r, c) for r in range(4, 9) for c in range(4, 9)}
    cells = (outer - lake) | {(6, 6)} | {(20, 20), (21, 21)}
    cells -= {(0, 6), (1, 1), (11, 1)}
    found, shape = _polygons(spark, cells)
    assert shape == [[5], [5], [5], [5, 5, 5, 9]]
    back = coverage.cells_inside(found, ["g"], 1.0).collect()
    assert {(r.row, r.col) for r in back} == cells and len(back) == len(cells)


def test_random_cells_come_back_from_their_outlines(spark):
    random = np.random.default_rng(8)
    cells = {(int(r), int(c)) for r, c in random.integers(-8, 8, (150, 2))}
    found, _ = _polygons(spark, cells)
    assert {(r.row, r.col) for r in coverage.cells_inside(found, ["g"], 1.0).collect()} == cells


def test_simpler_outlines_stay_near(spark):
    """A staircase becomes a line; no vertex left out is farther from the new ring than the tolerance."""
    cells = {(r, c) for r in range(30) for c in range(30 - r)}
    _, before = _polygons(spark, cells)
    found, after = _polygons(spark, cells, simplify=1.0)
    assert before == [[61]] or before[0][0] > 50
    assert 4 <= after[0][0] < 10


def test_an_extension_needs_the_state(spark):
    """Beyond a wall the extension of a sweep sees what a whole sweep sees, and without the wall's state it would see more."""
    p = _samples(spark, [0] * 5 + [150] + [0] * 20)
    state = sweep.boundary(sweep.surface(p.where("r_idx < 10"), ["ray"]), ["ray"])
    whole = {r.r_idx: r.mva for r in sweep.surface(p, ["ray"]).collect()}
    rest = {r.r_idx: r.mva for r in sweep.extended(p, state, ["ray"]).collect()}
    assert rest == {k: v for k, v in whole.items() if k >= 10} and min(rest.values()) > 100


def test_boundaries_turn_as_interpolation_does(spark):
    values = np.random.default_rng(2).normal(size=10)
    state = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "s int, az_idx int, steepest double")
    got = [r.steepest for r in sweep.turned(state, ["s"], 10, 24).orderBy("az_idx").collect()]
    want = np.interp(np.arange(24) / 24, np.arange(11) / 10, [*values, values[0]])
    assert np.allclose(got, want)


def test_bilinear_leaves_out_empty_cells(spark):
    grid = spark.createDataFrame([(0, 0, 10.0), (1, 0, 20.0), (0, 1, None), (1, 1, 40.0)], "gx int, gy int, elevation double")
    at = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.5, 0.5), (3, 9.0, 9.0)], "k int, lon double, lat double")
    got = {r.k: r.elevation for r in terrain.bilinear(at, grid, 1.0, ["k"]).collect()}
    assert math.isclose(got[1], 70 / 3) and got[2] == 10.0 and got[3] is None


def test_a_later_tile_hides_an_earlier_one(spark):
    tiles = spark.createDataFrame([("a", 1, 0.0, 1.0, 0.5), ("b", 2, 0.0, 1.0, 1.0)], "id string, ordinal int, min_lon double, max_lat double, step double")
    cells = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("a", 1, 0, 3.0), ("b", 0, 0, None)], "id string, row int, col int, elevation float")
    assert {(r.gx, r.gy): r.elevation for r in terrain.mosaic(tiles, cells, 0.5).collect()} == {(0, 1): 1.0, (1, 1): 2.0, (0, 0): 3.0}
    later = cells.where("elevation IS NOT NULL").unionByName(spark.createDataFrame([("b", 0, 0, 9.0)], cells.schema))
    assert {r.elevation for r in terrain.mosaic(tiles, later, 0.5).collect()} == {9.0}


def test_the_store_forgets_and_learns(spark, tmp_path):
    store = SurfaceStore(spark, str(tmp_path / "s"))
    key = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    rays = lambda v, *k: key(*k).select("key", F.lit(0).alias("az_idx"), F.array(F.lit(v).cast("float"), F.lit(float("inf")).cast("float")).alias("mva"))
    assert store.stats().first()["keys"] == 0 and store.misses(key("a")).count() == 1
    store.write(rays(1.0, "a", "b"))
    store.write(rays(2.0, "b"))
    assert {r.key: r.mva for r in store.read(key("a", "b", "c")).collect()} == {"a": [1.0, float("inf")], "b": [2.0, float("inf")]}
    store.delete(key("b"))
    assert [r.key for r in store.hits(key("a", "b")).collect()] == ["a"]
    store.write(rays(3.0, "b"))
    assert store.read(key("b")).first().mva[0] == 3.0
    store.clear()
    assert store.keys().count() == 0 and store.stats().first()["files"] > 0


def test_a_store_goes_on_where_rays_end(spark, tmp_path):
    """Segments read as one, the state at the end of the last; a write from the start replaces them all; compaction changes nothing but the files."""
    store = SurfaceStore(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame(r, "key string, az_idx int, first int, mva array<float>, steepest double")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    store.write(rows(("a", 0, 0, [1.0, 2.0], 0.1), ("a", 1, 0, [3.0, 4.0], 0.2), ("b", 0, 0, [9.0], 0.9)))
    store.write(rows(("a", 0, 2, [5.0], 0.3), ("a", 1, 2, [6.0], 0.2)))
    whole = {("a", 0): [1.0, 2.0, 5.0], ("a", 1): [3.0, 4.0, 6.0], ("b", 0): [9.0]}

    def state():
        assert {(r.key, r.az_idx): r.mva for r in store.read(keys).collect()} == whole
        assert {(r.key, r.az_idx): (r.last_r, r.steepest) for r in store.boundary(keys).collect()} == {("a", 0): (2, 0.3), ("a", 1): (2, 0.2), ("b", 0): (0, 0.9)}
        assert {r.key: r.samples for r in store.keys().collect()} == {"a": 3, "b": 1}

    state()
    files = store.stats().first()["files"]
    store.compact()
    state()
    assert store.stats().first()["files"] < files
    store.write(rows(("a", 0, 0, [7.0], 0.5)))
    assert [(r.az_idx, r.mva) for r in store.read(keys.where("key = 'a'")).collect()] == [(0, [7.0])]


def test_what_a_key_has_is_read_from_the_manifest(spark, tmp_path):
    store = SurfaceStore(spark, str(tmp_path / "s"))
    store.write(spark.createDataFrame([("a", i, [1.0]) for i in range(30)], "key string, az_idx int, mva array<float>"))
    tasks = spark.createDataFrame([("a",), ("z",)], "key string")
    for found, n in ((store.hits(tasks), 1), (store.misses(tasks), 1)):
        assert found.count() == n and all("/manifest" in f or "/deleted" in f for f in found.inputFiles())


def test_rays_meet_in_no_task_by_sensor(spark):
    """The sweep's only shuffle is by (sensor, ray)."""
    from sightline.plans import sweeps

    plan = sweeps.swept(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "site_id" in exchanges[0] and "az_idx" in exchanges[0]


def test_a_polygon_across_the_date_line_keeps_what_one_elsewhere_does(spark):
    """The same place on the globe turned by whole cells: as many cells inside, in the same rows."""
    from sightline.operators import coverage as C

    counts = []
    for lon in (99.95, 179.95, -179.95, -180.0 + 0.01):
        s = spark.createDataFrame([(1, 35.02, lon)], "site_id long, latitude double, longitude double")
        cells = C.in_polygon_circle(C.site_cells(s, F.lit(27_000.0), 0.05), s, F.lit(25_250.0), 0.05).collect()
        assert len({(r.row, r.col) for r in cells}) == len(cells) and all(-3600 <= r.col < 3600 for r in cells)
        counts.append(len(cells))
    assert counts[0] == counts[1] == counts[2] and abs(counts[3] - counts[0]) <= 4


def test_inverse_geodesic_gives_the_direct_one_back(spark):
    places = [(lat, lon, az, dist) for lat in (-89.0, -60.5, -10.0, 0.0, 33.3, 71.0, 88.0) for lon in (-179.5, 0.0, 120.0) for az in (0.0, 1e-3, 45.0, 90.0, 179.0, 222.2, 300.0) for dist in (1.0, 5000.0, 250000.0, 9.9e6)]
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "i int, lat double, lon double, az double, dist double")
    there = earth.with_geodesic(t, "lat", "lon", "az", "dist", steps=9)
    for r in earth.with_inverse(there, "lat", "lon", "lat2", "lon2").collect():
        assert abs(r.geo_m - r.dist) < 1e-3, r
        off = (r.geo_az - math.radians(r.az) + math.pi) % (2 * math.pi) - math.pi
        assert abs(off) * r.dist < 1e-3 * max(1.0, r.dist / 1e5) or abs(r.lat) > 85, r


def test_inverse_geodesic_of_odd_places(spark):
    t = spark.createDataFrame([("same", 10.0, 20.0, 10.0, 20.0), ("equator", 0.0, 179.0, 0.0, -179.0), ("antipodes", 0.0, 0.0, 0.1, 179.9), ("null", None, 0.0, 1.0, 1.0), ("pole", 90.0, 0.0, 0.0, 0.0)], "k string, a double, b double, c double, d double")
    got = {r.k: r for r in earth.with_inverse(t, "a", "b", "c", "d").collect()}
    assert (got["same"].geo_m, got["same"].geo_az) == (0.0, 0.0)
    assert got["equator"].geo_m == pytest.approx(math.radians(2) * earth.A, abs=1e-3) and got["equator"].geo_az == pytest.approx(math.pi / 2)
    assert got["antipodes"].geo_m is None and got["null"].geo_m is None
    assert got["pole"].geo_m == pytest.approx(10001965.729, abs=1e-2)
