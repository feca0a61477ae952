"""Plans that don't grow faster than their tables: what is sorted, broadcast or shuffled is read from the plan."""

import pytest
from pyspark.sql import functions as F

from sightline import plans, registry  # noqa: F401
from sightline.operators import sweep
from sightline.plans import sweeps
from sightline.sources.store import SurfaceStore

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mva_surface", "mva_stats", "agl_visible", "msl_visible", "annulus_clip", "mva_quantise", "ray_boundary_state", "boundary_turned", "coverage_union", "coverage_depth", "coverage_intersect", "coverage_minus", "coverage_area", "detection_clip", "cart_resample", "target_lookup"])
def test_no_sample_is_sorted_or_joined(spark, name):
    """A ray is swept as one row, so neither a window over samples nor a join with them is in the plan."""
    plan = plan_of(spark, name)
    assert "Window" not in plan and "SortMergeJoin" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["sweep_extension", "surface_store_extended"])
def test_a_longer_sweep_sorts_no_sample(spark, name, monkeypatch):
    """Neither what is returned nor what is stored on the way takes a window over samples' slopes."""
    written, real = [], SurfaceStore.write

    def write(self, rays):
        written.append(rays._jdf.queryExecution().executedPlan().toString())
        return real(self, rays)

    monkeypatch.setattr(SurfaceStore, "write", write)
    found = [plan_of(spark, name), *written]
    assert not any("max(slope" in p or "max(__tilt" in p for p in found) and any("MapInArrow" in p for p in found)


def bytes_of(spark, name, folder):
    """What a query's stages shuffle and spill, and what they write, in bytes."""
    store, bus = spark._jsc.sc().statusStore(), spark._jsc.sc().listenerBus()

    def stages():
        bus.waitUntilEmpty()
        found = store.stageList(None, *(getattr(store, f"stageList$default${i}")() for i in range(2, 6)))
        return {(x.stageId(), x.attemptId()): x for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    own = [x for k, x in stages().items() if k not in before]
    return sum(x.shuffleWriteBytes() + x.memoryBytesSpilled() + x.diskBytesSpilled() for x in own), sum(x.outputBytes() for x in own)


@pytest.mark.parametrize("name", ["coverage_intersect", "surface_store_extended", "agl_visible", "annulus_clip", "mva_quantise", "mva_stats", "msl_visible", "coverage_union", "coverage_area", "coverage_depth", "mva_surface", "detection_clip", "sweep_extension", "boundary_turned"])
def test_samples_are_not_shuffled(spark, name):
    """Rays are shuffled as a few numbers: under three bytes for each of their samples, and a store writes each sample once."""
    folder = "/root/testdata/sf0.01"
    samples = spark.read.parquet(f"{folder}/supplier.parquet").count() * sweeps.RAYS * sweeps.SAMPLES
    shuffled, written = bytes_of(spark, name, folder)
    assert 0 < shuffled < 3 * samples and written < 8 * samples


def test_a_sweep_that_goes_on_is_the_one_at_once(spark):
    rows = [(i, 3.7 + i, 8.4e6 + i, 333.3, [float((7 * i + 5 * j * j) % 311) for j in range(20 + i)]) for i in range(12)]
    rays = spark.createDataFrame(rows, "ray int, msl double, radius double, step_m double, elevations array<float>")
    whole = {r.ray: (r.mva, r.steepest) for r in sweep.surface_of_rays(rays, ["ray"]).collect()}
    head = sweep.surface_of_rays(rays.withColumn("elevations", F.slice("elevations", 1, 9)), ["ray"])
    rest = lambda r: r.withColumn("elevations", F.expr("slice(elevations, first + 1, size(elevations))"))
    tail = {r.ray: r for r in sweep.surface_beyond(rays, sweep.end_of_rays(head, ["ray"]), ["ray"], rest, ["ray"]).collect()}
    for r in head.collect():
        assert tail[r.ray].first == 9 and (r.mva + tail[r.ray].mva, r.steepest + tail[r.ray].steepest) == whole[r.ray]


def test_a_boundary_turned_to_more_rays_than_it_has(spark):
    state = spark.createDataFrame([(1, i, float(i * i)) for i in range(4)], "s int, az_idx int, steepest double")
    for wanted in (1, 3, 4, 11):
        got = {r.az_idx: r.steepest for r in sweep.turned(state, ["s"], 4, wanted).collect()}
        for k in range(wanted):
            at = k * (4 / wanted)
            assert abs(got[k] - ((1 - at % 1) * int(at) ** 2 + at % 1 * ((int(at) + 1) % 4) ** 2)) < 1e-9
        assert len(got) == wanted


@pytest.mark.parametrize("name", ["dem_lookup", "detection_polygon_clip"])
def test_nothing_made_of_many_rows_is_broadcast(spark, name):
    assert "BroadcastExchange" not in plan_of(spark, name)


@pytest.mark.parametrize("name", ["coverage_intersect", "coverage_minus"])
def test_two_networks_are_compared_without_a_join(spark, name):
    """Cells of both come from one sweep and meet in one aggregate; a join broadcast all cells of the second."""
    plan = plan_of(spark, name)
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("MapInArrow") == 1


def test_pixels_are_not_broadcast(spark):
    """The pixels that answer come to the points in a merge join, of the tiles that answer for a point only."""
    plan = plan_of(spark, "tile_sample")
    assert "SortMergeJoin" in plan and "LeftSemi" in plan and "BroadcastHashJoin [tile_id" not in plan


def test_mosaic_joins_no_cell(spark):
    assert "Join" not in plan_of(spark, "mosaic_cells")


def test_copies_of_a_box_meet_no_point(spark):
    """Boxes and points meet a place once, however many tiles lie over it, and the same tiles answer."""
    from sightline.operators import tiles as O

    rows = [(f"t{i}", i, x, 0.0, x + 1.0, 1.0, i * 7 % 3, i % 2 == 0, float(i)) for x in (0.0, 1.0, 5.0) for i in range(int(x) * 100, int(x) * 100 + 40)]
    t = spark.createDataFrame(rows, "id string, ordinal long, min_lon double, min_lat double, max_lon double, max_lat double, score int, cached boolean, elevation double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 1.0, 1.0), (4, 3.0, 0.5), (5, 5.5, 0.5)], "site_id int, longitude double, latitude double")
    assert O.answering(t.withColumn("rank", F.lit(0))).count() <= 6
    got = {r.site_id: r.tile_id for r in O.sampled(points, t).collect()}
    best = {}
    for p in points.collect():
        at = [(r, r[2] < p.longitude < r[4] and r[3] < p.latitude < r[5]) for r in rows if r[2] <= p.longitude <= r[4] and r[3] <= p.latitude <= r[5]]
        best[p.site_id] = max(at, key=lambda a: (a[1], a[0][6] if a[1] else 0, -a[0][1]))[0][0] if at else None
    assert got == best
    boxes = points.selectExpr("site_id", "longitude - 0.1 AS min_lon", "latitude AS min_lat", "longitude + 0.1 AS max_lon", "latitude AS max_lat")
    assert sorted(r.id for r in O.touched(boxes, t).collect()) == sorted(r[0] for r in rows)
    assert O.requirements(O.touched(boxes, t)).first() == O.requirements(O.touching(boxes, t)).first()


def test_cuts_are_put_together_across_batches(spark):
    """A ray's cuts in several Arrow batches are one ray, in order, without a window or a second sort."""
    from sightline.operators import blocks as B

    rows = [(f"s{s}", a, c, [float(1000 * s + 100 * a + 10 * c + i) for i in range((s + a + c) % 3 + 1)]) for s in range(4) for a in range(5) for c in range(7)]
    cuts = spark.createDataFrame(rows[::-1], "site_id string, az_idx int, cut int, elevations array<float>")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found = B.whole_rays(cuts, ["site_id", "az_idx"], ["site_id", "az_idx"])
            got = {(r.site_id, r.az_idx): r.elevations for r in found.collect()}
            assert got == {(f"s{s}", a): [v for x in rows if x[:2] == (f"s{s}", a) for v in x[3]] for s in range(4) for a in range(5)}
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_outlines_are_followed_in_blocks(spark):
    """What is joined and doubled is paths across blocks, not edges; and rings are the same whatever the blocks."""
    from sightline.operators import coverage

    cells = {(g, r, c) for g in (1, 2) for r in range(-9, 21) for c in range(-13, 19) if (r * r * 7 + c * 5 + r * c * g) % 11 < 6}
    rows = spark.createDataFrame([(None if g == 2 else g, r, c) for g, r, c in cells], "g int, row int, col int")
    by_side = {side: sorted(map(repr, coverage.outlines(rows, ["g"], side).collect())) for side in (256, 8, 3)}
    assert by_side[256] == by_side[8] == by_side[3] and len(by_side[8]) > 20
    assert sum(r.twice_area for r in coverage.outlines(rows, ["g"], 8).collect()) == 2 * len(cells)
    whole = spark.createDataFrame([(1, r, c) for r in range(100) for c in range(100)], "g int, row int, col int")
    assert [(r.closed, len(r.bends), r.area) for r in coverage.paths(whole, ["g"]).collect()] == [(True, 4, 20_000)]
