"""Sweeps whose terrain comes to the sensors of a place: the same surfaces and cells as where rays go to blocks, and neither samples nor cells are shuffled."""

import pytest
from pyspark.sql import functions as F

from sightline import plans, registry  # noqa: F401
from sightline.operators import blocks as B
from sightline.operators import viewshed as V
from sightline.plans import realterrain as R

from .test_blocks import STEP, world  # noqa: F401
from .test_scale import bytes_of, plan_of


def flat(rows):
    """{(site, ray): (mva, ground)} of sectors or rays."""
    out = {}
    for r in rows.collect():
        for i in range(r.rays):
            cut = slice(i * r.n_r, i * r.n_r + r.n_r)
            out[r.site_id, r.az_idx + i] = r.mva[cut], r.ground[cut]
    return out


@pytest.mark.parametrize("side, posts", [(16, False), (7, True)])
def test_terrain_at_a_place_gives_the_rays_of_blocks(world, side, posts, monkeypatch):  # noqa: F811
    """Bit by bit, on both sides of the date line and at a pole, whatever the sectors, the parts and the places."""
    *_, t, c, k = world
    k = k.unionByName(k.where("site_id = 1").withColumns({"site_id": F.lit(9).cast("long"), "latitude": F.lit(89.9), "longitude": F.lit(-60.0)}))
    c = c.unionByName(c.where("id = 6").withColumn("id", F.lit(7).cast("long")))
    t = t.unionByName(t.where("id = 6").withColumns({"id": F.lit(7).cast("long"), "ordinal": F.lit(7).cast("long"), "min_lon": F.lit(-60.0), "max_lat": F.lit(90.0)}))
    mosaic = B.mosaic(B.pieces(t, c, side), STEP, side, posts)
    rays = {(r.site_id, r.az_idx): (r.mva, r.ground) for r in B.surfaces(k, mosaic, STEP, V.SHARED_RAY, side, posts).collect()}
    for place, sector, samples in ((4.0, 250_000, 4_000_000), (0.7, 300, 2000)):
        for n, v in (("PLACE", place), ("SECTOR", sector), ("SAMPLES", samples)):
            monkeypatch.setattr(B, n, v)
        parts, places = B.sectors(k, STEP, posts)
        near = B.near_surfaces(parts, places.withColumn("fits", F.lit(True)), mosaic, STEP, V.SHARED_ZONE, side, posts)
        assert flat(near) == rays


def test_places_that_do_not_fit_are_swept_in_blocks(spark, monkeypatch):
    """A box of more bytes than a task may hold leaves its sensors to the blocks; the cells are the same, also where some do fit."""
    sf = "/root/testdata/sf0.001"
    for above in (False, True):
        sums = lambda: sorted((r.site_id, r.zone, r.samples, r.open, r.ground, r.mva) for r in registry.QUERIES["terrain_surfaces"](spark, sf).collect())
        found = [sorted(map(tuple, V.seen_over(R.tasks(spark, sf), R.ground(spark, sf), R.STEP, R.RES, R.SIDE, above_sea=above).collect()))]
        told = sums()
        for held in (0, 20_000):
            monkeypatch.setattr(B, "HELD", held)
            places = B.sectors(V.shared(R.tasks(spark, sf)), R.STEP)[1].groupBy("fits").count().collect()
            assert len(places) == (1 if held == 0 else 2) and (above or sums() == told)
            found.append(sorted(map(tuple, V.seen_over(R.tasks(spark, sf), R.ground(spark, sf), R.STEP, R.RES, R.SIDE, above_sea=above).collect())))
        monkeypatch.undo()
        assert found[0] == found[1] == found[2] and len(found[0]) > 1000


@pytest.mark.parametrize("name", ["viewshed_terrain", "viewshed_terrain_msl"])
def test_cells_meet_their_samples_without_a_join(spark, name):
    """Rays are neither joined with cells nor put together from cuts, and nothing but the places is written on the way."""
    plan = plan_of(spark, name)
    assert "CoGroup" not in plan and "Exchange hashpartitioning(site_id#" not in plan.split("MapInArrow")[0] and "az_idx" not in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x)


@pytest.mark.parametrize("name", ["viewshed_terrain", "viewshed_terrain_msl", "terrain_surfaces"])
def test_a_viewshed_shuffles_less_than_its_samples(spark, name):
    """On sf0.01 the 100 sites take 3.3 million samples, 13 MB; cells and rays took several times that."""
    shuffled, written = bytes_of(spark, name, "/root/testdata/sf0.01")
    assert 0 < shuffled < 12e6 and written < 1e5


def test_a_run_sends_terrain_to_its_sensors(spark, monkeypatch):
    """No ray of a run is cut or put together again."""
    monkeypatch.setattr(B, "cuts", None)
    assert {r.status for r in registry.QUERIES["viewshed_run"](spark, "/root/testdata/sf0.001").collect()} >= {"done", "failed"}
