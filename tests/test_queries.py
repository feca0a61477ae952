"""Every query that SQL can express, against its SQL on the smallest tables."""

import duckdb
import pytest

from sightline import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


#: Queries whose comparisons can tie, also tested on ten times the rows.
TIES = ["agl_visible", "cart_resample", "coverage_depth", "coverage_runs", "detection_polygon_clip", "msl_visible", "mva_stats", "polygon_depth_area", "target_lookup", "viewshed_terrain", "viewshed_terrain_msl", "zone_composite"]


def connected(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SF)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: x.tolist() if hasattr(x, "tolist") else (None if x is None or x != x else x)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", TIES)
def test_same_as_sql_on_more_rows(spark, name):
    """Order and values, without their text: sorted by DuckDB on both sides."""
    sf = "/root/testdata/sf0.01"
    con, got = connected(sf), registry.QUERIES[name](spark, sf).toArrow()
    con.register("got", got)
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    want = f"(SELECT {columns} FROM ({registry.ORACLES[name]}))"
    assert con.execute(f"SELECT count(*) FROM {want}").fetchone()[0] == got.num_rows
    assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM got EXCEPT ALL SELECT * FROM {want})").fetchone()[0] == 0


def test_outlines_enclose_the_union(spark):
    cells = {a: {(r.row, r.col) for r in part} for a, part in _by_altitude(registry.QUERIES["coverage_union"](spark, SF).collect()).items()}
    area = dict.fromkeys(cells, 0)
    for r in registry.QUERIES["polygon_rings"](spark, SF).collect():
        v = [(p.row, p.col) for p in r.vertices]
        assert v[0] == v[-1]
        turned = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(v, v[1:])) / 2
        assert (turned < 0) == r.hole
        area[r.alt_m] += turned
    assert area == {a: len(c) for a, c in cells.items()}


def _by_altitude(found):
    out = {}
    for r in found:
        out.setdefault(r.alt_m, []).append(r)
    return out
