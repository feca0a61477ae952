"""DTED tiles cell by cell, their faults and pruning; files of given names and their commit."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.sources import dted, named


@pytest.fixture
def tiles(tmp_path):
    """Four tiles of two resolutions, with negative and empty cells."""
    random, grids = np.random.default_rng(3), {}
    for west, south, lines, points in ((10, 50, 301, 601), (11, 50, 301, 601), (-71, -33, 121, 121), (0, 0, 11, 21)):
        grid = random.integers(-400, 5000, (points, lines)).astype(float)
        grid[random.random(grid.shape) < 0.03] = np.nan
        name = f"{'W' if west < 0 else 'E'}{abs(west):03d}{'S' if south < 0 else 'N'}{abs(south):02d}.dt1"
        (tmp_path / name).write_bytes(dted.encoded(west, south, grid, 36_000 // max(1, lines - 1), 36_000 // max(1, points - 1)))
        grids[name] = (west, south, grid)
    return tmp_path, grids


def grid_of(rows, shape):
    out = np.full(shape, -9.0)
    for r in rows:
        out[r.row0 : r.row0 + r.rows, r.col0 : r.col0 + r.cols] = np.array(r.cells, float).reshape(r.rows, r.cols)
    return out


def test_tiles_come_back_cell_by_cell(spark, tiles):
    path, grids = tiles
    rows = dted.read_tiles(spark, str(path)).collect()
    assert {r.error for r in rows} == {None}
    for name, (west, south, grid) in grids.items():
        own = [r for r in rows if r.file == name]
        assert np.array_equal(grid_of(own, grid.shape), grid, equal_nan=True)
        assert (own[0].west, own[0].south) == (west, south) and own[0].north == pytest.approx(south + 1) and own[0].min_lon == pytest.approx(west - own[0].step_lon / 2)
    assert [r.file for r in sorted({r.file: r for r in rows}.values(), key=lambda r: r.ordinal)] == sorted(grids)


def test_wrong_files_are_told_and_stop_nothing(spark, tiles):
    path, grids = tiles
    name = "E010N50.dt1"
    data = bytearray((path / name).read_bytes())
    data[dted.HEAD + 5 * (dted.AROUND + 2 * 601) + 40] ^= 0xFF  # in the sixth line
    (path / name).write_bytes(data)
    cut = (path / "W071S33.dt1").read_bytes()
    (path / "W071S33.dt1").write_bytes(cut[:-300])
    (path / "none.dt2").write_bytes(b"UHX1 nothing")
    (path / "empty.dt0").write_bytes(b"")
    (path / "notes.txt").write_text("no tile")
    rows = dted.read_tiles(spark, str(path)).collect()
    errors = {r.file: r.error for r in rows if r.error}
    assert set(errors) == {name, "W071S33.dt1", "none.dt2", "empty.dt0"} and "1 lines with a wrong sum or mark, the first 5" in errors[name] and "2 lines cut off" in errors["W071S33.dt1"]
    got, want = grid_of([r for r in rows if r.file == name and not r.error], (601, 301)), grids[name][2].copy()
    want[:, 5] = np.nan
    assert np.array_equal(got, want, equal_nan=True)
    assert len({r.file for r in rows if not r.error}) == 4


def test_boxes_leave_files_unread(spark, tiles):
    path, _ = tiles
    all_, near = dted.read_tiles(spark, str(path), size=1), dted.read_tiles(spark, str(path), [(10.9, 50.2, 10.95, 50.9), (11.5, 50.2, 12.5, 50.9)], size=1)
    assert {r.file for r in near.select("file").distinct().collect()} == {"E010N50.dt1", "E011N50.dt1"}
    assert all_.rdd.getNumPartitions() == 4 and near.rdd.getNumPartitions() == 2 and dted.read_tiles(spark, str(path)).rdd.getNumPartitions() == 1
    assert dted.read_tiles(spark, str(path), [(100, 0, 101, 1)]).count() == 0
    (path / "none.dt2").write_bytes(b"UHX1 nothing")
    assert [r.file for r in dted.read_tiles(spark, str(path), []).collect()] == ["none.dt2"]


def test_named_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(50).select(F.format_string("%02d_site é.kml", "id").alias("filename"), F.concat(F.lit("<a>\n"), "id").alias("content")).repartition(7)
    named.write_named(rows, path)
    assert sorted(os.listdir(path)) == sorted(f"{i:02d}_site é.kml" for i in range(50)) and open(f"{path}/07_site é.kml").read() == "<a>\n7"
    named.write_named(spark.createDataFrame([("more.kml", b"\x00\xff")], "filename string, content binary"), path)
    assert len(os.listdir(path)) == 51 and open(f"{path}/more.kml", "rb").read() == b"\x00\xff"
    named.write_named(spark.createDataFrame([("only.kml", None)], "filename string, content string"), path, "overwrite")
    assert os.listdir(path) == ["only.kml"] and os.path.getsize(f"{path}/only.kml") == 0
    named.write_named(rows.limit(0), path)
    assert os.listdir(path) == ["only.kml"]


@pytest.mark.parametrize("fault", ["task", "name", "twice"])
def test_nothing_is_visible_after_a_fault(spark, tmp_path, fault):
    path = str(tmp_path / "out")
    name = {"task": F.concat("id", F.lit(".kml")), "name": F.when(F.col("id") == 17, "../up").otherwise(F.col("id").cast("string")), "twice": F.concat((F.col("id") % 19).cast("string"), F.lit(".kml"))}[fault]
    content = F.when((F.col("id") == 19) & F.lit(fault == "task"), F.raise_error(F.lit("poisoned"))).otherwise("x")
    with pytest.raises(Exception):
        named.write_named(spark.range(0, 20, 1, 4).select(name.alias("filename"), content.cast("string").alias("content")), path)
    assert [f for f in os.listdir(path) if f[0] != "_"] == []  # a task that ended after the others were given up may leave its folder
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).count() == 0


def test_planning_keeps_places_and_nothing_else(tmp_path):
    """Files in folders in the order of their paths, and little memory a file, with many boxes asked for."""
    import pickle

    data = dted.encoded(10, 50, np.zeros((2, 2)), 36_000, 36_000)
    for i in range(6000):
        (tmp_path / f"{i // 1000:03d}").mkdir(exist_ok=True)
        (tmp_path / f"{i // 1000:03d}" / f"{i:09d}.dt1").write_bytes(data)
    boxes = [[x, y, x + 1, y + 1] for x in range(-180, 180) for y in range(-90, 90)]
    reader = dted.DtedReader(str(tmp_path), boxes, 1 << 20)
    batches = reader.partitions()
    assert [o for b in batches for _, o in b] == list(range(6000)) and [f for b in batches for f, _ in b] == [f"{i // 1000:03d}/{i:09d}.dt1" for i in range(6000)]
    assert len(pickle.dumps(batches)) < 40 * 6000 and sum(r.num_rows for r in reader.read(batches[0])) == len(list(batches[0]))


def test_commit_holds_no_name_of_all_files(tmp_path):
    """A task's message is its folder, however many files it has; names may go through folders."""
    import pickle

    import pyarrow as pa

    writer = named.NamedFilesWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"filename": [f"{i // 100:03d}/{i}.x" for i in range(5000)], "content": ["c"] * 5000})
    message = writer.write(iter([batch]))
    assert len(pickle.dumps(message)) < 500
    writer.commit([message, None])
    assert sum(len(f) for _, _, f in os.walk(tmp_path)) == 5000 and sorted(os.listdir(tmp_path))[-1] == "049"
