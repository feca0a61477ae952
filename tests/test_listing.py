"""Many files are listed and read by tasks, and written in folders, so that the driver holds no row for each."""

import os

import pytest
from pyspark.sql import functions as F

from sightline import plans, registry  # noqa: F401
from sightline.sources import kml, named

FILE = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><ExtendedData><Data name="n"><value>{}</value></Data></ExtendedData></Document></kml>'


def test_the_driver_lists_no_file(spark, tmp_path):
    """Files in folders and right in the folder come, hidden ones don't; odd names stay as they are; a plan has no scan of files."""
    names = ["a.kml", "b c%20+é.kml", "000/d.kml", "000/001/e.kml"]
    for n in [*names, "_job-1/f.kml", ".g.kml", "000/_h.kml"]:
        os.makedirs((tmp_path / n).parent, exist_ok=True)
        (tmp_path / n).write_text(FILE.format(n))
    for path in (str(tmp_path), f"file://{tmp_path}"):
        found = kml.read_metadata(spark, path)
        assert {(r.file, r.metadata["n"]) for r in found.collect()} == {(n.rpartition("/")[2], n) for n in names}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan and "InMemoryFileIndex" not in plan
    assert [r.file for r in kml.read_metadata(spark, str(tmp_path / "000/d.kml")).collect()] == ["d.kml"]
    os.makedirs(tmp_path / "none")
    assert kml.read_metadata(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound|no such"):
        kml.read_metadata(spark, str(tmp_path / "lost")).count()


def test_many_files_are_put_in_folders(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("f"), "id", F.lit(".kml")).alias("filename"), F.lit("x").alias("content"))
    assert named.in_folders(F.col("filename"), 10, 10) is not None and rows.select(named.in_folders(F.col("filename"), 10, 10).alias("n")).where("n LIKE '%/%'").count() == 0
    named.write_named(rows.withColumn("filename", named.in_folders(F.col("filename"), 40, 10)), str(tmp_path))
    assert sorted(f for _, _, fs in os.walk(tmp_path) for f in fs) == sorted(f"f{i}.kml" for i in range(40)) and 1 < len(os.listdir(tmp_path)) <= 4
