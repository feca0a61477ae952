"""Site and coverage files with the faults that real ones have."""

import pytest
from pyspark.sql import functions as F

from sightline.sources import files, kml

GROUND = ("clampToGround", 0.0)


def test_csv_with_marks_blanks_and_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿ Name , LAT,Lon,height_agl\nA ,50.5,-1.5,15\nB,x,1,2\nC,1e1, 2 ,tall\n,3,4,\n", encoding="utf-8")
    got = {tuple(r) for r in files.read_csv_sites(spark, str(tmp_path / "a.csv"), 5.0).collect()}
    want = {("A", 50.5, -1.5, 15.0), ("C", 10.0, 2.0, 5.0), ("", 3.0, 4.0, 5.0)}
    assert got == {(n, y, x, *GROUND, h) for n, y, x, h in want}


def test_csv_without_a_needed_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,lat\nA,1\n")
    assert files.read_csv_sites(spark, str(tmp_path / "a.csv"), 5.0).count() == 0


def test_csv_files_of_several_headers(spark, tmp_path):
    """Other column order, doubled quotes with a comma, a line break in quotes, an empty file, and one that lacks a column."""
    (tmp_path / "a.csv").write_text("name,lat,lon\nplain,1,2\n")
    (tmp_path / "b.csv").write_text('lon,height_agl,name,lat\n4,9,"says ""hi"", twice",3\n')
    (tmp_path / "c.csv").write_text('Name,Longitude,Latitude\n"two\nlines",6,5\n')
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("name,lat\nlost,1\n")
    (tmp_path / "notes.txt").write_text("name,lat,lon\nno,0,0\n")
    got = {tuple(r) for r in files.read_csv_sites(spark, str(tmp_path), 5.0).collect()}
    assert got == {("plain", 1.0, 2.0, *GROUND, 5.0), ('says "hi", twice', 3.0, 4.0, *GROUND, 9.0), ("two\nlines", 5.0, 6.0, *GROUND, 5.0)}


KML = """<?xml version="1.0"?>
<kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Style id="deep"><IconStyle><color>c0123456</color><scale>0.75</scale></IconStyle><LineStyle><color>ffa1b2c3</color><width>4</width></LineStyle><PolyStyle><color>336699cc</color></PolyStyle></Style>
<StyleMap id="via"><Pair><key>highlight</key><styleUrl>#nowhere</styleUrl></Pair><Pair><key>normal</key><styleUrl>#deep</styleUrl></Pair></StyleMap>
<Placemark><name> Hill &amp; dale </name><styleUrl>#via</styleUrl><Point><coordinates> 12.25,-33.5,7 </coordinates></Point></Placemark>
<Placemark><styleUrl>#deep</styleUrl><Style><LineStyle><color>ff0f1e2d</color></LineStyle></Style><Point><altitudeMode>relativeToGround</altitudeMode><coordinates>101,3,22</coordinates></Point></Placemark>
<Placemark><name>Drifting</name><styleUrl>#missing</styleUrl><Point><altitudeMode>hovering</altitudeMode><coordinates>-70,8.5</coordinates></Point></Placemark>
<Placemark><name>Track</name><LineString><coordinates>0,0 1,1</coordinates></LineString></Placemark>
</Document></kml>"""


def test_kml_sites_and_styles(spark, tmp_path):
    path = str(tmp_path / "a.kml")
    (tmp_path / "a.kml").write_text(KML)
    rows = {r.name: r for r in files.styled(files.read_kml_sites(spark, path, 6.5), files.read_kml_styles(spark, path)).collect()}
    hill, own, drifting = rows["Hill & dale"], rows["Unnamed"], rows["Drifting"]
    assert len(rows) == 3 and (hill.longitude, hill.latitude, hill.altitude_mode, hill.input_altitude, hill.height) == (12.25, -33.5, "clampToGround", 7.0, 6.5)
    assert (hill.icon_color, hill.icon_scale, hill.line_color, hill.line_width, hill.fill_color) == ("c0123456", 0.75, "#c3b2a1", 4.0, "#cc9966") and abs(hill.fill_opacity - 0.2) < 1e-9
    assert (own.altitude_mode, own.height, own.line_color) == ("relativeToGround", 0.0, "#2d1e0f")
    assert (drifting.altitude_mode, drifting.input_altitude, drifting.line_color) == ("clampToGround", None, None)


def test_two_files_with_styles_of_one_name(spark, tmp_path):
    """A style counts in its own file only."""
    for name, color in (("a", "ff000011"), ("b", "ff000022")):
        (tmp_path / f"{name}.kml").write_text(KML.replace("ffa1b2c3", color).replace("Hill &amp; dale", f"hill {name}"))
    found = files.styled(files.read_kml_sites(spark, str(tmp_path), 1.0), files.read_kml_styles(spark, str(tmp_path)))
    assert {r.name: r.line_color for r in found.where("name LIKE 'hill%'").collect()} == {"hill a": "#110000", "hill b": "#220000"}


def test_a_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    (tmp_path / "b.csv").write_text("name,lat,lon\nplain,1,2\n")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.csv").write_text("name,lat,lon\ndeep,1,2\n")
    assert {r.name for r in files.read_sites(spark, str(tmp_path), 2.0).collect()} == {"Hill & dale", "Unnamed", "Drifting", "plain"}
    (tmp_path / "none").mkdir()
    assert files.read_sites(spark, str(tmp_path / "none"), 2.0).count() == 0


def _outline(body):
    return f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>'.encode()


RING = "<outerBoundaryIs><LinearRing><coordinates>{}</coordinates></LinearRing></outerBoundaryIs>"
SQUARE = RING.format("0,0,0 2,0,0 2,2,0 0,0,0")
SPOT = "<Placemark><name>{}</name><Point><coordinates>{}</coordinates></Point></Placemark>"


def test_coverage_without_folders_and_by_name():
    """The later Location and Viewshed count; several polygons and holes; style maps of style maps, one of them a circle."""
    hole = "<innerBoundaryIs><LinearRing><coordinates>1,0.5 1.2,0.5 1.2,0.7 1,0.5</coordinates></LinearRing></innerBoundaryIs>"
    styles = '<Style id="s"><LineStyle><color>ff332211</color><width>7</width></LineStyle></Style><StyleMap id="a"><Pair><key>normal</key><styleUrl>#b</styleUrl></Pair></StyleMap><StyleMap id="b"><Pair><key>normal</key><styleUrl>#s</styleUrl></Pair></StyleMap><StyleMap id="c"><Pair><key>normal</key><styleUrl>#c</styleUrl></Pair></StyleMap>'
    body = styles + SPOT.format("mast", "5,6") + SPOT.format("Location of it", " 7,8,9 ") + SPOT.format("other", "1,1")
    body += f"<Placemark><name>first</name><Polygon>{SQUARE}</Polygon></Placemark>"
    body += f"<Placemark><name>Viewshed</name><styleUrl>#a</styleUrl><MultiGeometry><Polygon>{SQUARE}{hole}</Polygon><Polygon>{SQUARE}</Polygon><Polygon></Polygon></MultiGeometry></Placemark>"
    (one,) = kml.parsed_coverage(_outline(body))
    assert (one["folder_name"], one["sensor_name"], one["sensor"]) == (None, "Location of it", {"lon": 7.0, "lat": 8.0})
    assert [len(p) for p in one["polygons"]] == [2, 1] and one["style"] == {"line_color": "#112233", "line_width": "7.0"}
    assert kml.parsed_coverage(_outline(SPOT.format("mast", "5,6"))) == []
    circle = f"<Placemark><name>x</name><styleUrl>#c</styleUrl><Polygon>{SQUARE}</Polygon></Placemark>"
    assert len(kml.parsed_coverage(_outline(styles + SPOT.format("m", "1,2") + circle))) == 1


def test_coverage_of_folders():
    """One row a folder that has both, named or not; the others give nothing."""
    full = SPOT.format("m", "1,2") + f"<Placemark><Polygon>{SQUARE}</Polygon></Placemark>"
    found = kml.parsed_coverage(_outline(f"<Folder><name> East </name>{full}</Folder><Folder>{full}</Folder><Folder><name>Empty</name></Folder>"))
    assert [f["folder_name"] for f in found] == ["East", None]


def test_metadata_last_wins(spark, tmp_path):
    data = "<ExtendedData><Data name='a'><value>{}</value></Data></ExtendedData>"
    (tmp_path / "x.kml").write_bytes(_outline(f"<Placemark>{data.format('one')}</Placemark><Placemark>{data.format('two')}</Placemark>"))
    (tmp_path / "y.kml").write_text("<kml")
    assert {r.file: r.metadata for r in kml.read_metadata(spark, str(tmp_path)).collect()} == {"x.kml": {"a": "two"}, "y.kml": {}}


@pytest.mark.parametrize(("opacity", "filled"), [(0.0, False), (0.5, True), (None, False)])
def test_area_is_filled_only_with_some_opacity(spark, opacity, filled):
    style = F.struct(F.lit("#010203").alias("line_color"), F.lit(None).cast("double").alias("line_width"), F.lit("#0a0b0c").alias("fill_color"), F.lit(opacity).cast("double").alias("fill_opacity"))
    made = spark.range(1).select(kml.line_style(F.lit("x"), style)).first()[0]
    assert ("<color>7f0c0b0a</color><fill>1</fill>" in made) == filled and "<color>ff030201</color><width>2</width>" in made


def test_names_are_escaped(spark, tmp_path):
    name = "A <b> & \"c\" 'd'"
    rows = spark.createDataFrame([("f.kml", name, 1.0)], "filename string, title string, altitude double")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat"))
    none = F.lit(None).cast("string")
    sensor = F.struct(F.col("title").alias("name"), F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat"), none.alias("icon_color"), F.lit(None).cast("double").alias("icon_scale"), none.alias("icon_href"))
    style = F.struct(none.alias("line_color"), F.lit(None).cast("double").alias("line_width"), none.alias("fill_color"), F.lit(None).cast("double").alias("fill_opacity"))
    rows = rows.withColumn("polygons", F.array(F.array(F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 0))))).withColumn("sensors", F.array(sensor)).withColumn("style", style).withColumn("metadata", F.create_map("title", "title")).withColumn("mode", F.lit("absolute"))
    kml.write_files(kml.coverage_documents(rows), str(tmp_path / "out"))
    assert kml.read_coverage(spark, str(tmp_path / "out")).first().sensor_name == name
    assert kml.read_metadata(spark, str(tmp_path / "out")).first().metadata == {name: name}


def test_horizons_of_a_large_network_are_several_files(spark):
    """Sensors are numbered over ranges, in the order of the input; a file holds so many."""
    rings = spark.range(47).select((100 - F.col("id")).alias("ordinal"), F.format_string("s%02d", "id").alias("sensor"), F.lit(50.0).alias("alt_m"), F.lit(9000.0).alias("dist_m")).repartition(5)
    places = spark.createDataFrame([], "sensor string, latitude double, longitude double, ground double, height double")
    style = F.struct(F.lit("#ffaa00").alias("line_color"), F.lit(1.0).alias("line_width"), F.lit(None).cast("string").alias("fill_color"), F.lit(None).cast("double").alias("fill_opacity"))
    made = lambda **more: {r.filename: r.content for r in kml.horizon_documents(rings, places, style, F.create_map(F.lit("a"), F.lit("b")), **more).collect()}
    files_ = made(together=20)
    assert {f: c.count("<Folder>") for f, c in files_.items()} == {"horizons.kml": 20, "horizons-2.kml": 20, "horizons-3.kml": 7}
    assert files_["horizons.kml"].index("s46") < files_["horizons.kml"].index("s45") and "s27" in files_["horizons.kml"] and "s26" in files_["horizons-2.kml"]
    assert sorted(made(by_sensor=True)) == sorted(f"{i + 1:02d}_horizon-s{46 - i:02d}.kml" for i in range(47)) and list(made()) == ["horizons.kml"]
