"""Coverage, horizons and sites as KML files, and the scan that reads coverage files back with their metadata.

Documents are put together as text by column expressions, one row for each file, so a task never holds more than its own
outputs.  Element names are those of the format.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import earth
from ..functions.text import coordinates, escaped, extended_data, kml_color, label, metadata_html
from .files import dealt, few, numbered
from .named import located, write_named

#: Fixed values of the outputs: colour and width of lines without a style, and the icon of a sensor.
LINE_COLOR, LINE_WIDTH = "#FFA500", 2.0
ICON = "http://maps.google.com/mapfiles/kml/shapes/target.png"
#: Points of a horizon ring, before the first is repeated.
RING_POINTS = 180
#: Sensors whose horizons are one file; a larger network has several, horizons.kml and horizons-2.kml on.
TOGETHER = 5000

_NS = "{http://www.opengis.net/kml/2.2}"


def document(title: Column, body: Column) -> Column:
    """A whole KML file."""
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'
    return F.concat(F.lit(head), escaped(title), F.lit('</name><Snippet maxLines="0"></Snippet>'), body, F.lit("</Document></kml>"))


def line_style(style_id: Column, style: Column) -> Column:
    """A shared style of lines and areas from struct(line_color, line_width, fill_color, fill_opacity); areas are filled if there is a colour and some opacity."""
    filled = style["fill_color"].isNotNull() & (F.coalesce(style["fill_opacity"], F.lit(0.0)) > 0)
    line = kml_color(F.coalesce(style["line_color"], F.lit(LINE_COLOR)), F.lit(1.0))
    fill = F.when(filled, F.concat(F.lit("<color>"), kml_color(style["fill_color"], style["fill_opacity"]), F.lit("</color><fill>1</fill>"))).otherwise("<color>00000000</color><fill>0</fill>")
    width = label(F.coalesce(style["line_width"], F.lit(LINE_WIDTH)))
    return F.concat(F.lit('<Style id="'), style_id, F.lit('"><LineStyle><color>'), line, F.lit("</color><width>"), width, F.lit("</width></LineStyle><PolyStyle>"), fill, F.lit("</PolyStyle></Style>"))


def icon_style(style_id: Column, scale: Column, href: Column, color: Column) -> Column:
    tint = F.when(color.isNotNull(), F.concat(F.lit("<color>"), color, F.lit("</color>"))).otherwise("")
    return F.concat(
        F.lit('<Style id="'), style_id, F.lit('"><IconStyle>'), tint, F.lit("<scale>"), F.coalesce(scale, F.lit(1.0)).cast("string"), F.lit("</scale><Icon><href>"),
        escaped(F.coalesce(href, F.lit(ICON))), F.lit("</href></Icon></IconStyle></Style>"),
    )


def polygon(rings: Column, altitude: Column, mode: Column) -> Column:
    """One polygon: the first ring is its shell, the others are holes."""
    side = lambda name, ring: F.concat(F.lit(f"<{name}><LinearRing><coordinates>"), coordinates(ring, altitude), F.lit(f"</coordinates></LinearRing></{name}>"))
    holes = F.array_join(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda r: side("innerBoundaryIs", r)), "")
    return F.concat(F.lit("<Polygon><altitudeMode>"), mode, F.lit("</altitudeMode>"), side("outerBoundaryIs", rings[0]), holes, F.lit("</Polygon>"))


def multi(polygons: Column, altitude: Column, mode: Column) -> Column:
    return F.concat(F.lit("<MultiGeometry>"), F.array_join(F.transform(F.filter(polygons, lambda p: F.size(p) > 0), lambda p: polygon(p, altitude, mode)), ""), F.lit("</MultiGeometry>"))


def placemark(name: Column, style_url: Column, geometry: Column, metadata: Column | None = None) -> Column:
    more = F.lit("")
    if metadata is not None:
        more = F.when(F.size(metadata) > 0, F.concat(F.lit("<description>"), escaped(metadata_html(metadata)), F.lit("</description>"), extended_data(metadata))).otherwise("")
    return F.concat(F.lit("<Placemark><name>"), escaped(name), F.lit("</name><styleUrl>#"), style_url, F.lit("</styleUrl>"), more, geometry, F.lit("</Placemark>"))


def site_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("<Point><coordinates>"), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit(",0</coordinates></Point>"))


def height_mode(export_mode: Column, reference: Column) -> Column:
    """How viewers place an outline: on the ground, or at its altitude above the sea or the ground."""
    return F.when(export_mode == "absolute", F.when(F.lower(reference) == "agl", "relativeToGround").otherwise("absolute")).otherwise("clampToGround")


def coverage_documents(outputs: DataFrame) -> DataFrame:
    """(filename, content) for rows (filename, title, altitude, polygons, sensors, style, metadata, mode): an outline and the sensors it belongs to.

    ``sensors`` is an array of struct(name, lon, lat, icon_color, icon_scale, icon_href); outputs without a polygon are left out.
    """
    icons = F.transform("sensors", lambda s, i: icon_style(F.concat(F.lit("sensor"), i.cast("string")), s["icon_scale"], s["icon_href"], s["icon_color"]))
    marks = F.transform("sensors", lambda s, i: placemark(s["name"], F.concat(F.lit("sensor"), i.cast("string")), site_point(s["lon"], s["lat"])))
    area = placemark(F.col("title"), F.lit("area"), multi(F.col("polygons"), F.col("altitude"), F.col("mode")), F.col("metadata"))
    body = F.concat(F.array_join(icons, ""), line_style(F.lit("area"), F.col("style")), F.array_join(marks, ""), area)
    return outputs.where(F.exists("polygons", lambda p: F.size(p) > 0)).select("filename", document(F.col("title"), body).alias("content"))


def polygon_documents(outputs: DataFrame) -> DataFrame:
    """(filename, content) for rows (filename, title, altitude, polygons, style): the outline alone, at its altitude above the sea."""
    area = placemark(F.col("title"), F.lit("area"), multi(F.col("polygons"), F.col("altitude"), F.lit("absolute")))
    return outputs.select("filename", document(F.col("title"), F.concat(line_style(F.lit("area"), F.col("style")), area)).alias("content"))


def combined_documents(outputs: DataFrame) -> DataFrame:
    """(filename, content) for rows (filename, title, sensor, lon, lat, description, ordinal, altitude, polygons, style, metadata): sensors and all their outlines in one file.

    Several sensors of a file have a folder each.  A file's rows meet in one task: it is one document for a viewer.
    """
    area = placemark(F.concat(F.lit("viewshed ("), label(F.col("altitude")), F.lit("m target altitude)")), F.lit("area"), multi(F.col("polygons"), F.col("altitude"), F.lit("absolute")), F.col("metadata"))
    area = F.when(F.exists("polygons", lambda p: F.size(p) > 0), area)
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["mark"]), "")
    one = outputs.groupBy("filename", "title", "sensor", "lon", "lat", "description", "ordinal").agg(ordered(F.when(area.isNotNull(), F.struct("altitude", area.alias("mark")))).alias("areas"), F.first("style").alias("style"))
    told = F.when(F.col("description").isNotNull(), F.concat(F.lit("<description>"), escaped(F.col("description")), F.lit("</description>"))).otherwise("")
    own = F.concat(F.lit("<Placemark><name>"), escaped(F.col("sensor")), F.lit("</name>"), told, F.lit("<styleUrl>#sensor</styleUrl>"), site_point(F.col("lon"), F.col("lat")), F.lit("</Placemark>"), F.col("areas"))
    folder = F.concat(F.lit("<Folder><name>"), escaped(F.col("sensor")), F.lit("</name>"), F.col("mark"), F.lit("</Folder>"))
    whole = one.withColumn("mark", own).groupBy("filename", "title").agg(
        F.count("*").alias("n"), ordered(F.struct("ordinal", folder.alias("mark"))).alias("folders"), ordered(F.struct("ordinal", "mark")).alias("plain"), F.first("style").alias("style")
    )
    styles = F.concat(icon_style(F.lit("sensor"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string")), line_style(F.lit("area"), F.col("style")))
    return whole.select("filename", document(F.col("title"), F.concat(styles, F.when(F.col("n") > 1, F.col("folders")).otherwise(F.col("plain")))).alias("content"))


def ring_points(rings: DataFrame, keys: list[str], points: int = RING_POINTS) -> DataFrame:
    """``rings`` (keys, which name a ring; latitude, longitude, dist_m and more) with ring: the geodesic circle's points from north, clockwise, the first again at the end."""
    spread = rings.select(*keys, "latitude", "longitude", "dist_m", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("az", F.col("i") * (360.0 / points))
    at = earth.with_geodesic(spread, "latitude", "longitude", "az", "dist_m")
    closed = at.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col("lon2").alias("lon"), F.col("lat2").alias("lat")))).alias("p"))
    ring = F.transform(F.concat("p", F.slice("p", 1, 1)), lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat")))
    return rings.join(closed.select(*keys, ring.alias("ring")), keys)


def horizon_documents(rings: DataFrame, places: DataFrame, style: Column, metadata: Column, export_mode: str = "clamped", by_sensor: bool = False, together: int = TOGETHER) -> DataFrame:
    """(filename, content): a folder for each sensor with its place and a ring for each altitude; a file for ``together`` sensors or one each.

    ``rings`` has (ordinal, sensor, alt_m, dist_m); ``places`` (sensor, latitude, longitude, ground, height); a sensor without a place
    stands at 0, 0 on ground 0.  Of rings of one name and altitude the last counts.  Files of one sensor are numbered in order of ``ordinal``.
    """
    rings = rings.groupBy("sensor", "alt_m").agg(F.max_by(F.struct("ordinal", "dist_m"), "ordinal").alias("r")).select("sensor", "alt_m", "r.*")
    at = rings.join(few(places), "sensor", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("latitude", "longitude", "ground", "height")})
    at = ring_points(at.where("dist_m IS NOT NULL"), ["sensor", "alt_m"])
    five = lambda c: F.format_string("%.5f", c)
    own = F.create_map(
        F.lit("Sensor Name"), F.col("sensor"), F.lit("Sensor Location"), F.concat_ws(", ", five(F.col("latitude")), five(F.col("longitude"))),
        F.lit("Sensor Ground Elevation"), F.concat(F.format_string("%.1f", "ground"), F.lit(" m MSL")), F.lit("Sensor Height (AGL)"), F.concat(F.col("height").cast("string"), F.lit(" m")),
        F.lit("Target Altitude"), F.concat(label(F.col("alt_m")), F.lit(" m")), F.lit("Max Range"), F.concat(F.format_string("%.1f", F.col("dist_m") / 1000), F.lit(" km")),
    )
    altitude, mode = (F.col("alt_m"), "absolute") if export_mode == "absolute" else (F.lit(0.0), "clampToGround")
    mark = placemark(F.concat(F.lit("Horizon ("), label(F.col("alt_m")), F.lit("m target altitude)")), F.lit("horizon"), polygon(F.array("ring"), altitude, F.lit(mode)), F.map_concat(metadata, own))
    sensors = at.groupBy("sensor", "latitude", "longitude").agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_list(F.struct("alt_m", mark.alias("mark")))).alias("marks"))  # a sensor's altitudes
    place = placemark(F.col("sensor"), F.lit("sensor"), site_point(F.col("longitude"), F.col("latitude")))
    folder = F.concat(F.lit("<Folder><name>"), escaped(F.col("sensor")), F.lit("</name>"), place, F.array_join(F.transform("marks", lambda m: m["mark"]), ""), F.lit("</Folder>"))
    sensors = numbered(sensors.select("sensor", "ordinal", folder.alias("folder")), ["ordinal", "sensor"], "number")
    place_of = F.col("number").cast("string")
    if by_sensor:
        sensors = sensors.withColumn("filename", F.concat(F.when(F.length(place_of) < 2, F.concat(F.lit("0"), place_of)).otherwise(place_of), F.lit("_horizon-"), F.regexp_replace("sensor", r"[^\w.-]", "_"), F.lit(".kml")))
    else:
        file = F.floor((F.col("number") - 1) / together) + 1
        sensors = sensors.withColumn("filename", F.when(file == 1, "horizons.kml").otherwise(F.concat(F.lit("horizons-"), file.cast("string"), F.lit(".kml"))))
    files = sensors.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("ordinal", "sensor", "folder"))).alias("folders"))
    styles = F.concat(icon_style(F.lit("sensor"), F.lit(1.0), F.lit(ICON), F.lit(None).cast("string")), line_style(F.lit("horizon"), style))
    return files.select("filename", document(F.lit("Geometric Horizons"), F.concat(styles, F.array_join(F.transform("folders", lambda f: f["folder"]), ""))).alias("content"))


def write_files(documents: DataFrame, path: str) -> None:
    """Rows (filename, content) as files of those names in a folder, all or none of them; a name may occur once."""
    write_named(documents, path)


STYLE_FIELDS = ("icon_color", "icon_scale", "icon_href", "line_color", "line_width", "fill_color", "fill_opacity")
_PLACE = T.StructType().add("lon", "double").add("lat", "double")
_SCAN = T.StructType().add("file", "string").add("folder_name", "string").add("sensor_name", "string").add("sensor", _PLACE)
_SCAN = _SCAN.add("polygons", T.ArrayType(T.ArrayType(T.ArrayType(_PLACE)))).add("style", T.MapType(T.StringType(), T.StringType())).add("error", "string")
_hex = re.compile("[0-9A-Fa-f]{8}")


def _tag(element, *path: str) -> str | None:
    """The trimmed text at a path of element names; null if there is none."""
    found = element.find("/".join(_NS + p for p in path))
    return (found.text or "").strip() or None if found is not None else None


def _style(element) -> dict[str, str]:
    out = {}
    for kind in ("Icon", "Line", "Poly"):
        one = element.find(f"{_NS}{kind}Style")
        if one is None:
            continue
        color = _tag(one, "color")
        if color and _hex.fullmatch(color):
            css = "#" + color[6:8] + color[4:6] + color[2:4]
            out |= {"Icon": {"icon_color": color}, "Line": {"line_color": css}, "Poly": {"fill_color": css, "fill_opacity": str(int(color[:2], 16) / 255.0)}}[kind]
        for tag, name in {"Icon": {"scale": "icon_scale"}, "Line": {"width": "line_width"}, "Poly": {}}[kind].items():
            try:
                out[name] = str(float(_tag(one, tag) or ""))
            except ValueError:
                continue
        if kind == "Icon" and (href := _tag(one, "Icon", "href")):
            out["icon_href"] = href
    return out


def _ring(text: str | None) -> list[dict[str, float]]:
    pairs = (p.split(",") for p in (text or "").split())
    return [{"lon": float(p[0]), "lat": float(p[1])} for p in pairs if len(p) >= 2]


def _rings(element) -> list[list[dict[str, float]]]:
    """A polygon's shell and holes; empty without a shell."""
    shell = _ring(_tag(element, "outerBoundaryIs", "LinearRing", "coordinates"))
    holes = (_ring(x.text) for x in element.findall(f"{_NS}innerBoundaryIs/{_NS}LinearRing/{_NS}coordinates"))
    return [shell, *(h for h in holes if h)] if shell else []


def parsed_coverage(content: bytes) -> list[dict]:
    """What one file holds: of each folder, or of the whole where no folder has both, the sensor and its outline.

    The sensor is the first point, or a later one whose name says Location; the outline the first geometry, or a later one whose
    name says Viewshed.  Styles are shared ones, through style maps however deep, or the placemark's own.
    """
    root = ET.fromstring(content)
    shared = {"#" + x.get("id"): x for x in root.iter(f"{_NS}Style") if x.get("id")}
    maps = {}
    for one in root.iter(f"{_NS}StyleMap"):
        for pair in one.findall(f"{_NS}Pair"):
            if _tag(pair, "key") == "normal" and _tag(pair, "styleUrl"):
                maps.setdefault("#" + (one.get("id") or ""), _tag(pair, "styleUrl"))

    def style_of(mark) -> dict[str, str]:
        url, met = _tag(mark, "styleUrl"), set()
        while url in maps and url not in met:
            met.add(url)
            url = maps[url]
        element = shared.get(url) if url else None
        element = mark.find(f"{_NS}Style") if element is None else element
        return {} if element is None else _style(element)

    def of(context) -> dict | None:
        sensor, name, outline, style = None, None, None, {}
        for mark in context.iter(f"{_NS}Placemark"):
            title = _tag(mark, "name") or ""
            if mark.find(f"{_NS}Point") is not None and (sensor is None or "Location" in title):
                style |= style_of(mark)
                at = _ring((_tag(mark, "Point", "coordinates") or "").replace(" ", ""))
                if at:
                    sensor, name = at[0], title
            if outline is None or "Viewshed" in title:
                style |= style_of(mark)
                parts = mark.findall(f"{_NS}Polygon")[:1] or mark.findall(f"{_NS}MultiGeometry/{_NS}Polygon")
                outline = [r for r in map(_rings, parts) if r] or outline
        if sensor and outline:
            return {"sensor_name": name, "sensor": sensor, "polygons": outline, "style": style}
        return None

    found = [{"folder_name": _tag(f, "name"), **one} for f in root.iter(f"{_NS}Folder") if (one := of(f))]
    return found or [{"folder_name": None, **one} for one in [of(root)] if one]


#: Bytes of files that a task hands on at a time.
READ_BYTES = 8 << 20


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files in a folder and below it, or of one file; names that begin with a dot or an underscore are skipped.

    The driver holds no file's name: one task lists the folder itself, and what is in it is dealt to tasks, which list the folders below and read.
    """

    def kept(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        return [f for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name[0] not in "._"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column("path").to_pylist():
                system, root = located(at)
                found = [f.path for f in kept(system, root)] if system.get_file_info(root).type == fs.FileType.Directory else [root]
                for low in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pydict({"path": found[low : low + 10_000]}, schema=pa.schema([("path", pa.string())]))

    def below(system: fs.FileSystem, at: str) -> Iterator[str]:
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(at)
        if info.type == fs.FileType.Directory:
            for f in kept(system, at):
                yield from below(system, f.path)
        else:
            yield at

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(path)
        done = lambda names, contents: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
        for batch in batches:
            names, contents, size = [], [], 0
            for name in (n for at in batch.column("path").to_pylist() for n in below(system, at)):
                with system.open_input_file(name) as f:
                    contents.append(f.read())
                names.append(name)
                size += len(contents[-1])
                if size >= READ_BYTES:
                    yield done(names, contents)
                    names, contents, size = [], [], 0
            if names:
                yield done(names, contents)

    top = spark.range(1).select(F.lit(path).alias("path")).mapInArrow(listed, "path string")
    return dealt(top, "path").mapInArrow(read, "path string, content binary")


def name_of(path: Column) -> Column:
    """A file's name, of the path as it is or as an address."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path.startswith("file:/") | path.contains("://"), F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)).otherwise(name)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """(file, folder_name, sensor_name, sensor, polygons, style, error): a row for each sensor with an outline in the KML files under a path.

    A file that can't be read gives one row that holds only its name and the error, so that it stops nothing else.  A
    task reads a file at a time.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [{"file": file, "error": None, **r, "style": list(r["style"].items())} for r in parsed_coverage(content.as_py())]
                except (ET.ParseError, ValueError, LookupError) as e:
                    rows = [{"file": file, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return _files(spark, path).mapInArrow(run, _SCAN).withColumn("file", name_of(F.col("file")))


_POINTS = pa.list_(pa.list_(pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())]))))
_ARROW = pa.schema([("file", pa.string()), ("folder_name", pa.string()), ("sensor_name", pa.string()), ("sensor", pa.struct([("lon", pa.float64()), ("lat", pa.float64())])), ("polygons", _POINTS), ("style", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, metadata): all extended data of each file by name, of equal names the last; an empty map where a file can't be read."""

    def run(batches):
        for batch in batches:
            maps = []
            for content in batch.column(1):
                found = {}
                try:
                    for data in ET.fromstring(content.as_py()).iterfind(f".//{_NS}ExtendedData/{_NS}Data"):
                        value = data.find(f"{_NS}value")
                        if data.get("name") and value is not None and value.text:
                            found[data.get("name")] = value.text
                except ET.ParseError:
                    found = {}
                maps.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["file", "metadata"])

    return _files(spark, path).mapInArrow(run, "file string, metadata map<string,string>").withColumn("file", name_of(F.col("file")))
