"""Names, colours, coordinates and metadata as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour for what isn't one.
BAD_COLOR = "ff0000ff"


def kml_color(rgb: Column, opacity: Column) -> Column:
    """#RRGGBB and an opacity to aabbggrr; anything else to BAD_COLOR."""
    part = lambda i: F.lower(F.substring(rgb, i, 2))
    alpha = F.lpad(F.lower(F.hex((F.coalesce(opacity, F.lit(1.0)) * 255).cast("int"))), 2, "0")
    return F.when(rgb.rlike("^#[0-9A-Fa-f]{6}$"), F.concat(alpha, part(6), part(4), part(2))).otherwise(BAD_COLOR)


def css_color(kml: Column) -> Column:
    """aabbggrr to struct(color #rrggbb, opacity)."""
    fine = kml.rlike("^[0-9A-Fa-f]{8}$")
    color = F.concat(F.lit("#"), F.substring(kml, 7, 2), F.substring(kml, 5, 2), F.substring(kml, 3, 2))
    return F.struct(F.when(fine, color).alias("color"), F.when(fine, F.conv(F.substring(kml, 1, 2), 16, 10).cast("int") / 255.0).alias("opacity"))


def label(number: Column) -> Column:
    """A number without decimals if it is whole."""
    return F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(number.cast("string"))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def metadata_html(entries: Column) -> Column:
    """A map's rows as an HTML table, in key order of the map."""
    rows = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit("<tr><td>"), escaped(e["key"]), F.lit("</td><td>"), escaped(e["value"]), F.lit("</td></tr>")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))


def extended_data(entries: Column) -> Column:
    rows = F.transform(F.map_entries(entries), lambda e: F.concat(F.lit('<Data name="'), escaped(e["key"]), F.lit('"><value>'), escaped(e["value"]), F.lit("</value></Data>")))
    return F.concat(F.lit("<ExtendedData>"), F.array_join(rows, ""), F.lit("</ExtendedData>"))


def coordinates(ring: Column, altitude: Column | None = None) -> Column:
    """An array of struct(lon, lat) as "lon,lat,altitude" texts, a space between."""
    z = F.lit("0.0") if altitude is None else altitude.cast("double").cast("string")
    return F.array_join(F.transform(ring, lambda p: F.concat(p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit(","), z)), " ")


def options(text: Column) -> Column:
    """The numbers of an option such as "100, 50,x": in order, without what is no number."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


#: Endings of elevation rasters, best first, and the marks of masks that come with them.
RASTERS, MASKS = (".dt2", ".dt1", ".tif"), ("_edm", "_flm", "_hem", "_acm", "_wbm")


def member_score(name: Column) -> Column:
    """How much a member of a terrain archive looks like the elevation raster: by its folder, its name and its ending; null if it is none."""
    low = F.lower(name)
    of = lambda marks, how: reduce(lambda a, b: a | b, (getattr(low, how)(m) for m in marks))
    ending = F.when(low.endswith(RASTERS[0]), 3).when(low.endswith(RASTERS[1]), 2).otherwise(0)
    score = F.when(low.contains("dem/"), 100).otherwise(0) + F.when(low.contains("_dem"), 50).otherwise(0) + ending
    return F.when(of(RASTERS, "endswith") & ~of(MASKS, "contains"), score)


def stamp(at: Column) -> Column:
    """A time as a name may hold it, and as metadata do."""
    return F.struct(F.date_format(at, "yyyyMMdd_HHmmss").alias("name"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def index_entries(document: Column) -> Column:
    """An index document, {"id": {"name": ..., "footprint": ...}}, as an array of struct(id, name, and the footprint's box); empty if it is none."""
    entries = F.map_entries(F.from_json(document, "map<string,struct<name:string,footprint:string>>"))
    return F.coalesce(F.transform(entries, lambda e: F.struct(e["key"].alias("id"), e["value"]["name"].alias("name"), footprint_box(e["value"]["footprint"]).alias("box"))), F.array())


def file_altitude(name: Column) -> Column:
    """struct(altitude, reference, sensor_height, sensor) that an output's file name tells; null where it doesn't."""
    got = lambda pattern, i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    pattern = r"tgt_alt_([0-9]+(?:\.[0-9]+)?)m?(?:_(MSL|AGL))?"
    return F.struct(
        got(pattern, 1).cast("double").alias("altitude"),
        F.lower(got(pattern, 2)).alias("reference"),
        got(r"_sh_([0-9]+(?:\.[0-9]+)?)m?", 1).cast("double").alias("sensor_height"),
        got(r"[a-z]+-(.+?)-tgt_alt", 1).alias("sensor"),
    )


def viewshed_name(sensor: Column, altitude: Column, altitudes: list[float], reference: str, height: Column | None = None) -> Column:
    """An output's file name: the place of its altitude among the run's (00 if it isn't one), sensor, height where a run has several, altitude and reference."""
    ordered = sorted(set(float(a) for a in altitudes))
    place = F.array_position(F.array(*(F.lit(a) for a in ordered)), altitude).cast("string")
    safe = F.replace(F.replace(sensor, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-"))
    tall = F.lit("") if height is None else F.concat(F.lit("_sh_"), label(height), F.lit("m"))
    return F.concat(F.when(F.length(place) < 2, F.concat(F.lit("0"), place)).otherwise(place), F.lit("_cover-"), safe, tall, F.lit("-tgt_alt_"), label(altitude), F.lit(f"m_{reference.upper()}.kml"))


def duration(seconds: Column) -> Column:
    """Whole seconds as "1h 2m 3s", leaving out leading zeros."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    part = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.concat_ws(" ", F.when(h > 0, part(h, "h")), F.when((h > 0) | (m > 0), part(m, "m")), part(s, "s"))


def footprint_box(wkt: Column) -> Column:
    """Bounds of a WKT polygon, with or without the geography'SRID=...;' around it; null if there is none."""
    pairs = F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+ -?[0-9.]+)"), 1), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y")))
    low, high = (lambda c: F.array_min(F.transform(pairs, lambda p: p[c]))), (lambda c: F.array_max(F.transform(pairs, lambda p: p[c])))
    return F.when(F.size(pairs) > 2, F.struct(low("x").alias("min_lon"), low("y").alias("min_lat"), high("x").alias("max_lon"), high("y").alias("max_lat")))
