"""Detection ranges: earlier outputs grouped by altitude, combined in scenarios, clipped to ranges and united."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_altitude, label
from ..sources.files import few


def parsed(items: DataFrame) -> DataFrame:
    """Items with altitude, reference, sensor_height and sensor from their file names; those without an altitude go."""
    return items.withColumn("__f", file_altitude(F.col("filename"))).select(*items.columns, "__f.*").where("altitude IS NOT NULL")


def grouped(items: DataFrame) -> DataFrame:
    """Groups by altitude, reference and sensor height (nulls are a key), numbered by altitude, then by first appearance."""
    groups = items.groupBy("altitude", "reference", "sensor_height").agg(F.min("ordinal").alias("first_seen"), F.count("*").alias("items"))
    return groups.withColumn("group_no", F.row_number().over(Window.orderBy("altitude", "first_seen")))  # a row for each group of outputs


def scenarios(items: DataFrame, by: list[str]) -> DataFrame:
    """Scenario v takes of each location the item number min(v, its last): as many scenarios as the fullest location has items.

    Items are numbered per location; the last one is repeated only as often as scenarios lack an item, so nothing is a cross product.
    """
    place = [*by, "lon5", "lat5"]
    rows = items.withColumn("lon5", F.bround("lon", 5)).withColumn("lat5", F.bround("lat", 5))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy("ordinal")) - 1)
    sizes = rows.groupBy(*place).agg(F.count("*").alias("here"))
    most = sizes.groupBy(*by).agg(F.max("here").alias("variants"))
    known = sizes.join(most.withColumnsRenamed({b: f"m_{b}" for b in by}), [F.col(b).eqNullSafe(F.col(f"m_{b}")) for b in by]).drop(*(f"m_{b}" for b in by))
    known = known.withColumnsRenamed({c: f"k_{c}" for c in place})
    joined = rows.join(known, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in place]).drop(*(f"k_{c}" for c in place))
    last = F.when(F.col("n") == F.col("here") - 1, F.col("variants") - 1).otherwise(F.col("n"))
    return joined.withColumn("scenario", F.explode(F.sequence(F.col("n").cast("long"), last.cast("long"))))


def clipped(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """``cells`` (..., dist_m) x ranges (range_km) that reach them; what no range reaches is gone, so nothing empty is left."""
    return cells.join(few(ranges), F.col("dist_m") <= F.col("range_km") * 1000)


def base_name(given: str | None, sensors: Column, union: bool) -> Column:
    """A given name, with the sensor's where outputs are split; else the only sensor's name, or Union."""
    one = sensors[0]
    if given:
        return F.lit(given) if union else F.concat(F.lit(f"{given}_"), one)
    return F.when(F.size(sensors) == 1, one).otherwise("Union")


def detection_ranges(items: DataFrame, cells: DataFrame, ranges: DataFrame, union: bool = True, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Outputs (filename, group_no, altitude, reference, range_km, scenario, sensors, names, style), and their cells (filename, row, col).

    ``items`` (ordinal, filename, name, lon, lat, altitude, reference, sensor_height, style) fall into groups, and in a group into scenarios;
    ``cells`` are theirs (ordinal, row, col, dist_m).  Each scenario is clipped to each range; with ``union`` its items' cells
    are one output, without it each item is one.  An output without cells is none.  Items meet their cells once; cells are
    multiplied by scenarios only where an item stands for several.
    """
    by = ["altitude", "reference", "sensor_height"]
    groups = grouped(items).drop("items", "first_seen")
    numbered = items.join(few(groups.withColumnsRenamed({b: f"g_{b}" for b in by})), [F.col(b).eqNullSafe(F.col(f"g_{b}")) for b in by]).drop(*(f"g_{b}" for b in by))
    shown = scenarios(numbered, ["group_no"]).withColumn("several", F.col("variants") > 1)
    reached = clipped(cells, ranges).groupBy("ordinal", "range_km").agg(F.count("*").alias("n"))
    parts = shown.select("group_no", *by, "scenario", "several", "ordinal", "name", "lon", "lat", "style").join(reached.drop("n"), "ordinal")
    key = ["group_no", "altitude", "reference", "scenario", "several", "range_km", *([] if union else ["ordinal"])]
    sensor = F.struct("ordinal", F.col("name").alias("name"), F.col("lon").alias("lon"), F.col("lat").alias("lat"), F.col("style").alias("style"))
    outputs = parts.groupBy(*key).agg(F.array_sort(F.collect_list(sensor.dropFields("style"))).alias("s"), F.min_by("style", "ordinal").alias("style"))  # a network's sensors
    names = F.transform("s", lambda x: x["name"])
    suffix = F.concat(F.when(F.col("reference").isNotNull(), F.concat(F.lit("_"), F.upper("reference"))).otherwise(""), F.lit("-det_rng_"), label(F.col("range_km")), F.lit("km"))
    variant = F.when(F.col("several"), F.concat(F.lit("-var"), (F.col("scenario") + 1).cast("string"))).otherwise("")
    filename = F.concat(F.lpad(F.col("group_no").cast("string"), 2, "0"), F.lit("_coverage-"), base_name(name, names, union), F.lit("-tgt_alt_"), label(F.col("altitude")), F.lit("m"), suffix, variant, F.lit(".kml"))
    outputs = outputs.select(*key, "s", "style", F.size("s").alias("sensors"), F.array_join(names, ", ").alias("names"), filename.alias("filename"))
    members = outputs.select("filename", "range_km", F.explode("s").alias("m")).select("filename", "range_km", "m.ordinal")
    own = clipped(cells, ranges).join(members, ["ordinal", "range_km"]).select("filename", "row", "col").distinct()
    return outputs, own
