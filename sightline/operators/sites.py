"""Sensor sites and tasks: heights, filters, combinations, styles, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.earth import effective_radius, horizon, mutual_horizon
from ..sources.files import few


def msl_height(mode: Column, altitude: Column, ground: Column, height: Column) -> Column:
    """A sensor's height above sea level.  An absolute altitude of 0 counts as none, so the ground is taken; null ground gives null."""
    base = F.when(mode == "relativeToGround", ground + F.coalesce(altitude, F.lit(0.0))).when(mode == "absolute", F.coalesce(F.nullif(altitude, F.lit(0.0)), ground)).otherwise(ground)
    return F.when(ground.isNotNull(), base + height)


def with_msl_height(sites: DataFrame) -> DataFrame:
    return sites.withColumn("msl", msl_height(F.col("altitude_mode"), F.col("input_altitude"), F.col("ground"), F.col("height")))


def named(sites: DataFrame, pattern: str) -> DataFrame:
    """Sites whose name contains a match of the pattern."""
    return sites.where(F.col("name").rlike(pattern))


def tasks(sites: DataFrame, altitudes: DataFrame, heights: list[float]) -> DataFrame:
    """Sites x heights x altitudes.  A site with an altitude of its own has only its own height.  The altitudes are broadcast if a count says that they are few."""
    own = F.col("altitude_mode").isin("relativeToGround", "absolute") & F.col("input_altitude").isNotNull()
    heights_of = F.when(own, F.array("height")).otherwise(F.array(*(F.lit(float(h)) for h in sorted(set(heights)))))
    return sites.withColumn("task_height", F.explode(heights_of)).crossJoin(few(altitudes))


def horizon_rings(sites: DataFrame, altitudes: DataFrame, k: float = 4 / 3) -> DataFrame:
    """Distance at which each site sees a target at each altitude over a smooth Earth.  A null ground is 0, or the altitude of an absolute site."""
    ground = F.coalesce("ground", F.when(F.col("altitude_mode") == "absolute", F.col("input_altitude")), F.lit(0.0))
    msl = msl_height(F.col("altitude_mode"), F.col("input_altitude"), ground, F.col("height"))
    rings = sites.withColumn("msl", msl).withColumn("radius", effective_radius(F.col("latitude"), k)).crossJoin(few(altitudes))
    return rings.withColumn("dist_m", mutual_horizon(F.col("msl"), F.col("alt_m"), F.col("radius"))).withColumn("own_m", horizon(F.col("msl"), F.col("radius")))


def pending(tasks: DataFrame, completed: DataFrame, force: bool = False) -> DataFrame:
    """Tasks without a completed output of the same file name and state."""
    return tasks if force else tasks.join(completed, ["filename", "state_hash"], "left_anti")


def state_hash(*parts: Column) -> Column:
    """Key of what decides an output; numbers are rendered to fixed places beforehand."""
    return F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)))


def fixed(value: Column, places: int) -> Column:
    """A number as text with so many decimals: its exact binary value to the nearest, halves to even.

    value * 10**places is taken without error as product + rest (by splitting both factors), so that a product that rounds to a
    half is not mistaken for one.
    """
    size, scale = F.abs(value), 10.0**places
    split = lambda x: (lambda c: c - (c - x))(x * 134217729.0)
    high, scale_high = split(size), 134217729.0 * scale - (134217729.0 * scale - scale)
    low, scale_low = size - high, scale - scale_high
    product = size * scale
    rest = (high * scale_high - product + high * scale_low + low * scale_high) + low * scale_low
    whole = F.floor(product)
    over = product - whole - 0.5
    over = F.when(over == 0, rest).otherwise(over)
    scaled = (whole + F.when((over > 0) | ((over == 0) & (whole % 2 == 1)), 1).otherwise(0)).cast("long")
    digits = F.lpad(scaled.cast("string"), F.greatest(F.length(scaled.cast("string")), F.lit(places + 1)), F.lit("0"))
    sign = F.when(value < 0, "-").otherwise("")
    if not places:
        return F.concat(sign, digits)
    return F.concat(sign, F.substring(digits, F.lit(1), F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places)))


def overlaid(own: Column, default: Column) -> Column:
    """Style maps: the sensor's entries over the defaults."""
    return F.map_filter(F.map_zip_with(F.coalesce(own, F.create_map().cast("map<string,string>")), default, lambda k, a, b: F.coalesce(a, b)), lambda k, v: v.isNotNull())


def last_by(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("__row")).select(key, *(F.col(f"__row.{c}").alias(c) for c in rest))
