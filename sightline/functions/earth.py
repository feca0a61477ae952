"""Geometry of the Earth as column expressions: radii, horizons, grids, elevation angles, geodesics on the sphere and the ellipsoid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of WGS84, and the mean radius of the Earth.
A, FLAT = 6378137.0, 1 / 298.257223563
B, E2 = A * (1 - FLAT), FLAT * (2 - FLAT)
MEAN = 6371008.8


def effective_radius(lat: Column, k: float = 4 / 3) -> Column:
    """Gaussian radius of curvature at a latitude in degrees, times the refraction factor."""
    s = F.sin(F.radians(lat))
    w = 1 - E2 * s * s
    return F.sqrt((A * (1 - E2) / (w * F.sqrt(w))) * (A / F.sqrt(w))) * k


def horizon(height: Column, radius: Column) -> Column:
    """Distance to the horizon; null below sea level."""
    return F.when(height >= 0, F.sqrt(2.0 * radius * height))


def mutual_horizon(h1: Column, h2: Column, radius: Column) -> Column:
    """Distance at which two heights see each other over a smooth Earth; null if either is below sea level."""
    return horizon(h1, radius) + horizon(h2, radius)


def bounding_box(lat: Column, lon: Column, reach: Column) -> Column:
    """Degrees around a point; doesn't wrap at the date line or the poles.  Metres of a degree, and the least cosine, are fixed values."""
    north = reach / 111320.0
    east = reach / (111320.0 * F.greatest(F.lit(0.1), F.cos(F.radians(lat))))
    return F.struct((lon - east).alias("min_lon"), (lat - north).alias("min_lat"), (lon + east).alias("max_lon"), (lat + north).alias("max_lat"))


def plane_grid(reach: Column, res: Column) -> Column:
    """Half width and cells across of a sensor's square grid."""
    half = reach * 1.05
    return F.struct(half.alias("extent"), F.floor(2 * half / res).cast("int").alias("dim"))


def polar_grid(reach: Column, pixel: Column) -> Column:
    """Samples of a ray, and rays: one each pixel of the rim, 14400 (a fixed value) at most, an even number."""
    rays = F.least(F.ceil(2 * math.pi * reach / pixel), F.lit(14400)).cast("int")
    return F.struct(F.ceil(reach / pixel).cast("int").alias("n_r"), (rays + rays % 2).alias("n_az"))


def slope(elevation: Column, sensor: Column, r: Column, radius: Column, index: Column) -> Column:
    """Elevation angle (as a slope) of a terrain sample, less the Earth's curvature.  The height difference is single precision; the first sample hides nothing."""
    rise = (F.nanvl(F.coalesce(elevation.cast("float"), F.lit(0).cast("float")), F.lit(0).cast("float")) - sensor.cast("float")).cast("double")
    safe = F.when(r == 0, 0.1).otherwise(r)
    return F.when(index == 0, -9999.0).otherwise(rise / safe - safe / (2 * radius))


def visible_above(elevation: Column, sensor: Column, r: Column, radius: Column, steepest: Column, own: Column, index: Column) -> Column:
    """Height above ground from which a target is seen, past terrain of the steepest slope so far: not below 0, single precision.

    A sample whose ``own`` slope is the steepest is its own horizon, so its ground is seen: exactly 0, without the sum's rounding.
    """
    ground = F.nanvl(F.coalesce(elevation.cast("float"), F.lit(0).cast("float")), F.lit(0).cast("float")).cast("double")
    safe = F.when(r == 0, 0.1).otherwise(r)
    above = F.greatest(F.lit(0.0), sensor + safe * (steepest + safe / (2 * radius)) - ground)
    return F.when((index > 0) & (own == steepest), 0.0).otherwise(above).cast("float")


def polar_index(x: Column, y: Column, reach: Column, n_r: Column, n_az: Column) -> Column:
    """Ray and sample that a plane cell falls on."""
    az = F.atan2(x, y)
    return ray_index(F.when(az < 0, az + 2 * math.pi).otherwise(az), F.sqrt(x * x + y * y), reach, n_r, n_az)


def sphere_direct(lat: Column, lon: Column, az: Column, dist: Column, radius: float = MEAN) -> tuple[Column, Column]:
    """(lat, lon) at a distance in a direction (degrees) on the sphere."""
    p, t, d = F.radians(lat), F.radians(az), dist / radius
    sin_p2 = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t)
    return F.degrees(F.asin(sin_p2)), lon + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sin_p2))


def sphere_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN) -> Column:
    """Haversine distance in metres."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * radius * F.asin(F.sqrt(a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b))


def sphere_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Direction (radians from north, clockwise, in [0, 2 pi)) in which the second place lies."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    az = F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))
    return F.when(az < 0, az + 2 * math.pi).otherwise(az)


def ray_index(az: Column, r: Column, reach: Column, n_r: Column, n_az: Column) -> Column:
    """Ray and sample for a direction and a distance."""
    clip = lambda v, n: F.least(F.greatest(v.cast("int"), F.lit(0)), n - 1)
    return F.struct(clip(az / (2 * math.pi / n_az), n_az).alias("az_idx"), clip(r / (reach / F.greatest(n_r - 1, F.lit(1))), n_r).alias("r_idx"))


def with_geodesic(df: DataFrame, lat: str, lon: str, az: str, dist: str, steps: int = 5) -> DataFrame:
    """``df`` with lat2 and lon2: the geodesic of that azimuth and length on the ellipsoid, by Vincenty's series.  Inputs must be columns, not literals, as those fold slowly."""
    c = F.col
    out = df.withColumn("__t", (1 - FLAT) * F.tan(F.radians(c(lat)))).withColumn("__cu", 1 / F.sqrt(1 + c("__t") * c("__t")))
    out = out.withColumn("__su", c("__t") * c("__cu")).withColumn("__sa1", F.sin(F.radians(c(az)))).withColumn("__ca1", F.cos(F.radians(c(az))))
    out = out.withColumn("__s1", F.atan2(c("__t"), c("__ca1"))).withColumn("__sa", c("__cu") * c("__sa1")).withColumn("__c2a", 1 - c("__sa") * c("__sa"))
    out = out.withColumn("__u2", c("__c2a") * ((A * A - B * B) / (B * B)))
    out = out.withColumn("__A", 1 + c("__u2") / 16384 * (4096 + c("__u2") * (-768 + c("__u2") * (320 - 175 * c("__u2")))))
    out = out.withColumn("__B", c("__u2") / 1024 * (256 + c("__u2") * (-128 + c("__u2") * (74 - 47 * c("__u2")))))
    out = out.withColumn("__s", c(dist) / (B * c("__A")))
    for _ in range(steps):
        m, s = F.cos(2 * c("__s1") + c("__s")), F.sin(c("__s"))
        delta = c("__B") * s * (m + c("__B") / 4 * (F.cos(c("__s")) * (-1 + 2 * m * m) - c("__B") / 6 * m * (-3 + 4 * s * s) * (-3 + 4 * m * m)))
        out = out.withColumn("__s", c(dist) / (B * c("__A")) + delta)
    s, k, m = F.sin(c("__s")), F.cos(c("__s")), F.cos(2 * c("__s1") + c("__s"))
    x = c("__su") * s - c("__cu") * k * c("__ca1")
    out = out.withColumn("lat2", F.degrees(F.atan2(c("__su") * k + c("__cu") * s * c("__ca1"), (1 - FLAT) * F.sqrt(c("__sa") * c("__sa") + x * x))))
    lam = F.atan2(s * c("__sa1"), c("__cu") * k - c("__su") * s * c("__ca1"))
    q = FLAT / 16 * c("__c2a") * (4 + FLAT * (4 - 3 * c("__c2a")))
    turn = lam - (1 - q) * FLAT * c("__sa") * (c("__s") + q * s * (m + q * k * (-1 + 2 * m * m)))
    out = out.withColumn("lon2", c(lon) + F.degrees(turn))
    return out.drop(*[x for x in out.columns if x not in (*df.columns, "lat2", "lon2")])


def with_inverse(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 12) -> DataFrame:
    """``df`` with geo_m and geo_az: length of the geodesic between two places on the ellipsoid and its azimuth at the first (radians in [0, 2 pi)), by Vincenty's series.

    The shorter way round is taken.  Equal places are 0 m apart, in direction 0.  Both are null where the longitude on the auxiliary sphere still moves
    by 1e-12 after so many steps, as for places within about half a degree of each other's antipodes, or where a coordinate is null.
    """
    c = F.col
    out = df
    for n, lat in ((1, lat1), (2, lat2)):
        out = out.withColumn(f"__t{n}", (1 - FLAT) * F.tan(F.radians(c(lat)))).withColumn(f"__cu{n}", 1 / F.sqrt(1 + c(f"__t{n}") * c(f"__t{n}"))).withColumn(f"__su{n}", c(f"__t{n}") * c(f"__cu{n}"))
    out = out.withColumn("__l", F.radians(F.pmod(c(lon2) - c(lon1) + 180, F.lit(360.0)) - 180)).withColumn("__lam", c("__l")).withColumn("__was", c("__l"))

    def sphere(t: DataFrame) -> DataFrame:
        x, y = c("__cu2") * F.sin("__lam"), c("__cu1") * c("__su2") - c("__su1") * c("__cu2") * F.cos("__lam")
        t = t.withColumn("__ss", F.sqrt(x * x + y * y)).withColumn("__cs", c("__su1") * c("__su2") + c("__cu1") * c("__cu2") * F.cos("__lam")).withColumn("__s", F.atan2("__ss", "__cs"))
        t = t.withColumn("__sa", F.when(c("__ss") == 0, 0.0).otherwise(c("__cu1") * x / F.when(c("__ss") == 0, 1.0).otherwise(c("__ss")))).withColumn("__c2a", 1 - c("__sa") * c("__sa"))
        flat = c("__c2a") < 1e-15  # along the equator
        return t.withColumn("__m", F.when(flat, 0.0).otherwise(c("__cs") - 2 * c("__su1") * c("__su2") / F.when(flat, 1.0).otherwise(c("__c2a"))))

    for _ in range(steps):
        out = sphere(out)
        q = FLAT / 16 * c("__c2a") * (4 + FLAT * (4 - 3 * c("__c2a")))
        turn = (1 - q) * FLAT * c("__sa") * (c("__s") + q * c("__ss") * (c("__m") + q * c("__cs") * (-1 + 2 * c("__m") * c("__m"))))
        out = out.withColumns({"__was": c("__lam"), "__lam": c("__l") + turn})
    out = sphere(out).withColumn("__u2", c("__c2a") * ((A * A - B * B) / (B * B)))
    a = 1 + c("__u2") / 16384 * (4096 + c("__u2") * (-768 + c("__u2") * (320 - 175 * c("__u2"))))
    b = c("__u2") / 1024 * (256 + c("__u2") * (-128 + c("__u2") * (74 - 47 * c("__u2"))))
    out = out.withColumn("__A", a).withColumn("__B", b)
    m, b, ss = c("__m"), c("__B"), c("__ss")
    delta = b * ss * (m + b / 4 * (c("__cs") * (-1 + 2 * m * m) - b / 6 * m * (-3 + 4 * ss * ss) * (-3 + 4 * m * m)))
    az = F.atan2(c("__cu2") * F.sin("__lam"), c("__cu1") * c("__su2") - c("__su1") * c("__cu2") * F.cos("__lam"))
    settled = F.abs(c("__lam") - c("__was")) < 1e-12
    out = out.withColumn("geo_m", F.when(settled, B * c("__A") * (c("__s") - delta))).withColumn("geo_az", F.when(settled, F.when(ss == 0, 0.0).when(az < 0, az + 2 * math.pi).otherwise(az)))
    return out.drop(*[x for x in out.columns if x not in (*df.columns, "geo_m", "geo_az")])
