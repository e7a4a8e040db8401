"""Scalar expressions on columns: angle bins, mounts, directions, time scales, units."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of ``values`` that are computed once, so that long formulas do not repeat them."""
    return F.transform(F.array(F.struct(*(c.alias(n) for n, c in values.items()))), use)[0]


def pa_bins(step: float) -> int:
    """The number of bins of a circle in ``step`` degrees; the last one may be narrower."""
    if step == 0 or not -360 <= step <= 360:
        raise ValueError("step must be within -360 and 360 and not 0")
    return math.ceil(360 / abs(step))


def pa_bin(angle: Column, origin: float, step: float) -> Column:
    """Bin of an angle in degrees, counted from ``origin`` in the direction of ``step``."""
    pa_bins(step)
    return F.floor(F.pmod((angle - F.lit(float(origin))) * F.lit(math.copysign(1.0, step)), F.lit(360.0)) / F.lit(abs(float(step)))).cast("bigint")


def pa_interval(index: Column, origin: float, step: float) -> Column:
    """``low, width`` of a bin in degrees; null for a bin that the circle does not have."""
    n, width = pa_bins(step), F.least(F.lit(abs(float(step))), F.lit(360.0) - index * F.lit(abs(float(step))))
    low = F.lit(float(origin)) + index * F.lit(float(step))
    return F.when((index >= 0) & (index < n), F.struct(low.alias("low"), width.alias("width")))


#: Codes of mounts and the names that stand for them. Fixed values.
MOUNT_CODES = {"ALT_AZ": 0, "EQUATORIAL": 1, "XY": 2, "ORBITING": 3, "NASMYTH_R": 4, "NASMYTH_L": 5, "OTHER": 6}
MOUNT_NAMES = {
    "": "ALT_AZ", "alt-az": "ALT_AZ", "ALT-AZ": "ALT_AZ", "alt-az+rotator": "ALT_AZ", "ALT-AZ+ROTATOR": "ALT_AZ",
    "equatorial": "EQUATORIAL", "EQUATORIAL": "EQUATORIAL", "x-y": "XY", "X-Y": "XY", "orbiting": "ORBITING", "ORBITING": "ORBITING",
    "alt-az+nasmyth-r": "NASMYTH_R", "ALT-AZ+NASMYTH-R": "NASMYTH_R", "alt-az+nasmyth-l": "NASMYTH_L", "ALT-AZ+NASMYTH-L": "NASMYTH_L",
}


def mount_code(mount: Column) -> Column:
    """Code of a mount's name; an unknown one is OTHER, null stays null."""
    names = F.create_map(*(x for k, v in MOUNT_NAMES.items() for x in (F.lit(k), F.lit(MOUNT_CODES[v]))))
    return F.when(mount.isNotNull(), F.coalesce(names[mount], F.lit(MOUNT_CODES["OTHER"])))


def antenna_class(classifier: Column | None = None) -> Column:
    """The class of an antenna: a caller's expression over its columns, else 0."""
    return F.lit(0) if classifier is None else classifier


def interp_direction(poly: Column, t: Column, t0: Column, tolerance: float = 1e-9) -> Column:
    """Sum of ``poly[k] (t - t0)^k`` by Horner; the constant term for a single coefficient or t near t0 (0 for none)."""
    dt = F.when((F.size(poly) == 1) | (F.abs(t - t0) <= tolerance), F.lit(0.0)).otherwise(t - t0)
    return F.aggregate(F.reverse(poly), F.lit(0.0), lambda a, c: a * dt + c)


def interp_directions(poly: Column, t: Column, t0: Column, tolerance: float = 1e-9) -> Column:
    """``interp_direction`` of every component: ``poly`` holds an array of components for each power, the constant first."""
    dt = F.when((F.size(poly) == 1) | (F.abs(t - t0) <= tolerance), F.lit(0.0)).otherwise(t - t0)
    powers = F.reverse(poly)
    each = F.transform(F.try_element_at(poly, F.lit(1)), lambda _, j: F.aggregate(powers, F.lit(0.0), lambda a, p: a * dt + F.element_at(p, j + 1)))
    return F.coalesce(each, F.array().cast("array<double>"))


def parallactic_angle(hour_angle: Column, latitude: Column, declination: Column) -> Column:
    """Angle between pole and zenith at the source, in radians."""
    return F.atan2(
        F.sin(hour_angle) * F.cos(latitude), F.sin(latitude) * F.cos(declination) - F.cos(latitude) * F.sin(declination) * F.cos(hour_angle),
    )


def elevation(hour_angle: Column, latitude: Column, declination: Column) -> Column:
    return F.asin(F.sin(latitude) * F.sin(declination) + F.cos(latitude) * F.cos(declination) * F.cos(hour_angle))


def feed_angle(mount: Column, hour_angle: Column, latitude: Column, declination: Column, receptor: Column) -> Column:
    """Angle of a feed on the sky by mount: the receptor's own, plus what the mount turns; null for other mounts."""
    turn, up = parallactic_angle(hour_angle, latitude, declination), elevation(hour_angle, latitude, declination)
    by = {"EQUATORIAL": F.lit(0.0), "ALT_AZ": turn, "NASMYTH_R": turn + up, "NASMYTH_L": turn - up}
    out = F.lit(None).cast("double")
    for name, angle in by.items():
        out = F.when(mount == MOUNT_CODES[name], angle + receptor).otherwise(out)
    return out


#: Days of the epoch J2000 and of a century; radians of a degree, an hour of right ascension and a second of arc. Fixed values.
J2000, CENTURY = 51544.5, 36525.0
DEGREE, HOUR, ARCSEC = math.pi / 180, math.pi / 12, math.pi / 648000
#: Half axis in metres and flattening of the earth's ellipsoid. Fixed values.
EARTH_AXIS, EARTH_FLATTENING = 6378137.0, 1 / 298.257223563
#: Mean sidereal time in degrees: constant, per day, per century squared, per century cubed. Fixed values.
SIDEREAL = (280.46061837, 360.98564736629, 0.000387933, -1 / 38710000)
#: Precession angles in seconds of arc per century, its square and its cube. Fixed values.
PRECESSION = {"zeta": (2306.2181, 0.30188, 0.017998), "z": (2306.2181, 1.09468, 0.018203), "theta": (2004.3109, -0.42665, -0.041833)}


def days_of(seconds: Column) -> Column:
    """Days since J2000 of a time in seconds of the modified Julian date."""
    return seconds / F.lit(86400.0) - F.lit(J2000)


def sidereal_time(days: Column, longitude: Column) -> Column:
    """Apparent sidereal time at a longitude (radians, east), in radians from 0 to 2 pi, at ``days`` of UT1 since J2000.

    Mean sidereal time and the two largest terms of the equation of the equinoxes, good to about 0.1 seconds of time a century
    either side of 2000.
    """
    t = days / CENTURY
    mean = (F.lit(SIDEREAL[0]) + days * SIDEREAL[1] + t * t * SIDEREAL[2] + t * t * t * SIDEREAL[3]) * DEGREE
    node, sun, tilt = (125.04 - days * 0.052954) * DEGREE, (280.47 + days * 0.98565) * DEGREE, (23.4393 - days * 0.0000004) * DEGREE
    equinoxes = (F.sin(node) * -0.000319 - F.sin(sun * 2) * 0.000024) * F.cos(tilt) * HOUR
    return F.pmod(mean + equinoxes + longitude, F.lit(2 * math.pi))


def geodetic(position: Column) -> Column:
    """``lon, lat`` in radians and ``height`` in metres of an earth-fixed position ``[x, y, z]`` in metres; null for an incomplete one."""
    a, f = EARTH_AXIS, EARTH_FLATTENING
    b, e2 = a * (1 - f), f * (2 - f)

    def reduced(v: Column) -> Column:
        theta = F.atan2(v["z"] * a, v["p"] * b)
        sine, cosine = F.sin(theta), F.cos(theta)
        lat = F.atan2(v["z"] + sine * sine * sine * (e2 / (1 - e2) * b), v["p"] - cosine * cosine * cosine * (e2 * a))
        return let({"lon": v["lon"], "lat": lat, "p": v["p"], "z": v["z"]}, with_height)

    def with_height(v: Column) -> Column:
        sine = F.sin(v["lat"])
        # The distance along the normal, from whichever component is not near 0.
        height = v["p"] * F.cos(v["lat"]) + v["z"] * sine - F.sqrt(1 - sine * sine * e2) * a
        return F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"), height.alias("height"))

    x, y, z = (F.try_element_at(position, F.lit(i)).cast("double") for i in (1, 2, 3))
    known = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return F.when(known, let({"lon": F.atan2(y, x), "p": F.sqrt(x * x + y * y), "z": z}, reduced))


def precessed(lon: Column, lat: Column, days: Column) -> Column:
    """``lon, lat`` in radians of a mean direction of J2000 at ``days`` since; longitudes from 0 to 2 pi."""
    t = days / CENTURY
    angle = {n: (t * c1 + t * t * c2 + t * t * t * c3) * ARCSEC for n, (c1, c2, c3) in PRECESSION.items()}

    def turned(v: Column) -> Column:
        a = F.cos(v["lat"]) * F.sin(v["lon"] + v["zeta"])
        b = F.cos(v["theta"]) * F.cos(v["lat"]) * F.cos(v["lon"] + v["zeta"]) - F.sin(v["theta"]) * F.sin(v["lat"])
        c = F.sin(v["theta"]) * F.cos(v["lat"]) * F.cos(v["lon"] + v["zeta"]) + F.cos(v["theta"]) * F.sin(v["lat"])
        return let({"a": a, "b": b, "c": c, "z": v["z"]}, direction)

    def direction(v: Column) -> Column:
        lon = F.pmod(F.atan2(v["a"], v["b"]) + v["z"], F.lit(2 * math.pi))
        return F.struct(lon.alias("lon"), F.atan2(v["c"], F.sqrt(v["a"] * v["a"] + v["b"] * v["b"])).alias("lat"))

    return let({"lon": lon, "lat": lat, **angle}, turned)


#: TAI - UTC in seconds from the given UTC date on. Fixed values.
LEAP_SECONDS = (
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14), ("1976-01-01", 15), ("1977-01-01", 16),
    ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19), ("1981-07-01", 20), ("1982-07-01", 21), ("1983-07-01", 22), ("1985-07-01", 23),
    ("1988-01-01", 24), ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29), ("1996-01-01", 30),
    ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
)


def epoch_shift(df: DataFrame, utc_col: str, out_col: str, to: str = "TAI") -> DataFrame:
    """Add the other time scale to a timestamp column: the last leap second at or before it (none before 1972: null)."""
    steps = [(F.lit(d).cast("timestamp"), F.lit(n)) for d, n in LEAP_SECONDS]
    shift = F.lit(None).cast("int")
    for since, seconds in steps:
        at = F.col(utc_col) if to == "TAI" else F.col(utc_col) - F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
        shift = F.when(at >= since, seconds).otherwise(shift)
    sign = 1 if to == "TAI" else -1
    return df.withColumn(out_col, F.col(utc_col) + F.make_dt_interval(secs=(shift * sign).cast("decimal(18,6)")))


#: Size of units in the first unit of their kind. Fixed values.
UNITS = {
    "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "d": ("time", 86400.0),
    "m": ("length", 1.0), "km": ("length", 1000.0), "cm": ("length", 0.01),
    "rad": ("angle", 1.0), "deg": ("angle", math.pi / 180), "arcmin": ("angle", math.pi / 10800), "arcsec": ("angle", math.pi / 648000),
    "K": ("temperature", 1.0), "m/s": ("speed", 1.0), "km/s": ("speed", 1000.0), "rad/s": ("turn", 1.0), "m-2": ("column", 1.0), "Pa": ("pressure", 1.0), "hPa": ("pressure", 100.0),
    "Hz": ("frequency", 1.0), "kHz": ("frequency", 1e3), "MHz": ("frequency", 1e6), "GHz": ("frequency", 1e9),
}


def unit(col: Column, source: str, target: str) -> Column:
    """A value in another unit of the same kind."""
    if UNITS[source][0] != UNITS[target][0]:
        raise ValueError(f"{source} and {target} measure different things")
    return col * F.lit(UNITS[source][1] / UNITS[target][1])
