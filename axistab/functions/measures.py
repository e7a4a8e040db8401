"""Measures whose reference differs from row to row: time scales and direction frames, converted by each row's code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axistab.functions.expr import DEGREE, J2000, LEAP_SECONDS, let
from axistab.operators.joins import join_same

#: Numbers of the time scales and direction frames that code columns hold where they bring no table. Fixed values.
EPOCH_CODES = {4: "UT1", 6: "UTC", 7: "TAI", 8: "TDT", 9: "TCG", 10: "TDB"}
DIRECTION_CODES = {0: "J2000", 8: "GALACTIC", 15: "ECLIPTIC", 18: "SUPERGAL"}
#: TDT - TAI in seconds, and the rate of TCG against TDT and the day from which they differ. Fixed values.
TDT_TAI, TCG_RATE, TCG_DAY = 32.184, 6.969290134e-10, 43144.0003725
_EPOCH_DAY = 40587


def _leap_table() -> list[tuple[float, int]]:
    """(second of the modified Julian date in UTC, TAI - UTC from then on)."""
    from datetime import date

    return [((date.fromisoformat(d).toordinal() - date(1970, 1, 1).toordinal() + _EPOCH_DAY) * 86400.0, n) for d, n in LEAP_SECONDS]


def _leap_seconds(seconds: Column, in_tai: bool) -> Column:
    """TAI - UTC at a time, given in UTC or in TAI; null before the first leap second."""
    table = _leap_table()
    since = F.array(*(F.lit(s + n if in_tai else s) for s, n in table))
    number = F.size(F.filter(since, lambda s: s <= seconds))
    return F.try_element_at(F.array(*(F.lit(float(n)) for _, n in table)), F.when(number > 0, number))


def _tdb_tdt(seconds: Column) -> Column:
    """TDB - TDT in seconds, to a few hundredths of a millisecond."""
    g = (F.lit(357.53) + (seconds / 86400.0 - J2000) * 0.9856003) * DEGREE
    return F.sin(g) * 0.001658 + F.sin(g * 2) * 0.000014


def _tcg_tdt(seconds: Column) -> Column:
    return (seconds - TCG_DAY * 86400.0) * TCG_RATE


def _by(scale: Column, cases: dict[str, Column]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in cases.items():
        out = F.when(scale == name, value).otherwise(out)
    return out


def epoch_to(seconds: Column, scale: Column, to: str, dut1: Column | float = 0.0) -> Column:
    """A time in seconds of the modified Julian date, in the scale that the row names (``UTC, UT1, TAI, TDT, TDB, TCG``), in ``to``.

    ``dut1``: UT1 - UTC. Null for other scales, and for UTC and UT1 before 1972. Both TDB and TCG are to within microseconds of
    what a full series gives over a few decades.
    """
    dut1 = F.lit(float(dut1)) if isinstance(dut1, (int, float)) else dut1
    utc = F.when(scale == "UT1", seconds - dut1).otherwise(seconds)
    tai = _by(
        scale,
        {
            "UTC": utc + _leap_seconds(utc, False), "UT1": utc + _leap_seconds(utc, False), "TAI": seconds, "TDT": seconds - TDT_TAI,
            "TDB": seconds - _tdb_tdt(seconds) - TDT_TAI, "TCG": (seconds + TCG_DAY * 86400.0 * TCG_RATE) / (1 + TCG_RATE) - TDT_TAI,
        },
    )
    if to not in EPOCH_CODES.values():
        raise ValueError(f"no such time scale: {to}")

    def target(v: Column) -> Column:
        tai = v["tai"]
        tdt = tai + TDT_TAI
        out = {"TAI": tai, "TDT": tdt, "TDB": tdt + _tdb_tdt(tdt), "TCG": tdt + (tdt - TCG_DAY * 86400.0) * TCG_RATE}
        return out[to] if to in out else tai - _leap_seconds(tai, True) + (v["dut1"] if to == "UT1" else F.lit(0.0))

    return let({"tai": tai, "dut1": dut1}, target)


#: Rotations from J2000 to galactic, and from galactic to supergalactic coordinates; the tilt of the ecliptic of J2000. Fixed values.
GALACTIC = (
    (-0.054875560416215368, -0.873437090234885049, -0.483835015548713227),
    (0.494109427875583674, -0.444829629960011178, 0.746982244497218890),
    (-0.867666149019004701, -0.198076373431201528, 0.455983776175066922),
)
SUPERGALACTIC = (
    (-0.735742574804373, 0.677261296413894, 0.0),
    (-0.0745537783652338, -0.0809914713069767, 0.993922590399775),
    (0.673145302109208, 0.731271165816965, 0.110081262224782),
)
TILT = 84381.448 * math.pi / 648000


def _product(a, b) -> tuple:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


#: From J2000 to each frame.
FRAMES = {
    "J2000": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), "GALACTIC": GALACTIC, "SUPERGAL": _product(SUPERGALACTIC, GALACTIC),
    "ECLIPTIC": ((1.0, 0.0, 0.0), (0.0, math.cos(TILT), math.sin(TILT)), (0.0, -math.sin(TILT), math.cos(TILT))),
}


def direction_to(lon: Column, lat: Column, frame: Column, to: str) -> Column:
    """``lon, lat`` in radians of a direction in the frame that the row names, in ``to``; longitudes from 0 to 2 pi.

    Frames are fixed rotations of each other: ``J2000, GALACTIC, SUPERGAL, ECLIPTIC`` (of J2000). Null for others.
    """
    if to not in FRAMES:
        raise ValueError(f"no such frame: {to}")
    names = list(FRAMES)
    # From the row's frame to the target: one of a few matrices, picked by its number.
    tables = [_product(FRAMES[to], tuple(zip(*FRAMES[n], strict=True))) for n in names]
    every = F.array(*(F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in t)) for t in tables))
    number = F.array_position(F.array(*(F.lit(n) for n in names)), frame)
    matrix = F.try_element_at(every, F.when(number > 0, number.cast("int")))

    def rotated(v: Column) -> Column:
        x, y, z = v["c"] * F.cos(v["lon"]), v["c"] * F.sin(v["lon"]), v["s"]
        each = [v["m"][i][0] * x + v["m"][i][1] * y + v["m"][i][2] * z for i in range(3)]
        return let({"x": each[0], "y": each[1], "z": each[2]}, direction)

    def direction(p: Column) -> Column:
        flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        return F.struct(F.pmod(F.atan2(p["y"], p["x"]), F.lit(2 * math.pi)).alias("lon"), F.atan2(p["z"], flat).alias("lat"))

    whole = matrix.isNotNull() & lon.isNotNull() & lat.isNotNull()
    return F.when(whole, let({"m": matrix, "lon": lon, "c": F.cos(lat), "s": F.sin(lat)}, rotated))


def with_reference(df: DataFrame, code_col: str, codes: dict[int, str] | DataFrame, name: str = "reference") -> DataFrame:
    """The name of each row's reference beside its code: from ``codes``, by number, or a table ``code, name`` with integer or string codes.
    Unknown and null codes have none."""
    if isinstance(codes, dict):
        pairs = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair))
        return df.withColumn(name, pairs[F.col(code_col).cast("int")])
    table = codes.filter("code is not null").select(F.col("code").cast("string").alias("__code"), F.col("name").alias(name))
    return join_same(df.withColumn("__code", F.col(code_col).cast("string")), table, ["__code"], "left").drop("__code")


def converted_epochs(
    df: DataFrame, col: str, code_col: str, to: str, codes: dict[int, str] | DataFrame = EPOCH_CODES, offset_col: str | None = None,
    dut1: Column | float = 0.0, name: str = "epoch",
) -> DataFrame:
    """``df`` with the times of ``col`` in one scale: each row's code gives the scale it is in, and ``offset_col`` the time in that scale
    that it counts from (null: 0). Unknown codes and null times give null."""
    coded = with_reference(df, code_col, codes, "__scale")
    value = F.col(col) + (F.coalesce(F.col(offset_col), F.lit(0.0)) if offset_col else 0.0)
    return coded.withColumn(name, epoch_to(value, F.col("__scale"), to, dut1)).drop("__scale")


def converted_directions(
    df: DataFrame, lon: str, lat: str, code_col: str, to: str, codes: dict[int, str] | DataFrame = DIRECTION_CODES, offset: tuple[str, str] | None = None,
    name: str = "direction",
) -> DataFrame:
    """``df`` with directions in one frame, as ``struct<lon, lat>``; ``offset``: columns of longitude and latitude that a row's are
    added to, in its own frame."""
    coded = with_reference(df, code_col, codes, "__frame")
    start = [F.coalesce(F.col(c), F.lit(0.0)) for c in offset] if offset else [F.lit(0.0)] * 2
    return coded.withColumn(name, direction_to(F.col(lon) + start[0], F.col(lat) + start[1], F.col("__frame"), to)).drop("__frame")
