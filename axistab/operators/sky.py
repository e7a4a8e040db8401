"""Columns of a main table that follow from time, antenna and direction."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axistab.functions import expr
from axistab.operators.joins import join_same
from axistab.sources.scratch import stage


def parallactic_angles(
    main: DataFrame, data_description: DataFrame, antenna: DataFrame, feed: DataFrame, field: DataFrame, name: str = "parang", j2000: bool = True,
    dut1: float = 0.0,
) -> DataFrame:
    """``main`` with the angle of each row's feed on the sky, in radians.

    ``main`` has ``time`` (seconds of the modified Julian date, UTC), ``antenna1, feed1, data_desc_id, field_id``; the others are
    looked up by ``row``: ``data_description`` (``spectral_window_id``), ``antenna`` (``position`` in earth-fixed metres, ``mount``, a
    name), ``field`` (``lon, lat``, the direction in radians, of J2000 or, without ``j2000``, of date); ``feed`` by ``antenna_id,
    feed_id, spectral_window_id`` (``receptor_angle``, whose first element counts). ``dut1``: UT1 - UTC in seconds.

    What the mount turns, the parallactic angle and the elevation, is computed once for each distinct time, antenna and field and
    joined back; for equatorial mounts it is 0, for mounts other than these, alt-azimuth and Nasmyth the angle is null. So it
    is where a row has no antenna, field, time or feed. Aberration, nutation but that of sidereal time, and polar motion are not
    taken into account: together about half a minute of arc of direction.
    """
    keys = ["time", "antenna1", "field_id"]
    places = antenna.select(F.col("row").alias("antenna1"), expr.geodetic(F.col("position")).alias("place"), expr.mount_code(F.col("mount")).alias("mount"))
    directions = field.select(F.col("row").alias("field_id"), F.col("lon").alias("lon0"), F.col("lat").alias("lat0"))
    # Three staged steps, so that neither table is computed for every row and formulas stay short.
    each = join_same(join_same(main.select(*keys).distinct(), places, ["antenna1"], "inner"), directions, ["field_id"], "inner")
    each = each.withColumn("days", expr.days_of(F.col("time") + F.lit(float(dut1))))
    if j2000:
        each = each.withColumn("to", expr.precessed(F.col("lon0"), F.col("lat0"), F.col("days")))
    else:
        each = each.withColumn("to", F.struct(F.col("lon0").alias("lon"), F.col("lat0").alias("lat")))
    each = stage(each.withColumn("hour", expr.sidereal_time(F.col("days"), F.col("place.lon")) - F.col("to.lon")), "places")
    turn = expr.feed_angle(F.col("mount"), F.col("hour"), F.col("place.lat"), F.col("to.lat"), F.lit(0.0))
    turned = stage(each.select(*keys, turn.alias("__turn")), "turns")
    windows = data_description.select(F.col("row").alias("data_desc_id"), F.col("spectral_window_id").alias("__window"))
    receptors = feed.select(
        F.col("antenna_id").alias("antenna1"), F.col("feed_id").alias("feed1"), F.col("spectral_window_id").alias("__window"),
        F.try_element_at("receptor_angle", F.lit(1)).alias("__receptor"),
    )
    out = join_same(join_same(main, windows, ["data_desc_id"], "left"), turned, keys, "left")
    out = join_same(out, receptors, ["antenna1", "feed1", "__window"], "left")
    return out.withColumn(name, F.col("__turn") + F.col("__receptor")).drop("__window", "__turn", "__receptor")


def baselines(main: DataFrame, antenna: DataFrame) -> DataFrame:
    """``main`` with ``baseline``: the position of ``antenna2`` less that of ``antenna1``, earth-fixed metres; null where one is unknown."""
    at = lambda one: antenna.select(F.col("row").alias(one), F.col("position").cast("array<double>").alias(f"__{one}"))
    out = join_same(join_same(main, at("antenna1"), ["antenna1"], "left"), at("antenna2"), ["antenna2"], "left")
    whole = (F.size("__antenna1") == 3) & (F.size("__antenna2") == 3)
    return out.withColumn("baseline", F.when(whole, F.zip_with("__antenna2", "__antenna1", lambda b, a: b - a))).drop("__antenna1", "__antenna2")


def uvw(baseline: Column, hour_angle: Column, declination: Column) -> Column:
    """``[u, v, w]`` in metres of an earth-fixed baseline towards a direction at an hour angle of Greenwich and a declination."""
    h, d = {"s": F.sin(hour_angle), "c": F.cos(hour_angle)}, {"s": F.sin(declination), "c": F.cos(declination)}

    def rotated(v: Column) -> Column:
        x, y, z = v["b"][0], v["b"][1], v["b"][2]
        toward = v["hc"] * x - v["hs"] * y
        return F.array(v["hs"] * x + v["hc"] * y, v["dc"] * z - v["ds"] * toward, v["dc"] * toward + v["ds"] * z)

    return expr.let({"b": baseline, "hs": h["s"], "hc": h["c"], "ds": d["s"], "dc": d["c"]}, rotated)


def rotated_uvw(vector: Column, lon: Column, lat: Column, new_lon: Column, new_lat: Column) -> Column:
    """``uvw`` of a vector (metres) towards another phase centre and ``dw``, by how much its last component changes.

    The phase of a visibility turns by -2 pi dw / wavelength. Directions in radians; the rotation back undoes it.
    """

    def axes(l: Column, b: Column, name: str) -> dict[str, Column]:  # noqa: E741
        return {f"{name}_sl": F.sin(l), f"{name}_cl": F.cos(l), f"{name}_sb": F.sin(b), f"{name}_cb": F.cos(b)}

    def to_sky(v: Column) -> Column:
        # Components along the celestial axes of u (east), v (north) and w (to the source).
        u, n, w = v["v"][0], v["v"][1], v["v"][2]
        x = w * v["a_cb"] * v["a_cl"] - n * v["a_sb"] * v["a_cl"] - u * v["a_sl"]
        y = w * v["a_cb"] * v["a_sl"] - n * v["a_sb"] * v["a_sl"] + u * v["a_cl"]
        return expr.let({"x": x, "y": y, "z": n * v["a_cb"] + w * v["a_sb"], "w": w, "k": v}, from_sky)

    def from_sky(p: Column) -> Column:
        k = p["k"]
        toward = p["x"] * k["b_cl"] + p["y"] * k["b_sl"]
        new = F.array(p["y"] * k["b_cl"] - p["x"] * k["b_sl"], p["z"] * k["b_cb"] - toward * k["b_sb"], toward * k["b_cb"] + p["z"] * k["b_sb"])
        return expr.let({"n": new, "w": p["w"]}, lambda q: F.struct(q["n"].alias("uvw"), (q["n"][2] - q["w"]).alias("dw")))

    return F.when(F.size(vector) == 3, expr.let({"v": vector, **axes(lon, lat, "a"), **axes(new_lon, new_lat, "b")}, to_sky))


def phase_turned(value: Column, dw: Column, wavelength: Column) -> Column:
    """A visibility (``struct<re, im>``) after its last component changed by ``dw``."""
    angle = F.lit(-2 * math.pi) * dw / wavelength
    terms = {"re": value["re"], "im": value["im"], "c": F.cos(angle), "s": F.sin(angle)}
    product = lambda v: F.struct((v["re"] * v["c"] - v["im"] * v["s"]).alias("re"), (v["re"] * v["s"] + v["im"] * v["c"]).alias("im"))
    return expr.let(terms, product)
