"""Time, place and direction: golden values, and what holds whatever the values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axistab.functions import expr
from axistab.operators import sky
from axistab.plans import cf

TURN = math.pi / 180


def value(spark, column, **inputs):
    return spark.range(1).select(*(F.lit(v).alias(n) for n, v in inputs.items())).select(column.alias("v")).first()["v"]


def test_sidereal_time(spark):
    hours = lambda days: value(spark, expr.sidereal_time(F.lit(days), F.lit(0.0))) / math.pi * 12
    assert abs(hours(2446895.5 - 2451545.0) - (13 + 10 / 60 + 46.1351 / 3600)) < 0.05 / 3600  # apparent, 1987 April 10
    assert abs(hours(0.0) - (18 + 41 / 60 + 50.54841 / 3600)) < 2 / 3600
    east = value(spark, expr.sidereal_time(F.lit(100.25), F.lit(1.0))) - value(spark, expr.sidereal_time(F.lit(100.25), F.lit(0.0)))
    assert abs(east % (2 * math.pi) - 1.0) < 1e-9
    assert value(spark, expr.days_of(F.lit(51544.5 * 86400))) == 0


def test_geodetic_places(spark):
    at = lambda p: value(spark, expr.geodetic(F.lit(p)))
    for p, lon, lat, height in (
        ([6378137.0, 0.0, 0.0], 0, 0, 0), ([0.0, 6378137.0 + 100, 0.0], 90, 0, 100), ([0.0, 0.0, -6356752.3142], 0, -90, 0),
        ([4517590.8788, 0.0, 4487348.4088], 0, 45, 0),
    ):
        got = at(p)
        assert abs(got["lat"] / TURN - lat) < 1e-8 and abs(got["height"] - height) < 1e-3 and (abs(lat) == 90 or abs(got["lon"] / TURN - lon) < 1e-9)
    rng = random.Random(1)
    for _ in range(5):
        lon, lat, h = rng.uniform(-3, 3), rng.uniform(-1.5, 1.5), rng.uniform(-50, 9000)
        e2 = expr.EARTH_FLATTENING * (2 - expr.EARTH_FLATTENING)
        n = expr.EARTH_AXIS / math.sqrt(1 - e2 * math.sin(lat) ** 2)
        got = at([(n + h) * math.cos(lat) * math.cos(lon), (n + h) * math.cos(lat) * math.sin(lon), (n * (1 - e2) + h) * math.sin(lat)])
        assert abs(got["lon"] - lon) < 1e-9 and abs(got["lat"] - lat) < 1e-9 and abs(got["height"] - h) < 1e-3
    assert at([1.0, 2.0]) is None and value(spark, expr.geodetic(F.lit(None).cast("array<double>"))) is None


def test_precession(spark):
    got = value(spark, expr.precessed(F.lit(41.054063 * TURN), F.lit(49.227750 * TURN), F.lit(2462088.69 - 2451545.0)))
    assert abs(got["lon"] / TURN - 41.547214) < 2e-6 and abs(got["lat"] / TURN - 49.348483) < 2e-6
    same = value(spark, expr.precessed(F.lit(6.0), F.lit(-0.5), F.lit(0.0)))
    assert abs(same["lon"] - 6.0) < 1e-12 and abs(same["lat"] + 0.5) < 1e-12


@pytest.fixture(scope="module")
def tables(spark):
    """An antenna of each mount at longitude 10, latitude 40 degrees; a source on the meridian south of the zenith, and one 3 hours west."""
    e2 = expr.EARTH_FLATTENING * (2 - expr.EARTH_FLATTENING)
    n = expr.EARTH_AXIS / math.sqrt(1 - e2 * math.sin(40 * TURN) ** 2)
    at = [n * math.cos(40 * TURN) * math.cos(10 * TURN), n * math.cos(40 * TURN) * math.sin(10 * TURN), n * (1 - e2) * math.sin(40 * TURN)]
    mounts = ["ALT-AZ", "EQUATORIAL", "ALT-AZ+NASMYTH-R", "ALT-AZ+NASMYTH-L", "X-Y", None]
    antenna = spark.createDataFrame([(i, m, at) for i, m in enumerate(mounts)] + [(6, "ALT-AZ", None)], "row int, mount string, position array<double>")
    noon = 5.0e9
    lst = value(spark, expr.sidereal_time(expr.days_of(F.lit(noon)), F.lit(10 * TURN)))
    field = spark.createDataFrame([(0, lst, 10 * TURN), (1, lst - math.pi / 4, 60 * TURN)], "row int, lon double, lat double")
    window = spark.createDataFrame([(0, 1), (1, None)], "row int, spectral_window_id int")
    feed = spark.createDataFrame([(a, 0, 1, [0.125, 5.0]) for a in range(7)] + [(0, 1, 1, [])], "antenna_id int, feed_id int, spectral_window_id int, receptor_angle array<double>")
    rows = [(n, noon, a, 0, 0, f) for n, (a, f) in enumerate([(a, f) for a in range(7) for f in (0, 1)])]
    rows += [(20, noon, 0, 1, 0, 0), (21, noon, 0, 0, 1, 0), (22, None, 0, 0, 0, 0), (23, noon, 99, 0, 0, 0), (24, noon, 0, 0, 0, None), (0, noon, 0, 0, 0, 0)]
    main = spark.createDataFrame(rows, "n int, time double, antenna1 int, feed1 int, data_desc_id int, field_id int")
    return main, window, antenna, feed, field


def test_parallactic_angles(tables):
    out = sky.parallactic_angles(*tables, j2000=False)
    assert out.columns == ["n", "time", "antenna1", "feed1", "data_desc_id", "field_id", "parang"]
    got = {r["n"]: r["parang"] for r in out.collect()}
    assert out.count() == 20
    h, d, b = math.pi / 4, 60 * TURN, 40 * TURN
    q = math.atan2(math.sin(h) * math.cos(b), math.sin(b) * math.cos(d) - math.cos(b) * math.sin(d) * math.cos(h))
    up = math.asin(math.sin(b) * math.sin(d) + math.cos(b) * math.cos(d) * math.cos(h))
    south = 60 * TURN
    expected = [0.0, q, 0.0, 0.0, south, q + up, -south, q - up, None, None, None, None, None, None]
    for n, angle in enumerate(expected):
        assert got[n] is None if angle is None else abs(got[n] - angle - 0.125) < 1e-8, n
    assert all(got[n] is None for n in (20, 21, 22, 23, 24))


def test_angles_of_j2000_directions(tables):
    """Half a century moves the direction by some hundredths of a degree times the years, and so the angle."""
    date, j2000 = ({r["n"]: r["parang"] for r in sky.parallactic_angles(*tables, j2000=x).collect()} for x in (False, True))
    assert all(0 < abs(date[n] - j2000[n]) < 0.02 for n in (1, 5, 7)) and date[2] == j2000[2]


def test_uvw_rotation(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1e4, 1e4) for _ in range(3)], rng.uniform(-3, 3), rng.uniform(-1.4, 1.4), rng.uniform(-3, 3), rng.uniform(-1.4, 1.4)) for i in range(50)]
    df = spark.createDataFrame(rows, "n int, b array<double>, h double, d double, h1 double, d1 double").select(
        "*", sky.uvw(F.col("b"), F.col("h"), F.col("d")).alias("one"), sky.uvw(F.col("b"), F.col("h1"), F.col("d1")).alias("two"),
        sky.uvw(F.transform("b", lambda x: -x), F.col("h"), F.col("d")).alias("back"),
    ).withColumn("turned", sky.rotated_uvw(F.col("one"), -F.col("h"), F.col("d"), -F.col("h1"), F.col("d1")))
    for r in df.collect():
        h, d = r["h"], r["d"]
        plain = np.array([
            [math.sin(h), math.cos(h), 0], [-math.sin(d) * math.cos(h), math.sin(d) * math.sin(h), math.cos(d)],
            [math.cos(d) * math.cos(h), -math.cos(d) * math.sin(h), math.sin(d)],
        ]) @ r["b"]
        assert np.allclose(r["one"], plain) and np.allclose(r["back"], -plain), "exchanged antennas give the opposite"
        assert np.allclose(r["turned"]["uvw"], r["two"]) and math.isclose(r["turned"]["dw"], r["two"][2] - r["one"][2], abs_tol=1e-8)
    phased = spark.range(1).select(sky.phase_turned(F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im")), F.lit(0.25), F.lit(1.0)).alias("v")).first()["v"]
    assert np.allclose([*phased], [0, -1])
    ant = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [5.0, 5.0, 5.0]), (3, None)], "row int, position array<double>")
    main = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, 3), (9, 1), (None, 2)], "antenna1 int, antenna2 int")
    got = {(r["antenna1"], r["antenna2"]): r["baseline"] for r in sky.baselines(main, ant).collect()}
    assert got == {(1, 2): [4, 3, 2], (2, 1): [-4, -3, -2], (1, 1): [0, 0, 0], (1, 3): None, (9, 1): None, (None, 2): None}


def test_aperture_as_matrix_products(spark):
    """A 150 x 150 grid with two axes, all 66 terms, null keys, pixels on the axes; and no rows of pixels times terms."""
    rng = random.Random(3)
    terms = [(key, px, py, rng.uniform(-1, 1), rng.uniform(-1, 1)) for key in (1, None) for px in range(11) for py in range(11 - px)]
    poly = spark.createDataFrame(terms, "key int, px int, py int, re double, im double")
    axis = spark.createDataFrame([(1, 0.0), (None, 0.4), (2, 0.0)], "key int, turn double")
    n = 75
    pixels = cf.grid_coordinates(cf.cf_axes([axis], n), n, 1.2, F.col("turn"))
    out = cf.aperture(pixels, poly, ["key"])
    assert out.columns == ["key", "turn", "x", "y", "cx", "cy", "value"]
    rows = out.collect()
    assert len(rows) == 2 * n * n
    for r in rng.sample(rows, 200) + [r for r in rows if r["cx"] == 0 or r["cy"] == 0][:50]:
        inside = r["cx"] ** 2 + r["cy"] ** 2 <= 1
        value = sum(complex(re, im) * r["cx"] ** px * r["cy"] ** py for key, px, py, re, im in terms if key == r["key"]) if inside else 0
        assert abs(complex(*r["value"]) - value) < 1e-9
    plan = out._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 1 and "Expand" not in plan
