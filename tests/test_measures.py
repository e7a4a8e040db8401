"""Time scales, frames and w planes: golden values and round trips."""

import math
import random

import pytest
from pyspark.sql import functions as F

from axistab.functions import measures
from axistab.plans import wplanes

DAY, TURN = 86400.0, math.pi / 180


def test_time_scales(spark):
    """1990-01-01 is 25 seconds behind TAI, 1999-01-01 32; scales in and out again; unknown ones and nulls give null."""
    new = 47892 * DAY
    rows = [(0, 6, new, None), (1, 6, new - 0.5, None), (2, 7, new, None), (3, 8, new, None), (4, 4, new, None), (5, 10, new, None), (6, 9, new, None)]
    rows += [(7, 3, new, None), (8, None, new, None), (9, 6, None, None), (10, 6, 41316 * DAY, None), (11, 6, 10.0, new)]
    df = spark.createDataFrame(rows, "n int, code int, t double, since double")
    got = {r["n"]: r["epoch"] for r in measures.converted_epochs(df, "t", "code", "TAI", offset_col="since", dut1=0.5).collect()}
    shift = {n: None if got[n] is None else round(got[n] - new, 6) for n in got}
    assert {n: shift[n] for n in (0, 1, 2, 3, 4, 7, 8, 9, 10, 11)} == {0: 25, 1: 23.5, 2: 0, 3: -32.184, 4: 23.5, 7: None, 8: None, 9: None, 10: None, 11: 35}
    assert abs(shift[5] + 32.184) < 0.0017 and -32.184 - 0.5 < shift[6] < -32.184
    for to in ("UTC", "UT1", "TAI", "TDT", "TDB", "TCG"):
        there = spark.createDataFrame([(1.0 * i * 1e6 + new,) for i in range(40)], "t double").withColumn("v", measures.epoch_to(F.col("t"), F.lit("UTC"), to, 0.25))
        back = there.select((measures.epoch_to(F.col("v"), F.lit(to), "UTC", 0.25) - F.col("t")).alias("d")).collect()
        assert max(abs(r["d"]) for r in back) < 2e-5
    with pytest.raises(ValueError):
        measures.epoch_to(F.lit(1.0), F.lit("UTC"), "LAST")


def test_frames(spark):
    golden = [("J2000", 266.40499, -28.93617, "GALACTIC", 0, 0), ("J2000", 192.85948, 27.12825, "GALACTIC", None, 90), ("GALACTIC", 47.37, 6.32, "SUPERGAL", None, 90)]
    golden += [("J2000", 90, 23 + 26 / 60 + 21.448 / 3600, "ECLIPTIC", 90, 0), ("GALACTIC", 137.37, 0, "SUPERGAL", 0, 0)]
    for frame, lon, lat, to, lon1, lat1 in golden:
        r = spark.range(1).select(measures.direction_to(F.lit(lon * TURN), F.lit(lat * TURN), F.lit(frame), to).alias("d")).first()["d"]
        assert abs(r["lat"] / TURN - lat1) < 2e-5 and (lon1 is None or abs((r["lon"] / TURN - lon1 + 180) % 360 - 180) < 2e-5)
    rng = random.Random(1)
    rows = [(i, list(measures.FRAMES)[i % 4], rng.uniform(0, 6.2), rng.uniform(-1.5, 1.5)) for i in range(40)] + [(40, "AZEL", 1.0, 1.0), (41, None, 1.0, 1.0), (42, "J2000", None, 1.0)]
    df = spark.createDataFrame(rows, "n int, frame string, lon double, lat double")
    for to in measures.FRAMES:
        there = df.withColumn("d", measures.direction_to(F.col("lon"), F.col("lat"), F.col("frame"), to))
        back = {r["n"]: (r["b"], r["lon"], r["lat"]) for name in measures.FRAMES for r in there.filter(F.col("frame") == name).withColumn(
            "b", measures.direction_to(F.col("d.lon"), F.col("d.lat"), F.lit(to), name)).collect()}
        assert all(abs(b["lon"] - lon) < 1e-9 and abs(b["lat"] - lat) < 1e-9 for n, (b, lon, lat) in back.items() if n < 42)
        assert there.filter("n >= 40 and d is not null").count() == 0
    codes = spark.createDataFrame([("g", "GALACTIC"), (None, "J2000"), ("x", None)], "code string, name string")
    named = measures.with_reference(spark.createDataFrame([("g",), ("x",), ("y",), (None,)], "code string"), "code", codes).collect()
    assert {r["code"]: r["reference"] for r in named} == {"g": "GALACTIC", "x": None, "y": None, None: None}
    moved = measures.converted_directions(spark.createDataFrame([(0, 0.25, 0.5, 0.25, None)], "code int, a double, b double, c double, d double"), "a", "b", "code", "J2000", offset=("c", "d"))
    assert [round(x, 9) for x in moved.first()["direction"]] == [0.5, 0.5]


def test_w_planes(spark):
    """Quantiles of merged sketches lie within the stated rank error; rows lie within half a step of their plane."""
    rng = random.Random(5)
    values = [rng.expovariate(1 / 300.0) * rng.choice([-1, 1]) for _ in range(40_000)]
    df = spark.createDataFrame([(i % 8, w) for i, w in enumerate(values)] + [(0, None), (1, float("nan")), (9, None)], "part int, w double")
    merged = wplanes.merged_sketches(wplanes.w_sketches(df, ["part"]), []).select("n", *(wplanes.w_quantile(F.col("sketch"), q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.9, 0.999, 1.0)))).first()
    size = sorted(map(abs, values))
    assert merged["n"] == 40_000 and merged["q4"] == size[-1]
    for i, q in enumerate((0.1, 0.5, 0.9, 0.999)):
        assert abs(sum(x <= merged[f"q{i}"] for x in size) / len(size) - q) <= wplanes.RANK_ERROR
    got = {r["part"]: r for r in wplanes.w_planes(df, ["part"], 0.02, 0.05).collect()}
    assert set(got) == set(range(8)) and all(got[p]["top"] == max(abs(w) for w in values[p::8]) for p in got)
    step = wplanes.plane_step(0.02, 0.05)
    rows = df.join(spark.createDataFrame([(p, got[p]["planes"]) for p in got], "part int, planes long"), "part").filter("not isnan(w)").withColumn("plane", wplanes.plane_of(F.col("w"), step, F.col("planes")))
    far = rows.agg(F.max(F.abs(F.abs("w") - F.col("plane") * step))).first()[0]
    assert far <= step / 2 + 1e-9 and 2 * math.pi * far * (1 - math.sqrt(1 - 0.02**2)) <= 0.05 + 1e-9
    assert rows.filter("plane < 0 or plane >= planes").count() == 0
    with pytest.raises(ValueError):
        wplanes.plane_step(0.0, 1.0)
