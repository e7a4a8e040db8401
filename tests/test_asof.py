"""Nearest known places over range partitions, and directions between samples."""

import math
import random

import pytest
from pyspark.sql import functions as F

from axistab.operators import asof
from axistab.plans import cf


def rows_of(n, keys, rng):
    return [(rng.choice(keys), round(rng.uniform(0, 50), 1) if rng.random() < 0.97 else None) for _ in range(n)]


@pytest.mark.parametrize("keys", [[1], [1, 2, None, 3]])
def test_brackets_equal_brute_force(spark, keys):
    rng = random.Random(len(keys))
    wanted, known = rows_of(300, [*keys, 9], rng), rows_of(120, keys, rng)
    frame = lambda rows: spark.createDataFrame(rows, "key int, at double").repartition(5)
    out = asof.bracket(frame(wanted), frame(known), ["key"], "at")
    assert out.columns == ["key", "at", "below", "above"]
    have = lambda k: [a for c, a in known if c == k and a is not None]
    expected = {
        (k, a): (max((x for x in have(k) if x <= a), default=None), min((x for x in have(k) if x >= a), default=None))
        for k, a in wanted if a is not None
    }
    got = out.collect()
    assert len(got) == len(expected) and {(r["key"], r["at"]): (r["below"], r["above"]) for r in got} == expected
    near = {(r["key"], r["at"]): r["nearest"] for r in asof.nearest(frame(wanted), frame(known), ["key"], "at").collect()}
    assert near == {(k, a): min(have(k), key=lambda x: (abs(x - a), x), default=None) for k, a in expected}
    assert asof.bracket(frame(wanted).limit(0), frame(known), ["key"], "at").count() == 0
    assert asof.bracket(frame(wanted), frame(known).limit(0), ["key"], "at").filter("below is not null or above is not null").count() == 0


def test_one_key_lies_over_many_partitions(spark):
    """Known places are few and far apart, so most partitions have none and take them from others; no window is over the key."""
    known = spark.createDataFrame([(0, 5.0), (0, 9000.5)], "key int, at double")
    wanted = spark.range(20_000).select(F.lit(0).alias("key"), F.col("id").cast("double").alias("at"))
    out = asof.bracket(wanted, known, ["key"], "at")
    wrong = out.filter(~(F.col("below").eqNullSafe(F.when(F.col("at") >= 9000.5, 9000.5).when(F.col("at") >= 5, 5.0)))
                       | ~(F.col("above").eqNullSafe(F.when(F.col("at") <= 5, 5.0).when(F.col("at") <= 9000.5, 9000.5))))
    assert out.count() == 20_000 and wrong.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line and "__have" in line]
    assert windows and all("windowspecdefinition(__part" in line for line in windows)


def test_nearest_coefficients_of_null_classes(spark):
    known = spark.createDataFrame([(None, 1.0, 0, 5.0, 6.0), (None, 3.0, 1, 7.0, 8.0), (1, None, 0, 1.0, 1.0)], "c int, frequency double, k int, re double, im double")
    wanted = spark.createDataFrame([(None, 1.9), (None, 2.0), (1, 1.0), (None, 2.5), (2, None)], "c int, frequency double")
    out = {(r["c"], r["frequency"], r["k"]): (r["re"], r["im"]) for r in cf.nearest_frequency_coeffs(wanted, known, ["c"], 2).collect()}
    zero = (0.0, 0.0)
    assert out == {
        (None, 1.9, 0): (5.0, 6.0), (None, 1.9, 1): zero, (None, 2.0, 0): (5.0, 6.0), (None, 2.0, 1): zero, (None, 2.5, 0): zero, (None, 2.5, 1): (7.0, 8.0),
        (1, 1.0, 0): zero, (1, 1.0, 1): zero,
    }


def test_directions_between_samples(spark):
    turn = math.pi / 180
    samples = [("m", 0.0, 350 * turn, 0.0), ("m", 10.0, 10 * turn, 0.0), ("p", 0.0, 0.0, 80 * turn), ("p", 4.0, 180 * turn, 80 * turn)]
    samples += [("o", 0.0, 0.0, 0.0), ("o", 1.0, 180 * turn, 0.0), ("s", 2.0, 1.0, 0.5)]
    wanted = [("m", 0.0), ("m", 2.5), ("m", 5.0), ("m", 10.0), ("m", 11.0), ("m", -1.0), ("p", 2.0), ("p", 1.0), ("o", 0.5), ("s", 2.0), ("none", 1.0)]
    out = asof.interpolated(
        spark.createDataFrame(wanted, "body string, t double"), spark.createDataFrame(samples, "body string, t double, lon double, lat double"), ["body"], "t",
        asof.on_sphere, ["lon", "lat"],
    )
    got = {(r["body"], r["t"]): None if r["lon"] is None else (round(r["lon"] / turn % 360, 6) % 360, round(r["lat"] / turn, 6)) for r in out.collect()}
    assert got == {
        ("m", 0.0): (350, 0), ("m", 2.5): (355, 0), ("m", 5.0): (0, 0), ("m", 10.0): (10, 0), ("m", 11.0): None, ("m", -1.0): None, ("p", 1.0): (0, 85),
        ("p", 2.0): (got["p", 2.0][0], 90), ("o", 0.5): None, ("s", 2.0): (round(1 / turn, 6), round(0.5 / turn, 6)), ("none", 1.0): None,
    }
