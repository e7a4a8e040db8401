"""Transforms of ranks one to three against numpy, whatever the tiles."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axistab.plans import cf
from axistab.plans.fft import fft, passes_of, rotation


def cells(rng, sizes, keep=0.8):
    out = []
    for key in (1, None):
        for at in np.ndindex(*sizes.values()):
            if rng.random() < keep:
                out.append((key, *map(int, at), (rng.uniform(-1, 1), rng.uniform(-1, 1))))
    return out


def expected(rows, sizes, sign, rotate_in, rotate_out):
    grid = np.zeros(tuple(sizes.values()), complex)
    for *at, (re, im) in rows:
        grid[tuple(at)] = complex(re, im)
    axes, shift = tuple(range(grid.ndim)), [-rotation(n) for n in grid.shape]
    grid = np.roll(grid, shift, axes) if rotate_in else grid
    grid = np.fft.ifftn(grid) * grid.size if sign > 0 else np.fft.fftn(grid)
    return np.roll(grid, shift, axes) if rotate_out else grid


@pytest.mark.parametrize("sizes", [{"x": 1}, {"x": 12}, {"x": 7, "y": 4}, {"x": 3, "y": 5, "z": 4}, {"x": 2, "y": 3, "z": 2, "s": 3}])
@pytest.mark.parametrize("tile", [1, 13, 1 << 16])
def test_transforms_equal_numpy(spark, sizes, tile):
    rng = random.Random(3)
    rows = cells(rng, sizes)
    df = spark.createDataFrame(rows, "key int, " + "".join(f"{a} int, " for a in sizes) + "value struct<re: double, im: double>").repartition(3)
    sign, turn_in, turn_out = rng.choice([1, -1]), rng.random() < 0.5, rng.random() < 0.5
    out = fft(df, ["key"], sizes, sign, turn_in, turn_out, tile=tile)
    assert out.columns == ["key", *sizes, "re", "im"]
    for key in (1, None):
        own = [r[1:] for r in rows if r[0] == key]
        grid = expected(own, sizes, sign, turn_in, turn_out)
        got = np.full(grid.shape, np.nan, complex)
        for r in out.filter(F.col("key").eqNullSafe(F.lit(key))).collect():
            got[tuple(r[a] for a in sizes)] = complex(r["re"], r["im"])
        assert np.allclose(got, grid) if own else np.isnan(got).all()


def test_a_transform_and_its_inverse(spark):
    sizes = {"x": 6, "y": 9}
    df = spark.createDataFrame(cells(random.Random(5), sizes, 1.0), "key int, x int, y int, value struct<re: double, im: double>").filter("key = 1")
    there = fft(df, ["key"], sizes, -1, False, False, tile=20).select("key", "x", "y", F.struct("re", "im").alias("value"))
    back = fft(there, ["key"], sizes, 1, False, False, normalised=True, tile=10)
    met = back.join(df, ["key", "x", "y"])
    assert met.count() == 54 and met.filter(F.abs(F.col("re") - F.col("value.re")) + F.abs(F.col("im") - F.col("value.im")) > 1e-12).count() == 0


def test_passes_edges_and_refusals(spark):
    assert passes_of({"x": 5, "y": 5}) == [["x", "y"]] and passes_of({"x": 512, "y": 512, "z": 2}) == [["x"], ["y", "z"]]
    assert passes_of({"x": 512, "y": 512}, 1 << 18) == [["x", "y"]]
    one = spark.createDataFrame([(1, 0, None), (1, 1, (2.0, None))], "key int, x int, value struct<re: double, im: double>")
    assert [(r["re"], r["im"]) for r in fft(one, ["key"], {"x": 2}, rotate_in=False, rotate_out=False).orderBy("x").collect()] == [(2.0, 0.0), (-2.0, 0.0)]
    assert fft(one.limit(0), ["key"], {"x": 2}).count() == 0
    with pytest.raises(ValueError):
        fft(one, ["key"], {})
    with pytest.raises(Exception, match="outside the array"):
        fft(one, ["key"], {"x": 1}).count()


def test_an_array_without_keys_is_spread_over_tasks(spark):
    """A plane of 200 x 150 cells in tiles of 600: no task gets more than a few of its lines."""
    grid = spark.range(30_000).select(
        F.floor(F.col("id") / 150).cast("int").alias("x"), (F.col("id") % 150).cast("int").alias("y"),
        F.struct(F.sin(F.col("id") * 0.37).alias("re"), F.cos(F.col("id") * 0.11).alias("im")).alias("value"),
    )
    out = fft(grid, [], {"x": 200, "y": 150}, -1, False, False, tile=600)
    got = np.zeros((200, 150), complex)
    for r in out.collect():
        got[r["x"], r["y"]] = complex(r["re"], r["im"])
    at = np.arange(30_000)
    assert np.allclose(got, np.fft.fft2((np.sin(at * 0.37) + 1j * np.cos(at * 0.11)).reshape(200, 150)))


def test_product_over_all_axes(spark):
    plane = lambda axis, values, n: spark.createDataFrame(
        [(v, x, y, (v + x, float(y)), 1.0 + v) for v in values for x in range(n) for y in range(n)],
        f"{axis} double, x int, y int, value struct<re: double, im: double>, weight double",
    )
    a, b, c = plane("a", [1.0, 2.0], 4), plane("b", [0.5], 2), plane("a", [1.0], 2).withColumn("c", F.lit(7))
    out = cf.cf_product_all([(a, 4, ["a"]), (b, 2, ["b"]), (c, 2, ["a", "c"])])
    assert out.columns == ["a", "b", "c", "x", "y", "value", "weight"]
    got = {(r["a"], r["b"], r["c"], r["x"], r["y"]): complex(*r["value"]) for r in out.collect()}
    assert set(got) == {(1.0, 0.5, 7, x, y) for x in range(4) for y in range(4)}, "shared values meet, others go along"
    for (v, w, _, x, y), z in got.items():
        inner = 1 <= x <= 2 and 1 <= y <= 2
        assert z == complex(v + x, y) * (complex(w + x - 1, y - 1) * complex(1 + x - 1, y - 1) if inner else 1)
    assert math.isclose(sum(abs(z) for z in got.values()), sum(abs(complex(*r["value"])) for r in out.collect()))
