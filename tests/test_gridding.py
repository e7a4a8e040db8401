"""Gridding and de-gridding against plain sums over taps."""

import cmath
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from axistab.plans import cf, gridding
from axistab.plans.fft import fft

O, S = 4, 2
TAPS = {
    (k, a, b, i, j): complex(math.exp(-((i - a / O) ** 2 + (j - b / O) ** 2) / (1 + k)), 0.1 * (i - 2 * j) + 0.01 * a)
    for k in (0, 1) for a in range(-2, 3) for b in range(-2, 3) for i in range(-S, S + 1) for j in range(-S, S + 1)
}
VIS = "n int, chan int, u double, v double, value struct<re: double, im: double>, weight double, k int"


@pytest.fixture(scope="module")
def kernels(spark):
    rows = [(*key, z.real, z.imag) for key, z in TAPS.items()]
    return gridding.kernels_of(spark.createDataFrame(rows, "kernel int, off_u int, off_v int, i int, j int, re double, im double"), O, S)


def visibilities():
    """A third of the rows in one cell, and some at the edges, beyond them, repeated, without a value, place, weight or kernel."""
    rng = random.Random(9)
    rows = [(n, rng.choice([0, 1, None]), rng.uniform(-4, 24), rng.uniform(-4, 34), (rng.uniform(-1, 1), rng.uniform(-1, 1)), rng.random(), n % 2) for n in range(300)]
    rows += [(1000 + n, 1, 7.3, 11.8, (0.1 * n, 1.0), 0.5, 0) for n in range(150)]
    rows += [rows[3], rows[3], (2000, 0, None, 1.0, (1.0, 1.0), 1.0, 0), (2001, 0, float("nan"), 1.0, (1.0, 1.0), 1.0, 0), (2002, 0, 1.0, 1.0, None, 1.0, 0)]
    rows += [(2003, 0, 1.0, 1.0, (1.0, None), 1.0, 0), (2004, 0, 1.0, 1.0, (1.0, 1.0), None, 0), (2005, 0, 1.0, 1.0, (1.0, 1.0), 1.0, 7)]
    return [*rows, (2006, 0, 1.0, 1.0, (1.0, 1.0), 1.0, None), (2007, 0, 1e18, 1.0, (1.0, 1.0), 1.0, 0)]


def spots(row):
    _, chan, u, v, _, _, k = row
    if u is None or v is None or not math.isfinite(u) or abs(u) > 2**40 or k not in (0, 1):
        return None
    lu, lv = math.floor(u + 0.5), math.floor(v + 0.5)
    a, b = math.floor((u - lu) * O + 0.5), math.floor((v - lv) * O + 0.5)
    return [((chan, lu + i, lv + j), TAPS[k, a, b, i, j]) for i in range(-S, S + 1) for j in range(-S, S + 1)]


def near(a, b):
    return a.keys() == b.keys() and all(abs(x - y) < 1e-9 for k in a for x, y in zip(a[k], b[k], strict=True))


@pytest.mark.parametrize(("tile", "part"), [(8, 40), (5, 1), (64, 1 << 20)])
def test_grid_equals_sums_over_taps(spark, kernels, tile, part):
    rows, size = visibilities(), (20, 30)
    expected = defaultdict(lambda: [0.0, 0.0, 0])
    for r in rows:
        if r[4] is None or r[4][1] is None or r[5] is None:
            continue
        for cell, tap in spots(r) or []:
            if 0 <= cell[1] < size[0] and 0 <= cell[2] < size[1]:
                expected[cell][0] += r[5] * complex(*r[4]) * tap
                expected[cell][1] += r[5] * abs(tap)
                expected[cell][2] += 1
    df = spark.createDataFrame(rows, VIS).repartition(3)
    out = gridding.grid(df, ["chan"], kernels, size, "k", tile, part)
    assert out.columns == ["chan", "x", "y", "re", "im", "weight", "hits"]
    got = {(r["chan"], r["x"], r["y"]): [complex(r["re"], r["im"]), r["weight"], r["hits"]] for r in out.collect()}
    assert len(got) == out.count() and near(got, expected)
    assert gridding.grid(df.limit(0), ["chan"], kernels, size, "k").count() == 0


def test_a_hot_tile_is_cut(spark, kernels):
    rows = gridding._located(spark.createDataFrame(visibilities(), VIS), kernels, 8, "k")
    by = ["chan", "__tu", "__tv"]
    parts = gridding._parts(rows, by, 40)
    hot = parts.filter("chan = 1 and __tu = 0 and __tv = 1").first()
    assert hot["__parts"] >= 4
    counts = gridding._cut(rows, parts, by, ["n", "u", "v"]).groupBy(*by, "__part").count()
    assert counts.agg(F.max("count")).first()[0] < 80


@pytest.mark.parametrize(("tile", "part"), [(8, 40), (5, 1), (64, 1 << 20)])
def test_degrid_equals_sums_over_taps(spark, kernels, tile, part):
    rng = random.Random(2)
    cells = [(chan, x, y, rng.uniform(-1, 1), rng.uniform(-1, 1)) for chan in (0, None) for x in range(-3, 25) for y in range(28) if rng.random() < 0.7]
    cells += cells[:3]
    model = defaultdict(complex)
    for chan, x, y, re, im in cells:
        model[chan, x, y] += complex(re, im)
    rows = visibilities()
    out = gridding.degrid(
        spark.createDataFrame(cells, "chan int, x int, y int, re double, im double"), spark.createDataFrame(rows, VIS).repartition(2), ["chan"], kernels, "k", tile, part,
    )
    assert sorted(out.columns) == sorted(VIS.replace("struct<re: double, im: double>", "s").replace(",", " ").split()[::2])
    got = defaultdict(list)
    for r in out.collect():
        got[r["n"]].append(r["value"])
    assert {n: len(v) for n, v in got.items()} == {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}
    for r in rows:
        at = spots(r)
        for value in got[r[0]]:
            assert value is None if at is None else abs(complex(*value) - sum(model[c] * t for c, t in at if c in model)) < 1e-9
    assert gridding.degrid(spark.createDataFrame([], "chan int, x int, y int, re double, im double"), spark.createDataFrame(rows, VIS), ["chan"], kernels, "k").filter(
        "value.re = 0 and value.im = 0"
    ).count() == sum(spots(r) is not None for r in rows)


def test_a_point_source_is_restored(spark):
    """Visibilities of one source are gridded and imaged; the image, transformed back and de-gridded, gives them again between cells."""
    n, (x0, y0), flux = 32, (20, 13), 2.0
    seen = lambda u, v: flux * cmath.exp(-2j * math.pi * (u * (x0 - n // 2) + v * (y0 - n // 2)) / n)
    one = gridding.kernels_of(spark.createDataFrame([(0, 0, 0, 0, 0, 1.0, 0.0)], "kernel int, off_u int, off_v int, i int, j int, re double, im double"), 1, 0)
    full = [(float(u), float(v), (seen(u, v).real, seen(u, v).imag), 1.0) for u in range(n) for v in range(n)]
    vis = spark.createDataFrame(full, "u double, v double, value struct<re: double, im: double>, weight double")
    cplx = F.struct("re", "im")
    image = fft(gridding.grid(vis, [], one, (n, n), tile=8).withColumn("value", cplx), [], {"x": n, "y": n}, 1, False, False, normalised=True, tile=64)
    bright = image.filter("abs(re) + abs(im) > 1e-9").collect()
    assert [(r["x"], r["y"], round(r["re"], 9)) for r in bright] == [((x0 - n // 2) % n, (y0 - n // 2) % n, flux)]
    # The taper as a kernel of 7 x 7 taps, from planes of fine cells; what it does to the image is divided out first.
    fine = 2 * 3 * 8 + 1 + 8
    at = lambda c: F.abs(F.col(c) - fine // 2) / 24.0
    taper = lambda c: F.when(at(c) < 1, cf.spheroidal(at(c)) * (1 - at(c) * at(c))).otherwise(0.0)
    planes = spark.range(fine).select(F.col("id").cast("int").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(fine - 1))))
    planes = planes.select(F.lit(0).alias("kernel"), "x", "y", (taper("x") * taper("y")).alias("re"), F.lit(0.0).alias("im"))
    kernel = gridding.kernels_of(gridding.taps_of_planes(planes, fine, 8, 3), 8, 3)
    row = {i: kernel.taps[0, 4, 4, i + 3, 3].real for i in range(-3, 4)}
    response = lambda l: sum(c * math.cos(2 * math.pi * k * l / n) for k, c in row.items())  # noqa: E731, E741
    by = response(x0 - n // 2) * response(y0 - n // 2)
    model = image.select("x", "y", F.struct((F.col("re") / by).alias("re"), (F.col("im") / by).alias("im")).alias("value"))
    cells = fft(model, [], {"x": n, "y": n}, -1, False, False, tile=64)
    rng = random.Random(1)
    asked = spark.createDataFrame([(rng.uniform(4, 27), rng.uniform(4, 27)) for _ in range(100)], "u double, v double")
    out = gridding.degrid(cells, asked, [], kernel, tile=8).collect()
    assert len(out) == 100 and max(abs(complex(*r["value"]) - seen(round(r["u"] * 8) / 8, round(r["v"] * 8) / 8)) for r in out) < 0.02


def test_kernels_are_bounded(spark):
    df = spark.createDataFrame([(10**6, 0, 0, 0, 0, 1.0, 0.0)], "kernel int, off_u int, off_v int, i int, j int, re double, im double")
    with pytest.raises(ValueError, match="take more"):
        gridding.kernels_of(df, 4, 4)
    with pytest.raises(ValueError):
        gridding.kernels_of(df, 3, 1)
