"""The A-term multiplies transformed apertures: against numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from axistab import catalog
from axistab.functions.cplx import cplx
from axistab.plans import cf
from tests.oracle import connect, difference


def test_a_term_multiplies_transformed_apertures(spark):
    n, rng = 5, np.random.default_rng(2)
    j = rng.normal(size=(2, n, n)) + 1j * rng.normal(size=(2, n, n))
    rows = [(s, x, y, float(j[s, x, y].real), float(j[s, x, y].imag)) for s in range(2) for x in range(n) for y in range(n)]
    cells = spark.createDataFrame(
        rows, "stokes long, x int, y int, re double, im double",
    ).withColumn("plane", F.lit(1)).withColumn("value", cplx(F.col("re"), F.col("im")))
    beams = cf.beam(cells, ["plane", "stokes"], n).withColumn("value", cplx(F.col("re"), F.col("im")))
    out = cf.a_term(beams, ["plane"], spark.createDataFrame([(0, 1)], "stokes_out long, stokes_in long")).collect()
    at = np.arange(n)
    wave = np.exp(-2j * np.pi / n * np.outer(at, at))
    of = [np.roll(wave @ j[s] @ wave, (-3, -3), (0, 1)) for s in range(2)]
    assert len(out) == n * n
    assert all(abs(complex(r["value"]["re"], r["value"]["im"]) - of[0][r["x"], r["y"]] * of[1][r["x"], r["y"]].conj()) < 1e-9 for r in out)


def test_beams_equal_transformed_apertures(spark):
    """Arrays of coefficients, some null or missing, against polynomials evaluated and transformed pixel by pixel."""
    rng = np.random.default_rng(4)
    rows = [(k, *(rng.normal(size=10).tolist() for _ in range(2))) for k in range(3)]
    rows[1] = (1, [None, *rows[1][1][1:]], rows[1][2][:4])
    series = spark.createDataFrame([*rows, (9, None, None)], "key long, re array<double>, im array<double>")
    each = [(k, i, *(float(c[i] or 0) if i < len(c) else 0.0 for c in (re, im))) for k, re, im in rows for i in range(10)]
    poly = cf.zernike_to_poly(spark.createDataFrame(each, "key long, k int, re double, im double"), ["key"])
    for n in (4, 5):
        pixels = cf.grid_coordinates(cf.cf_axes([spark.range(3).toDF("key")], n), n, 0.9)
        slow = {(r["key"], r["x"] * n + r["y"]): complex(r["re"], r["im"]) for r in cf.beam(cf.aperture(pixels, poly, ["key"]), ["key"], n).collect()}
        fast = {r["key"]: [complex(*z) for z in zip(r["re"], r["im"], strict=True)] for r in cf.beams(series, 10, n, 0.9, 2.0).collect()}
        assert len(slow) == 3 * n * n and set(fast) == {0, 1, 2, 9} and fast[9] == [0j] * (n * n)
        assert all(abs(fast[k][at] - 2 * z) < 1e-9 for (k, at), z in slow.items())


def test_products_of_planes_equal_those_of_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(k, s, rng.normal(size=6).tolist(), rng.normal(size=6).tolist()) for k in (1, 2, None) for s in (0, 1, 3) if (k, s) != (2, 3)]
    planes = spark.createDataFrame([(k, s, [*re, 0.0, 0.0, 0.0], [*im, 1.0, 1.0, 1.0]) for k, s, re, im in rows], "key long, stokes long, re array<double>, im array<double>")
    pairs = spark.createDataFrame([(0, 0), (0, 3), (3, 1), (7, 0)], "stokes_out long, stokes_in long")
    cells = planes.select("key", "stokes", F.posexplode(F.arrays_zip("re", "im")).alias("at", "value")).withColumns(
        {"x": F.floor(F.col("at") / 3).cast("int"), "y": F.col("at") % 3}
    )
    one, two = (df.select("key", "stokes_out", "stokes_in", "x", "y", "value.re", "value.im") for df in (cf.a_term_of_planes(planes, ["key"], pairs, 3), cf.a_term(cells, ["key"], pairs)))
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 36, "key 1 has three pairs, key 2 one; a null key has none"
    assert [f.dataType for f in one.schema] == [f.dataType for f in two.schema]


def test_a_term_of_sizes_that_are_missing(spark, tmp_path):
    con = connect(str(tmp_path))
    con.execute(f"copy (select case when i % 9 = 4 then null else i end as p_partkey, case when i % 5 = 3 then null else 1 + i % 50 end::int as p_size from range(60) r(i)) to '{tmp_path}/part.parquet'")
    out = catalog.queries()["f5d_a_term_beams"](spark, str(tmp_path))
    assert difference(out, catalog.oracle_sql()["f5d_a_term_beams"], connect(str(tmp_path))) == ""


def test_pipeline_keeps_planes_that_are_keys(spark, tmp_path):
    """Keys with gaps: planes 0 to 9 are keys, those from 250,000 on are not."""
    con = connect(str(tmp_path))
    con.execute(f"""copy (select k as p_partkey, case when k % 7 = 5 then null else 1 + k % 50 end::int as p_size, case when k % 5 = 3 then null else 900 + k % 1000 / 10 end as p_retailprice
        from (select unnest([i, 1000000 + i]) as k from range(40) r(i)) union all select null, 3, 900.5) to '{tmp_path}/part.parquet'""")
    out = catalog.queries()["f7_pipeline_a"](spark, str(tmp_path))
    assert difference(out, catalog.oracle_sql()["f7_pipeline_a"], connect(str(tmp_path))) == ""
    assert out.agg(F.max("plane")).first()[0] == 9
