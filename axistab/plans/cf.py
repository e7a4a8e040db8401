"""Convolution-function tables: parameter grids times pixels, multiplied on shared axes and Fourier-transformed."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.functions.cplx import cmul, conj, cplx
from axistab.operators.asof import nearest
from axistab.operators.blocks import floor_div
from axistab.operators.joins import join_same, sized
from axistab.plans.fft import fft, rotation
from axistab.sources.scratch import stage


def cf_axes(axes: list[DataFrame], n: int) -> DataFrame:
    """Every combination of axis values with the n x n pixels ``x, y``; pixels are exploded from each row."""
    grid = reduce(lambda a, b: a.crossJoin(b), axes)
    pixels = F.sequence(F.lit(0), F.lit(n - 1))
    return grid.withColumn("x", F.explode(pixels)).withColumn("y", F.explode(pixels))


def grid_coordinates(df: DataFrame, n: int, radius: float, angle: Column | None = None) -> DataFrame:
    """World coordinates ``cx, cy`` of pixel centres, (i + 0.5 - n/2) 2 radius / n, turned back by ``angle``."""
    step = 2.0 * radius / n
    x, y = ((F.col(c) + F.lit(0.5 - n / 2)) * F.lit(step) for c in ("x", "y"))
    if angle is None:
        return df.withColumns({"cx": x, "cy": y})
    return df.withColumns({"cx": x * F.cos(angle) + y * F.sin(angle), "cy": y * F.cos(angle) - x * F.sin(angle)})


#: Rational approximation of the spheroidal function below 0.75 and below 1: numerator and denominator. Fixed values.
SPHEROIDAL = (
    (0.75, (8.203343e-2, -3.644705e-1, 6.278660e-1, -5.335581e-1, 2.312756e-1), (1.0000000e0, 8.212018e-1, 2.078043e-1)),
    (1.0, (4.028559e-3, -3.697768e-2, 1.021332e-1, -1.201436e-1, 6.412774e-2), (1.0000000e0, 9.599102e-1, 2.918724e-1)),
)


def _horner(coefficients: tuple[float, ...], at: Column) -> Column:
    return reduce(lambda acc, c: acc * at + F.lit(c), reversed(coefficients[:-1]), F.lit(coefficients[-1]))


def spheroidal(nu: Column) -> Column:
    """1 at 0 and below, 0 from 1 on."""
    (low, p1, q1), (high, p2, q2) = SPHEROIDAL
    piece = lambda top, p, q: _horner(p, nu * nu - F.lit(top * top)) / _horner(q, nu * nu - F.lit(top * top))
    return F.when(nu <= 0, F.lit(1.0)).when(nu < low, piece(low, p1, q1)).when(nu < high, piece(high, p2, q2)).otherwise(F.lit(0.0))


def ps_term(df: DataFrame, scale: str = "ps_scale") -> DataFrame:
    """Prolate spheroidal taper: ``value`` and ``weight``; outside the disk 0 and null."""
    rho, v = F.col("__rho"), F.col("__v")  # columns of their own, or each use would be computed anew
    out = df.withColumn("__rho", F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")) * F.col(scale))
    out = out.withColumn("__v", F.when(rho <= 1, spheroidal(rho) * (1 - rho * rho)))
    return out.withColumns({"value": cplx(F.when(rho <= 1, v).otherwise(0.0), F.lit(0.0)), "weight": v * v}).drop("__rho", "__v")


def w_term(df: DataFrame, w: str = "w") -> DataFrame:
    """exp(2 pi i w (sqrt(1 - r^2) - 1)) inside the unit disk; outside 0 and null."""
    r2 = F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy")
    phase = F.lit(2 * math.pi) * F.col(w) * (F.sqrt(1 - r2) - 1)
    inside = r2 <= 1
    return df.withColumns(
        {"value": cplx(F.when(inside, F.cos(phase)).otherwise(0.0), F.when(inside, F.sin(phase)).otherwise(0.0)), "weight": F.when(inside, 1.0)}
    )


def cf_product(left: DataFrame, left_n: int, right: DataFrame, right_n: int, shared: list[str], right_only: list[str] | None = None) -> DataFrame:
    """``left`` times ``right`` on shared axes, the smaller right grid centred in the left one.

    Axes that the right side lacks are broadcast along; of the axes that only it has (``right_only``) the first coordinate
    counts. Cells outside the smaller grid keep the left value. Grids need equal parity, the left one the larger size. The
    right side is measured before it is broadcast: Spark's estimate leaves out that pixels were exploded.
    """
    if right_n > left_n or (left_n - right_n) % 2:
        raise ValueError("the first grid must be the largest, and sizes of equal parity")
    for axis in right_only or []:
        right = right.join(F.broadcast(right.agg(F.min(axis).alias("__first"))), F.col(axis) == F.col("__first")).drop("__first")
    shift = (left_n - right_n) // 2
    other = right.select(
        *shared, (F.col("x") + shift).alias("x"), (F.col("y") + shift).alias("y"), F.col("value").alias("__v"), F.col("weight").alias("__w"),
    )
    met = left.join(sized(other), [*shared, "x", "y"], "left")
    value = F.when(F.col("__v").isNull(), F.col("value")).otherwise(cmul(F.col("value"), F.col("__v")))
    weight = F.when(F.col("__v").isNull(), F.col("weight")).otherwise(F.col("weight") * F.col("__w"))
    return met.withColumns({"value": value, "weight": weight}).drop("__v", "__w")


def cf_products(tables: list[tuple[DataFrame, int, list[str]]]) -> DataFrame:
    """Product of several tables ``(df, grid size, axes)``; the first has the largest grid and gives the result its axes."""
    (out, n, have), *others = tables
    for df, size, axes in others:
        out = cf_product(out, n, df, size, [a for a in axes if a in have], [a for a in axes if a not in have])
    return out


def cf_product_all(tables: list[tuple[DataFrame, int, list[str]]]) -> DataFrame:
    """Product of several tables ``(df, grid size, axes)`` over all of their axes: a plane for each combination of axis values.

    A table is broadcast along the axes that only others have; on axes that tables share their values meet. The first grid is
    the largest, smaller ones are centred in it. Of each table only the distinct axis values go to every plane before it, so
    the rows of the result are all that is made.
    """
    (out, n, have), *others = tables
    have = list(have)
    for df, size, axes in others:
        if new := [a for a in axes if a not in have]:
            shared = [a for a in axes if a in have]
            values = sized(df.select(*axes).distinct())
            out = out.join(values, shared) if shared else out.crossJoin(values)
            have += new
        out = cf_product(out, n, df, size, axes)
    return out.select(*have, "x", "y", "value", "weight")


def cf_fft(df: DataFrame, axes: list[str], n: int, sign: int = 1, rotate_in: bool = True, rotate_out: bool = True) -> DataFrame:
    """Unnormalised 2-D transform of each n x n plane (absent cells are 0); ``fft`` has it for any rank and size."""
    return fft(df, axes, {"x": n, "y": n}, sign, rotate_in, rotate_out)


def cf_fft_sums(df: DataFrame, axes: list[str], n: int, sign: int = 1) -> DataFrame:
    """The same transform, rotated in and out, as sums of sines and cosines; n^4 rows a plane, for checks."""
    step, at = rotation(n), F.sequence(F.lit(0), F.lit(n - 1))
    turned = lambda c: F.pmod(F.col(c) - F.lit(step), F.lit(n))
    each = df.withColumns({"jx": turned("x"), "jy": turned("y")}).withColumn("kx", F.explode(at)).withColumn("ky", F.explode(at))
    phase = F.lit(sign * 2 * math.pi / n) * (F.col("jx") * F.col("kx") + F.col("jy") * F.col("ky"))
    term = cmul(F.col("value"), cplx(F.cos(phase), F.sin(phase)))
    sums = each.select(*axes, turned("kx").alias("x"), turned("ky").alias("y"), term.alias("t")).groupBy(*axes, "x", "y")
    return sums.agg(F.sum("t.re").alias("re"), F.sum("t.im").alias("im"))


def zernike_index(m: Column, n: Column) -> Column:
    return F.floor((n * (n + 2) + m) / 2).cast("int")


def zernike_orders(k: Column) -> Column:
    """``m, n`` of a term's number."""
    n = F.ceil((F.sqrt(8.0 * k + 9) - 3) / 2).cast("int")
    return F.struct((2 * k - n * (n + 2)).cast("int").alias("m"), n.alias("n"))


#: Terms that are numbered otherwise than by the rule of ``zernike_terms``: (m, n) and whose polynomial it has. Fixed values.
RELABELLED = {(-1, 1): (1, 1), (1, 1): (-1, 1), (-2, 2): (0, 2), (0, 2): (-2, 2)}
#: Terms (m, n, power of x, power of y) that are tabulated with the opposite sign. Fixed values.
OPPOSITE_SIGN = {(-2, 6, 3, 1), (-2, 6, 1, 5), (-2, 8, 7, 1)}


def _turned(m: int) -> dict[tuple[int, int], int]:
    """rho^|m| cos(m t), or sin(|m| t) for negative m, with x = rho sin(t) and y = rho cos(t): {(px, py): coefficient}."""
    k, odd = abs(m), m < 0
    return {(j, k - j): (-1) ** (j // 2) * math.comb(k, j) for j in range(int(odd), k + 1, 2)}


def zernike_terms(orders: int = 10, tabulated: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Polynomial terms (m, n, power of x, power of y, coefficient) of all circle polynomials up to order ``orders``.

    Radial polynomial times the turned one. ``tabulated`` keeps three signs of orders 6 and 8 as existing coefficient
    sets expect them; without it all terms are those of the rule.
    """
    out = []
    for n in range(orders + 1):
        for label in range(-n, n + 1, 2):
            m, _ = RELABELLED.get((label, n), (label, n))
            sums: dict[tuple[int, int], int] = {}
            for k in range((n - abs(m)) // 2 + 1):
                up, down = (n + abs(m)) // 2 - k, (n - abs(m)) // 2 - k
                radial = (-1) ** k * math.factorial(n - k) // (math.factorial(k) * math.factorial(up) * math.factorial(down))
                for j in range(down + 1):
                    for (px, py), c in _turned(m).items():
                        at = (px + 2 * j, py + 2 * (down - j))
                        sums[at] = sums.get(at, 0) + radial * math.comb(down, j) * c
            sign = lambda px, py: -1 if tabulated and (label, n, px, py) in OPPOSITE_SIGN else 1  # noqa: B023, E731
            out += [(label, n, px, py, sign(px, py) * c) for (px, py), c in sorted(sums.items()) if c]
    return out


def zernike_to_poly(coefficients: DataFrame, keys: list[str], terms: list[tuple[int, int, int, int, int]] | None = None) -> DataFrame:
    """Series coefficients ``keys, k, re, im`` to polynomial ones: sums over ``terms`` (``zernike_terms()``) for each (px, py)."""
    spark, terms = coefficients.sparkSession, zernike_terms() if terms is None else terms
    table = spark.createDataFrame([((n * (n + 2) + m) // 2, px, py, c) for m, n, px, py, c in terms], "k int, px int, py int, c int")
    met = coefficients.join(F.broadcast(table), "k")
    return met.groupBy(*keys, "px", "py").agg(F.sum(F.col("re") * F.col("c")).alias("re"), F.sum(F.col("im") * F.col("c")).alias("im"))


def nearest_frequency_coeffs(wanted: DataFrame, available: DataFrame, keys: list[str], orders: int) -> DataFrame:
    """For each ``keys, frequency`` wanted the coefficients ``k, re, im`` of the nearest frequency available.

    Ties go to the lower frequency; missing orders, and keys without any frequency, have zero coefficients. Null keys are a
    key; rows with a null frequency are left out. A key with any number of frequencies is spread over range partitions.
    """
    near = nearest(wanted, available, keys, "frequency", "__f").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    have = available.filter("frequency is not null").select(*keys, F.col("frequency").alias("__f"), "k", "re", "im")
    met = join_same(near, have, [*keys, "__f", "k"], "left")
    return met.select(*keys, "frequency", "k", F.coalesce("re", F.lit(0.0)).alias("re"), F.coalesce("im", F.lit(0.0)).alias("im"))


#: Pixels of a tile along each axis.
PIXELS = 64


def _in_disk(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sum of c x^px y^py at each place, 0 outside the unit disk."""
    table = np.zeros((px.max(initial=0) + 1, py.max(initial=0) + 1), complex)
    np.add.at(table, (px, py), c)
    value = ((np.vander(x, table.shape[0], increasing=True) @ table) * np.vander(y, table.shape[1], increasing=True)).sum(axis=1)
    return np.where(x * x + y * y <= 1, value, 0)


def aperture(pixels: DataFrame, poly: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of polynomial terms at the pixels' ``cx, cy``, 0 outside the unit disk: adds ``value``.

    Pixels are packed into tiles, once, and a tile meets the coefficients ``px, py, re, im`` of its ``keys`` as one row: powers of
    x times coefficients times powers of y. Nothing grows with pixels times terms. Null keys are a key; pixels of keys without
    coefficients do not come out.
    """
    cell = ["x", "y", "cx", "cy"]
    axes = [c for c in pixels.columns if c not in (*cell, "value", "weight")]
    places = [floor_div(F.col(c), PIXELS).alias(f"__{c}") for c in ("x", "y")]
    tiles = pixels.groupBy(*axes, *places).agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) if c[0] == "c" else F.col(c) for c in cell))).alias("__c"))
    terms = F.struct(F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))
    packed = stage(poly.groupBy(*keys).agg(F.collect_list(terms).alias("__t")), "polynomials")
    met = join_same(tiles, packed, keys, "inner").select(*axes, "__c", "__t")
    kinds = {f.name: f.dataType for f in met.schema}
    cells = kinds["__c"].elementType
    schema = T.StructType([*(T.StructField(a, kinds[a]) for a in axes), *cells.fields, T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some, term = batch.column("__c")[i].values, batch.column("__t")[i].values
                x, y = (some.field(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy"))
                px, py, re, im = (term.field(c).to_numpy(zero_copy_only=False) for c in ("px", "py", "re", "im"))
                value = _in_disk(x, y, px, py, re + 1j * im)
                same = pa.array(np.full(len(x), i))
                cols = [*(batch.column(a).take(same) for a in axes), *(some.field(c) for c in cell), pa.array(value.real), pa.array(value.imag)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    by = [c for c in pixels.columns if c not in ("value", "weight")]
    return met.mapInArrow(evaluate, schema).select(*by, cplx(F.col("re"), F.col("im")).alias("value"))


def beam(apertures: DataFrame, axes: list[str], n: int) -> DataFrame:
    """``axes, x, y, re, im``: the transform of ``aperture`` that ``a_term`` multiplies, sign -1, rotated after only."""
    return cf_fft(apertures, axes, n, sign=-1, rotate_in=False, rotate_out=True)


def a_term(illumination: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """J[out] conj(J[in]) for the Stokes pairs ``stokes_out, stokes_in``, from ``keys, stokes, x, y, value``; J is the ``beam``."""
    out = illumination.select(*keys, "x", "y", F.col("stokes").alias("stokes_out"), F.col("value").alias("__o"))
    into = illumination.select(*keys, "x", "y", F.col("stokes").alias("stokes_in"), F.col("value").alias("__i"))
    met = out.join(sized(pairs), "stokes_out").join(into, [*keys, "stokes_in", "x", "y"])
    return met.select(*keys, "stokes_out", "stokes_in", "x", "y", cmul(F.col("__o"), conj(F.col("__i"))).alias("value"))


def beam_of_terms(orders: int, n: int, radius: float = 1.0) -> np.ndarray:
    """The ``beam`` of each series term alone on the n x n pixels of ``grid_coordinates``: terms by cells, x before y."""
    terms = np.array(zernike_terms())
    at = (np.arange(n) + (0.5 - n / 2)) * (2.0 * radius / n)
    x, y = (c.ravel() for c in np.meshgrid(at, at, indexing="ij"))
    number = (terms[:, 1] * (terms[:, 1] + 2) + terms[:, 0]) // 2
    planes = np.stack([_in_disk(x, y, *terms[number == k, 2:].T) for k in range(orders)]).reshape(orders, n, n)
    return np.roll(np.fft.fft2(planes), (-rotation(n), -rotation(n)), (1, 2)).reshape(orders, n * n)


def beams(series: DataFrame, orders: int, n: int, radius: float = 1.0, factor: float = 1.0) -> DataFrame:
    """The same as ``aperture`` and ``beam`` for planes that fit a tile, without a row for a pixel or a coefficient.

    ``re, im`` of each row are arrays of ``orders`` series coefficients and become those of the n x n cells, x before y,
    times ``factor``. A beam is linear in its coefficients, so that rows are multiplied with the beams of the terms. Null
    coefficients are 0.
    """
    if n > PIXELS:
        raise ValueError("larger planes go through aperture and beam")
    rest = [c for c in series.columns if c not in ("re", "im")]
    schema = T.StructType([*(series.schema[c] for c in rest), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im"))])
    padded = lambda c: F.transform(F.sequence(F.lit(1), F.lit(orders)), lambda k: F.coalesce(F.try_element_at(c, k), F.lit(0.0)))
    known = lambda c: F.when((F.size(c) == orders) & ~F.exists(c, lambda v: v.isNull()), F.col(c)).otherwise(padded(F.col(c))).alias(c)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_terms = beam_of_terms(orders, n, radius)
        step = max(1, (1 << 20) // max(orders, n * n))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                re, im = (part.column(c).flatten().to_numpy().reshape(-1, orders) for c in ("re", "im"))
                planes = ((re + 1j * im) @ of_terms) * factor
                ends = pa.array(np.arange(part.num_rows + 1) * (n * n), pa.int32())
                arrays = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (planes.real, planes.imag)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), *arrays], names=schema.names)

    return series.select(*rest, known("re"), known("im")).mapInArrow(multiplied, schema)


def a_term_of_planes(planes: DataFrame, keys: list[str], pairs: DataFrame, n: int) -> DataFrame:
    """The same as ``a_term`` from ``keys, stokes, re, im`` with the n x n cells of a plane as arrays, x before y (``beams``).

    The planes of a key meet in one shuffle and are read once; cells become rows only as products.
    """
    met = planes.dropna(subset=[*keys, "stokes"]).groupBy(*keys).agg(F.collect_list(F.struct("stokes", "re", "im")).alias("__p"))
    out = met.select(*keys, "__p", F.explode("__p").alias("__o")).withColumn("stokes_out", F.col("__o.stokes")).join(sized(pairs), "stokes_out")
    into = F.explode(F.filter("__p", lambda p: p["stokes"] == F.col("stokes_in"))).alias("__i")
    both = out.select(*keys, "stokes_out", "stokes_in", "__o", into)
    zipped = F.arrays_zip(*(F.col(f"{side}.{c}").alias(f"{side}{c}") for side in ("__o", "__i") for c in ("re", "im")))
    cells = both.select(*keys, "stokes_out", "stokes_in", F.posexplode(zipped).alias("__at", "__c"))
    value = lambda side: cplx(F.col(f"__c.{side}re"), F.col(f"__c.{side}im"))
    x, y = floor_div(F.col("__at"), n).cast("int").alias("x"), (F.col("__at") % n).alias("y")
    return cells.select(*keys, "stokes_out", "stokes_in", x, y, cmul(value("__o"), conj(value("__i"))).alias("value"))
