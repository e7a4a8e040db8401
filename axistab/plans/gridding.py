"""Visibilities onto a grid and back, by oversampled kernels.

A visibility at (u, v), in cells, adds to the cells around its nearest one, ``support`` to either side. Which taps of the kernel
it uses follows from how far off the cell it lies, in steps of 1 / ``oversampling``. Rows are dealt by the tile of their cell;
within a task whole tiles are filled at once, and only their cells come out, to be summed over tiles that overlap. A tile
with many rows is cut into parts, which are summed alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.operators.blocks import floor_div, halos_over_axes
from axistab.operators.joins import fits, sized
from axistab.sources.scratch import stage

#: Cells of a tile along each axis, and rows of a tile's part.
TILE, PART = 64, 1 << 16
#: Bytes of all kernels together, which every task gets.
KERNEL_BYTES = 64 << 20


@dataclass(frozen=True)
class Kernels:
    """Taps by kernel number, offsets and places: an array (kernel, off u, off v, i, j)."""

    taps: np.ndarray
    oversampling: int
    support: int


def kernels_of(df: DataFrame, oversampling: int, support: int) -> Kernels:
    """From ``kernel, off_u, off_v, i, j, re, im``: offsets from -oversampling / 2 to oversampling / 2, places from -support to
    support; taps that are absent are 0. Refused beyond ``KERNEL_BYTES``."""
    if oversampling < 1 or support < 0 or oversampling % 2 and oversampling > 1:
        raise ValueError("oversampling must be 1 or even, support 0 or more")
    offs, wide = oversampling // 2 * 2 + 1, 2 * support + 1
    number = (df.agg(F.max("kernel").alias("n")).first()["n"] or 0) + 1
    if number * offs * offs * wide * wide * 16 > KERNEL_BYTES or not fits(df, KERNEL_BYTES // 16, 8 * KERNEL_BYTES):
        raise ValueError(f"kernels take more than {KERNEL_BYTES} bytes")
    taps = np.zeros((number, offs, offs, wide, wide), complex)
    half = oversampling // 2
    for r in df.select("kernel", "off_u", "off_v", "i", "j", "re", "im").toLocalIterator():
        taps[r["kernel"], r["off_u"] + half, r["off_v"] + half, r["i"] + support, r["j"] + support] = complex(r["re"], r["im"])
    return Kernels(taps, oversampling, support)


def taps_of_planes(planes: DataFrame, n: int, oversampling: int, support: int, kernel: str = "kernel") -> DataFrame:
    """``kernel, off_u, off_v, i, j, re, im`` from convolution functions ``kernel, x, y, re, im`` on n x n fine cells, ``oversampling`` of
    which make a cell of the grid, centred at n // 2."""
    offs = F.sequence(F.lit(-(oversampling // 2)), F.lit(oversampling // 2))
    out = planes.withColumn("off_u", F.explode(offs)).withColumn("off_v", F.explode(offs))
    for place, off, axis in (("i", "off_u", "x"), ("j", "off_v", "y")):
        fine = F.col(axis) - n // 2 + F.col(off)
        out = out.filter(F.pmod(fine, F.lit(oversampling)) == 0).withColumn(place, floor_div(fine, oversampling).cast("int"))
    near = F.col("i").between(-support, support) & F.col("j").between(-support, support)
    return out.filter(near).select(F.col(kernel).cast("int").alias("kernel"), "off_u", "off_v", "i", "j", "re", "im")


def nearest_cell(at: Column) -> Column:
    return F.floor(at + 0.5).cast("long")


def offset_step(at: Column, oversampling: int) -> Column:
    """How far a coordinate lies off its nearest cell, in steps of 1 / ``oversampling``."""
    return F.floor((at - nearest_cell(at)) * oversampling + 0.5).cast("int") if oversampling > 1 else F.lit(0)


def _located(vis: DataFrame, kernels: Kernels, tile: int, kernel: str | None) -> DataFrame:
    """Adds ``__u, __v`` (nearest cell), ``__fu, __fv`` (offsets), ``__k`` and the tile ``__tu, __tv``; rows without a place are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40)
    out = vis.filter(finite("u") & finite("v"))
    number = F.col(kernel).cast("int") if kernel else F.lit(0)
    out = out.withColumns(
        {
            "__u": nearest_cell(F.col("u")), "__v": nearest_cell(F.col("v")), "__fu": offset_step(F.col("u"), kernels.oversampling),
            "__fv": offset_step(F.col("v"), kernels.oversampling), "__k": number,
        }
    ).filter(F.col("__k").between(0, len(kernels.taps) - 1))
    return out.withColumns({"__tu": floor_div(F.col("__u"), tile), "__tv": floor_div(F.col("__v"), tile)})


def _parts(rows: DataFrame, by: list[str], part: int) -> DataFrame:
    """``by, __parts``: into how many parts the rows of a tile are cut, for tiles with more than one."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return stage(counts.filter(F.col("__n") > part).select(*by, F.ceil(F.col("__n") / part).cast("long").alias("__parts")), "parts")


def _cut(rows: DataFrame, parts: DataFrame, by: list[str], spread: list[str]) -> DataFrame:
    """Adds ``__part`` by a hash of what tells the rows of a tile apart; rows are streamed, so that equal ones in one part cost time
    alone."""
    named = parts.select(*(F.col(c).alias(f"__p_{c}") for c in by), "__parts")
    same = [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in by]
    on = same[0]
    for s in same[1:]:
        on = on & s
    met = rows.join(sized(named), on, "left").drop(*(f"__p_{c}" for c in by))
    salt = F.pmod(F.xxhash64(*spread), F.coalesce("__parts", F.lit(1).cast("long")))
    return met.withColumn("__part", salt).drop("__parts")


def _runs(batch: pa.RecordBatch, by: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Whether each row begins a run of equal ``by``, given the values before the batch; and the last row's values."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    value = lambda i: tuple(batch.column(c)[i].as_py() for c in by)
    new[0] = last is None or value(0) != last
    return new, value(batch.num_rows - 1)


def grid(
    vis: DataFrame, keys: list[str], kernels: Kernels, size: tuple[int, int], kernel: str | None = None, tile: int = TILE, part: int = PART,
) -> DataFrame:
    """``keys, x, y, re, im, weight, hits``: for each cell that a visibility reaches the sum of weight x value x tap, of weight x
    size of the tap, and the number of taps.

    ``vis`` has ``keys`` (planes, such as channel and polarisation), ``u, v`` in cells, ``value`` (``struct<re, im>``), ``weight`` and,
    if named, the number of its ``kernel``. Rows with a null or NaN among these take no part, nor do taps outside the grid of
    ``size`` cells from 0 on. Null keys are a plane. Repeated rows add up; an empty table gives no rows.
    """
    s, by = kernels.support, [*keys, "__tu", "__tv"]
    rows = _located(vis, kernels, tile, kernel)
    known = F.col("value.re").isNotNull() & F.col("value.im").isNotNull() & F.col("weight").isNotNull()
    rows = rows.filter(known & ~F.isnan("value.re") & ~F.isnan("value.im") & ~F.isnan("weight")).filter(
        F.col("__u").between(-s, size[0] - 1 + s) & F.col("__v").between(-s, size[1] - 1 + s)
    )
    rows = _cut(rows, _parts(rows, by, part), by, vis.columns)
    by = [*by, "__part"]
    rows = rows.select(
        *by, "__u", "__v", "__fu", "__fv", "__k", (F.col("value.re") * F.col("weight")).alias("__re"), (F.col("value.im") * F.col("weight")).alias("__im"),
        F.col("weight").cast("double").alias("__w"),
    )
    dealt = rows.repartition(*by).sortWithinPartitions(*by)
    kinds = {f.name: f.dataType for f in dealt.schema}
    double, long = T.DoubleType(), T.LongType()
    schema = T.StructType(
        [*(T.StructField(c, kinds[c]) for c in keys), *(T.StructField(c, long) for c in ("x", "y")), *(T.StructField(c, double) for c in ("re", "im", "weight")),
         T.StructField("hits", long)]
    )
    wide, half, taps = tile + 2 * s, kernels.oversampling // 2, vis.sparkSession.sparkContext.broadcast(kernels.taps)
    places = (np.arange(2 * s + 1)[:, None] * wide + np.arange(2 * s + 1)).ravel()
    rows_once = max(1, (1 << 20) // len(places))

    def cells_of(held: list[tuple[tuple, np.ndarray]]) -> pa.RecordBatch:
        """The cells of finished tiles that were reached, inside the grid."""
        which, sums = [k for k, _ in held], np.stack([d for _, d in held])
        t, x, y = np.nonzero(sums[:, 3])
        gx = x - s + tile * np.array([k[-3] for k in which], np.int64)[t]
        gy = y - s + tile * np.array([k[-2] for k in which], np.int64)[t]
        inside = (gx >= 0) & (gx < size[0]) & (gy >= 0) & (gy < size[1])
        t, x, y, gx, gy = (a[inside] for a in (t, x, y, gx, gy))
        source = pa.array(t)
        kept = [pa.array([k[i] for k in which], arrow[c]).take(source) for i, c in enumerate(keys)]
        values = [pa.array(sums[t, plane, x, y]) for plane in range(3)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(gx), pa.array(gy), *values, pa.array(sums[t, 3, x, y].astype(np.int64))], names=schema.names)

    arrow: dict[str, pa.DataType] = {}

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = dense = None
        most = max(1, (1 << 20) // (wide * wide))
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow.update({c: batch.schema.field(c).type for c in keys})
            new, end = _runs(batch, by, last)
            col = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            # Tiles of a batch are filled a number at a time; the one that the batch before has left open goes on.
            cuts = [0, *(int(x) for x in starts if x), batch.num_rows]
            for first in range(0, len(cuts) - 1, most):
                lo, hi = cuts[first], cuts[min(first + most, len(cuts) - 1)]
                edges = np.array(cuts[first : first + most + 1])
                tiles = len(edges) - 1
                which, sums = np.repeat(np.arange(tiles), np.diff(edges)), np.zeros((tiles, 4, wide * wide))
                for a in range(lo, hi, rows_once):
                    b = min(hi, a + rows_once)
                    part_of = lambda c, a=a, b=b: col(c)[a:b]  # noqa: E731, B023
                    x, y = part_of("__u") - tile * part_of("__tu"), part_of("__v") - tile * part_of("__tv")
                    own = taps.value[part_of("__k"), part_of("__fu") + half, part_of("__fv") + half].reshape(b - a, -1)
                    at = ((which[a - lo : b - lo] * wide + x) * wide + y)[:, None] + places[None]
                    product = (part_of("__re") + 1j * part_of("__im"))[:, None] * own
                    weights = part_of("__w")[:, None] * np.abs(own)
                    for plane, w in enumerate((product.real, product.imag, weights, None)):
                        added = np.bincount(at.ravel(), None if w is None else w.ravel(), tiles * wide * wide)
                        sums[:, plane] += added.reshape(tiles, -1)
                sums = sums.reshape(tiles, 4, wide, wide)
                named = [(tuple(batch.column(c)[int(e)].as_py() for c in by), sums[k]) for k, e in enumerate(edges[:-1])]
                if dense is not None and named[0][0] == dense[0]:
                    named[0][1][...] += dense[1]
                    dense = None
                done = [*([dense] if dense is not None else []), *named[:-1]]
                dense = named[-1]
                if done:
                    yield cells_of(done)
            last = end
        if dense is not None:
            yield cells_of([dense])

    filled = dealt.mapInArrow(scatter, schema)
    return filled.groupBy(*keys, "x", "y").agg(*(F.sum(c).alias(c) for c in ("re", "im", "weight", "hits")))


def degrid(
    cells: DataFrame, vis: DataFrame, keys: list[str], kernels: Kernels, kernel: str | None = None, tile: int = TILE, part: int = PART,
) -> DataFrame:
    """``vis`` with ``value``: the sum over the taps of cell x tap, from the planes ``keys, x, y, re, im`` of ``cells``.

    Tiles with a border of ``support`` cells meet the rows that lie in them; each row looks its window up in one tile, whatever
    the number of taps. Cells that are absent are 0, repeated ones add up. Rows without a place or with an unknown kernel get a
    null value, rows on a plane without cells 0. All columns of ``vis`` but ``value`` stay; null keys are a plane.
    """
    s, spark = kernels.support, vis.sparkSession
    rest = [c for c in vis.columns if c != "value"]
    rows = vis.select(*rest)
    placed = _located(rows, kernels, tile, kernel)
    by = [*keys, "__tu", "__tv"]
    parts = _parts(placed, by, part)
    placed = _cut(placed, parts, by, rest)
    whole = cells.groupBy(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    # A cell goes to every tile in whose border it lies; coordinates are moved so that all are 0 or more.
    low = whole.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("top_x"), F.max("y").alias("top_y")).first()
    shift = {c: max(0, -(-(s - (low[c] or 0)) // tile) * tile) for c in ("x", "y")}
    moved = whole.withColumns({c: F.col(c) + n for c, n in shift.items()})
    extents = {c: (low[f"top_{c}"] or 0) + shift[c] + s + tile + 1 for c in ("x", "y")}
    bordered = halos_over_axes(moved, {"x": tile, "y": tile}, {"x": s, "y": s}, extents)
    local = bordered.select(
        *keys, (F.col("x_block") - shift["x"] // tile).alias("__tu"), (F.col("y_block") - shift["y"] // tile).alias("__tv"),
        F.struct((F.col("x") - F.col("x_block") * tile + s).cast("int").alias("x"), (F.col("y") - F.col("y_block") * tile + s).cast("int").alias("y"), "re", "im").alias("c"),
    )
    tiles = local.groupBy(*by).agg(F.collect_list("c").alias("__cells"))
    named = parts.select(*(F.col(c).alias(f"__p_{c}") for c in by), "__parts")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1).cast("long")) - 1))
    tiles = tiles.join(sized(named), on, "left").select(*by, copies.alias("__part"), "__cells")
    by = [*by, "__part"]
    # Tiles and rows travel together, a tile before the rows of each of its parts.
    row = F.struct(*rest)
    both = tiles.withColumn("__order", F.lit(0)).unionByName(
        placed.select(*by, "__u", "__v", "__fu", "__fv", "__k", row.alias("__row")).withColumn("__order", F.lit(1)), allowMissingColumns=True,
    )
    dealt = both.repartition(*by).sortWithinPartitions(*by, "__order")
    wide, half, taps = tile + 2 * s, kernels.oversampling // 2, spark.sparkContext.broadcast(kernels.taps)
    schema = T.StructType([T.StructField("__row", placed.select(row.alias("r")).schema["r"].dataType), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    window = np.arange(2 * s + 1)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dense = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, end = _runs(batch, by, now)
            col = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
            order, edges = col("__order"), [*sorted({0, *np.flatnonzero(new).tolist()}), batch.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if new[lo]:
                    dense = None
                if order[lo] == 0:
                    cell = batch.column("__cells")[lo].values
                    dense = np.zeros((wide, wide), complex)
                    at = [cell.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                    dense[at[0], at[1]] = at[2] + 1j * at[3]
                    lo += 1
                if lo == hi:
                    continue
                out = np.zeros(hi - lo, complex)
                if dense is not None:
                    x, y = (col(c)[lo:hi].astype(np.int64) - tile * col(t)[lo:hi] for c, t in (("__u", "__tu"), ("__v", "__tv")))
                    own = taps.value[tuple(col(c)[lo:hi].astype(np.int64) + add for c, add in (("__k", 0), ("__fu", half), ("__fv", half)))]
                    for at in range(0, hi - lo, 4096):
                        some = slice(at, at + 4096)
                        seen = dense[(x[some, None] + window)[:, :, None], (y[some, None] + window)[:, None, :]]
                        out[some] = (seen * own[some]).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([batch.column("__row").slice(lo, hi - lo), pa.array(out.real), pa.array(out.imag)], names=schema.names)
            now = end

    found = dealt.mapInArrow(gather, schema).select(*(F.col("__row")[c].alias(c) for c in rest), F.struct("re", "im").alias("value"))
    number = F.col(kernel).cast("int") if kernel else F.lit(0)
    place = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**40)
    fine = F.coalesce(place("u") & place("v") & number.between(0, len(kernels.taps) - 1), F.lit(False))
    lost = rows.filter(~fine).withColumn("value", F.lit(None).cast("struct<re: double, im: double>"))
    return found.unionByName(lost)
