"""Complex transforms of any rank by passes over the axes.

A pass gathers whole lines along one or more axes into tiles of a bounded number of cells, transforms them there and gives
their cells out again; the next pass gathers along the other axes. So no plane or cube has to fit a row or a task, and a
small one takes a single pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.operators.blocks import floor_div

#: Cells of a tile, and of the tiles that are transformed in one call.
TILE, CALL = 1 << 16, 1 << 20


def rotation(n: int) -> int:
    """The cyclic shift of a "rotated" axis; n // 2 + 1 for even sizes as well."""
    return (n // 2 + 1) % n


def passes_of(sizes: dict[str, int], tile: int = TILE) -> list[list[str]]:
    """Axes that are transformed together: as many as one tile has room for, at least one."""
    out: list[list[str]] = []
    for axis, n in sizes.items():
        if out and math.prod(sizes[a] for a in out[-1]) * n <= tile:
            out[-1].append(axis)
        else:
            out.append([axis])
    return out


def _pass(df: DataFrame, keys: list[str], sizes: dict[str, int], over: list[str], tile: int, sign: int, rotate_in: bool, rotate_out: bool) -> DataFrame:
    others, shape = [a for a in sizes if a not in over], [sizes[a] for a in over]
    # Lines are cut into runs along one of the other axes, the rest of which are keys.
    run, rest = (others[-1], others[:-1]) if others else (None, [])
    lines = min(sizes[run], max(1, tile // math.prod(shape))) if run else 1
    coords = [*([run] if run else []), *over]
    cut = df.withColumn("__run", floor_div(F.col(run), lines)) if run else df.withColumn("__run", F.lit(0).cast("long"))
    by = [*keys, *rest, "__run"]
    cell = F.struct(*(F.col(c).cast("int").alias(c) for c in coords), "re", "im")
    gathered = cut.groupBy(*by).agg(F.collect_list(cell).alias("__c")).select(*by, *(F.col("__c").getField(c).alias(c) for c in (*coords, "re", "im")))
    kinds = {f.name: f.dataType for f in gathered.schema}
    schema = T.StructType(
        [*(T.StructField(c, kinds[c]) for c in (*keys, *rest)), *(T.StructField(c, T.IntegerType()) for c in coords),
         T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())]
    )
    full, axes, shift = [lines, *shape], tuple(range(2, 2 + len(shape))), [-rotation(n) for n in shape]
    cells = math.prod(full)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CALL // cells)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                number = part.num_rows
                flat = {c: part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (*coords, "re", "im")}
                which = np.repeat(np.arange(number), pc.list_value_length(part.column("re")).to_numpy(zero_copy_only=False))
                line = flat[run] % lines if run else np.zeros(len(which), np.int64)
                grid, there = np.zeros((number, *full), complex), np.zeros((number, lines), bool)
                grid[(which, line, *(flat[a] for a in over))] = flat["re"] + 1j * flat["im"]
                there[which, line] = True
                grid = np.roll(grid, shift, axes) if rotate_in else grid
                grid = np.fft.ifftn(grid, axes=axes) * math.prod(shape) if sign > 0 else np.fft.fftn(grid, axes=axes)
                grid = np.roll(grid, shift, axes) if rotate_out else grid
                tile_of, line = np.nonzero(there)
                out, each = grid[tile_of, line].reshape(len(tile_of), -1), math.prod(shape)
                source = pa.array(np.repeat(tile_of, each))
                places = np.unravel_index(np.tile(np.arange(each), len(tile_of)), shape)
                cols = [part.column(c).take(source) for c in (*keys, *rest)]
                if run:
                    first = part.column("__run").to_numpy() * lines
                    cols.append(pa.array(np.repeat(first[tile_of] + line, each), pa.int32()))
                cols += [pa.array(p, pa.int32()) for p in places]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(out.real.ravel()), pa.array(out.imag.ravel())], names=schema.names)

    return gathered.mapInArrow(tiles, schema)


def fft(
    df: DataFrame, keys: list[str], sizes: dict[str, int], sign: int = 1, rotate_in: bool = True, rotate_out: bool = True, normalised: bool = False,
    tile: int = TILE,
) -> DataFrame:
    """``keys``, the axes of ``sizes`` and ``re, im``: the transform of ``value`` (``struct<re, im>``) over all axes, for each combination
    of ``keys``.

    ``sizes`` names the axes of an array and their lengths, from one on; cells that are absent or null are 0. An array with a
    cell has all cells in the result. ``rotate_in`` and ``rotate_out`` turn each axis by ``rotation`` before and after. Unless
    ``normalised`` the result is not divided by the number of cells. A line along one axis has to fit a task, an array
    has not. Coordinates outside ``sizes`` are refused when the job runs.
    """
    if not sizes:
        raise ValueError("a transform needs an axis")
    inside = [(F.col(a) >= 0) & (F.col(a) < n) for a, n in sizes.items()]
    known = F.coalesce(inside[0] if len(inside) == 1 else F.forall(F.array(*inside), lambda x: x), F.lit(False))
    part = lambda c: F.when(known, F.coalesce(F.col(f"value.{c}").cast("double"), F.lit(0.0))).otherwise(F.raise_error(F.lit("a cell outside the array")).cast("double"))
    out = df.select(*keys, *sizes, part("re").alias("re"), part("im").alias("im"))
    for over in passes_of(sizes, tile):
        out = _pass(out, keys, sizes, over, tile, sign, rotate_in, rotate_out)
    by = float(math.prod(sizes.values())) if normalised else 1.0
    return out.select(*keys, *sizes, (F.col("re") / by).alias("re"), (F.col("im") / by).alias("im")) if normalised else out.select(*keys, *sizes, "re", "im")
