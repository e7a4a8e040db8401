"""Partitions as data: block numbers and halos, used as keys before grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axistab.model import AxisSet
from axistab.operators.joins import sized
from axistab.operators.rows import with_row_axis


def floor_div(coord: Column, size: int) -> Column:
    """Exact quotient of integral coordinates, rounded down (doubles lose coordinates from 2^53 on)."""
    coord, by = coord.cast("long"), F.lit(size).cast("long")
    return F.call_function("div", coord - F.pmod(coord, by), by)


def partition_rows(df: DataFrame, coords: list[str], sizes: list[int | None]) -> DataFrame:
    """Adds ``<coord>_block`` for every axis with a block size."""
    if len(sizes) > len(coords):
        raise ValueError("more block sizes than axes")
    if any(s is not None and s <= 0 for s in sizes):
        raise ValueError("block sizes must be positive")
    return df.withColumns({f"{c}_block": floor_div(F.col(c), s) for c, s in zip(coords, sizes, strict=False) if s})


def block_range(coord: Column, stride: int, offset: int, lo: int, hi: int) -> tuple[Column, Column]:
    """First and last block k whose range ``offset + k stride + [lo, hi]`` holds a coordinate (none if first > last)."""
    coord = coord.cast("long")
    return floor_div(coord - F.lit(offset + hi - stride + 1).cast("long"), stride), floor_div(coord - F.lit(offset + lo).cast("long"), stride)


def partition_axis(
    df: DataFrame, coord: str, stride: int, offset: int = 0, extent: tuple[int, int] | None = None, block: str = "block", limit: int | None = None,
) -> DataFrame:
    """A row for each block that holds it: blocks may leave gaps or overlap; they number from 0 up to ``limit`` - 1.

    Block k covers ``offset + k stride + extent``. Only the few blocks of a row are made, never a join with all blocks.
    """
    if stride <= 0:
        raise ValueError("stride must be positive")
    lo, hi = extent or (0, stride - 1)
    first, last = block_range(F.col(coord), stride, offset, lo, hi)
    first = F.greatest(first, F.lit(0).cast("long"))
    last = F.least(last, F.lit(limit - 1).cast("long")) if limit is not None else last
    return df.withColumn(block, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))


def partition_axes(df: DataFrame, parts: dict[str, dict], axes: tuple[AxisSet, AxisSet] | None = None) -> DataFrame:
    """Blocks over several axes: ``{coord: arguments of partition_axis}``; adds ``<coord>_block`` for each.

    A row comes out once for each combination of blocks that holds it. With ``axes``, those of the table and of the
    partition, the uids must agree and the partition's axes be axes of the table.
    """
    if axes and (axes[0].uid != axes[1].uid or set(axes[1].names) - set(axes[0].names)):
        raise ValueError(f"axes {axes[1]} do not partition {axes[0]}")
    for coord, how in parts.items():
        df = partition_axis(df, coord, **({"block": f"{coord}_block"} | how))
    return df


def number_of_blocks(lowest: int, highest: int, stride: int) -> int:
    return (highest - lowest + stride) // stride


def narrow_partition(df: DataFrame, keep: list[str]) -> DataFrame:
    """The blocks of a partition over fewer axes."""
    return df.select(*keep).distinct()


def blocks_and_halos(df: DataFrame, coord: str, size: int, border: int, extent: int) -> DataFrame:
    """Rows in blocks of ``size`` grown by ``border``, clipped to 0..extent-1; ``inner`` tells the block's own rows."""
    grown = partition_axis(
        df.filter(F.col(coord).between(0, extent - 1)), coord, size, 0, (-border, size + border - 1), "block", number_of_blocks(0, extent - 1, size),
    )
    return grown.withColumn("inner", floor_div(F.col(coord), size) == F.col("block"))


def halos_over_axes(df: DataFrame, sizes: dict[str, int], borders: dict[str, int], extents: dict[str, int]) -> DataFrame:
    """Blocks with halos over several axes: ``<coord>_block`` for each, ``inner`` where the row lies in the block itself."""
    parts = {
        c: {"stride": s, "extent": (-borders.get(c, 0), s + borders.get(c, 0) - 1), "limit": number_of_blocks(0, extents[c] - 1, s)} for c,
        s in sizes.items()
    }
    inside = df.filter(reduce(lambda a, b: a & b, (F.col(c).between(0, extents[c] - 1) for c in sizes)))
    inner = reduce(lambda a, b: a & b, (floor_div(F.col(c), s) == F.col(f"{c}_block") for c, s in sizes.items()))
    return partition_axes(inside, parts).withColumn("inner", inner)


def blocks_by_count(df: DataFrame, coord: str, blocks: int, border: int, extent: int) -> DataFrame:
    """As ``blocks_and_halos`` with blocks of ceil(extent / blocks)."""
    return blocks_and_halos(df, coord, max(1, -(-extent // blocks)), border, extent)


def partition_by_value(df: DataFrame, cols: list[str], part: str = "part") -> DataFrame:
    """Rows with the number of their part, one for each combination of values in order; null values are a part as well.

    Only the distinct combinations are numbered and joined back, so a value with many rows stays where its rows are read.
    """
    keys = [f"__{c}" for c in cols]
    dim = with_row_axis(df.select(*(F.col(c).alias(k) for c, k in zip(cols, keys, strict=True))).distinct(), keys, part)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in zip(cols, keys, strict=True)))
    return df.join(sized(dim), same).drop(*keys)


def blocks_by_mueller(df: DataFrame, block: str, out_col: str, in_col: str) -> DataFrame:
    """``block, stokes``: the set of values that the pairs of a block need."""
    return df.select(block, F.explode(F.array(out_col, in_col)).alias("stokes")).distinct()
