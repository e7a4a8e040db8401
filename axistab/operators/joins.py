"""Lookup-shaped joins: a side is broadcast only after its rows were counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.model import AxisSet
from axistab.sources.scratch import free, stage

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: 16 for each plain column, and the length of strings, binaries and nested values."""
    size = F.lit(16 * len(df.columns)).cast("long")
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(col), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
    return size


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``size`` bytes; reads no more than ``rows`` + 1 of it."""
    sizes = df.select(_row_bytes(df).alias("b")).limit(rows + 1)  # only sizes pass to the one task of the limit
    found = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def sized(dim: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``dim`` marked for broadcast if it is small in rows and bytes, else for a shuffled join."""
    return F.broadcast(dim) if fits(dim, limit) else dim.hint("merge")


def join_same(a: DataFrame, b: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Join on equal columns, null equal to null; ``b`` is broadcast if it was measured to be small. Read twice, ``b`` should be
    staged or cheap."""
    other = b.toDF(*(f"__b_{c}" if c in cols else c for c in b.columns))
    on = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in cols))
    return a.join(sized(other), on, how).drop(*(f"__b_{c}" for c in cols))


def lookup_join(fact: DataFrame, dim: DataFrame, fk: str, key: str, how: str = "inner") -> DataFrame:
    """Foreign key lookup: the dimension's columns but its key beside the fact's; null keys find nothing."""
    return fact.join(sized(dim.withColumnRenamed(key, fk)), fk, how)


def keyed_lookup(fact: DataFrame, dim: DataFrame, keys: dict[str, str], element: str | None = None) -> DataFrame:
    """Lookup by a composite key ``{fact column: dimension column}``; of an array column ``element`` the first element
    (null if it is empty)."""
    for mine, theirs in keys.items():
        dim = dim.withColumnRenamed(theirs, mine)
    out = fact.join(sized(dim), list(keys))
    return out.withColumn(element, F.try_element_at(F.col(element), F.lit(1))) if element else out


def code_lookup(col: Column, codes: dict[str, int], default: int | None = None) -> Column:
    """A fixed code table as an expression: a value's code, or ``default``."""
    pairs = [x for k, v in codes.items() for x in (F.lit(k), F.lit(v))]
    found = F.create_map(*pairs)[col]
    return found if default is None else F.coalesce(found, F.lit(default))


def refcode_lookup(df: DataFrame, code_col: str, table: DataFrame, key: str) -> DataFrame:
    """Each row's reference type through a code table; rows with an unknown code keep null."""
    return lookup_join(df, table, code_col, key, "left")


def aligned(tables: list[DataFrame], coords: list[str]) -> DataFrame:
    """Columns of tables over the same coordinates side by side, in one shuffle of them all, staged.

    Refuses domains that differ and coordinates that repeat. Null coordinates are cells as well.
    """
    parts = []
    for i, df in enumerate(tables):
        packed = F.struct(F.lit(True).alias("__is"), *(F.col(f"`{c}`") for c in df.columns if c not in coords))
        parts.append(df.select(*coords, packed.alias(f"__{i}")))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [f"__{i}" for i in range(len(tables))]
    cells = both.groupBy(*coords).agg(
        *(x for n in names for x in (F.count(n).alias(f"{n}n"), F.any_value(n, True).alias(n))),
    )
    cells = stage(cells, "aligned")
    if cells.filter(reduce(lambda a, b: a | b, (F.col(f"{n}n") != 1 for n in names))).take(1):
        free(cells)
        raise ValueError("the tables have different row domains, or a coordinate twice")
    rest = [F.col(n)[c].alias(c) for n, df in zip(names, tables, strict=True) for c in df.columns if c not in coords]
    return cells.select(*coords, *rest)


def align_rows(a: DataFrame, b: DataFrame, coords: list[str], axes: tuple[AxisSet, AxisSet] | None = None) -> DataFrame:
    """Columns of two tables over the same coordinates side by side.

    Refuses domains that differ, coordinates that repeat, and axis sets (``axes``, if given) with different uids. Null
    coordinates are cells as well. Both tables are shuffled once.
    """
    if axes and axes[0].uid != axes[1].uid:
        raise ValueError(f"axes of {axes[0].uid!r} and {axes[1].uid!r} never conform")
    return aligned([a, b], coords)
