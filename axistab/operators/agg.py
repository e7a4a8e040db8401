"""Aggregations: means along an axis, merged indexes, reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average_by(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Mean of all elements (row x element axes) of an array column of numbers or of ``struct<re, im>`` for each key."""
    kind, depth = df.schema[col].dataType, 0
    flat = F.col(col)
    while hasattr(kind, "elementType"):
        kind, depth = kind.elementType, depth + 1
    for _ in range(depth - 1):
        flat = F.flatten(flat)
    each = df.select(*keys, F.explode(flat).alias("__v") if depth else flat.alias("__v"))
    if hasattr(kind, "fields"):
        return each.groupBy(*keys).agg(
            F.count("__v").alias("n"), (F.sum(F.col("__v.re").cast("double")) / F.count("__v")).alias("re"),
            (F.sum(F.col("__v.im").cast("double")) / F.count("__v")).alias("im"),
        )
    return each.groupBy(*keys).agg(F.count("__v").alias("n"), (F.sum(F.col("__v").cast("double")) / F.count("__v")).alias("mean"))


def merge_indexes(*partials: DataFrame) -> DataFrame:
    """``value, row`` of several partial indexes, each pair once; stays long, so that a value may have any number of rows."""
    out = partials[0].select("value", "row")
    for other in partials[1:]:
        out = out.unionByName(other.select("value", "row"))
    return out.distinct()


def any_true(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(col).alias(name))


def bits_or(df: DataFrame, keys: list[str], col: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bit_or(col).alias(name))


def vector_sum(df: DataFrame, keys: list[str], col: str, axis: str = "pos", name: str = "total") -> DataFrame:
    """Element-wise sum of arrays: a row for each key and place."""
    return df.select(*keys, F.posexplode(col).alias(axis, "__v")).groupBy(*keys, axis).agg(F.sum(F.col("__v").cast("double")).alias(name))


def last_set(df: DataFrame, keys: list[str], col: str, order: str, unset=-1, name: str = "last") -> DataFrame:
    """The value of the last row in ``order`` that is set, i.e. not null and not ``unset``."""
    known = F.col(col).isNotNull() & (F.col(col) != F.lit(unset))
    return df.groupBy(*keys).agg(F.max_by(F.when(known, F.col(col)), F.when(known, F.col(order))).alias(name))
