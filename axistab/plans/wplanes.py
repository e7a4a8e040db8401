"""How many w planes a table needs, and where they lie.

The distribution of \\|w\\| is kept as a mergeable sketch of quantiles: sketches of parts of a table, made at different times, are
merged without reading the rows again. Planes lie so that the phase that a row's distance from its plane makes at the edge of
the field stays within a bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch. The rank of a quantile is off by at most ``RANK_ERROR`` of the rows in 99 of 100 cases.
SKETCH_K, RANK_ERROR = 1600, 0.0025


def w_sketches(df: DataFrame, keys: list[str], w: str = "w") -> DataFrame:
    """``keys, sketch, n``: a sketch of \\|w\\| for each part of a table; null and NaN count for nothing."""
    size = F.abs(F.col(w).cast("double"))
    known = F.when(size < float("inf"), size)
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(known, SKETCH_K).alias("sketch"), F.count(known).alias("n"))


def merged_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of parts merged into one for each of ``keys``; parts without rows add nothing."""
    return sketches.filter("n > 0").groupBy(*keys).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"))


def w_quantile(sketch: Column, share: float) -> Column:
    """The \\|w\\| that ``share`` of the rows do not exceed."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def plane_step(radius: float, error: float) -> float:
    """Distance of planes, in wavelengths, at which no row's phase is off by more than ``error`` (radians) within ``radius`` (the sine
    of the angle) of the field's centre."""
    if not 0 < radius <= 1 or not error > 0:
        raise ValueError("radius must lie in (0, 1], error above 0")
    # The same as 1 - sqrt(1 - r^2), without the loss for small fields.
    return 2 * error / (2 * math.pi * (radius * radius / (1 + math.sqrt(1 - radius * radius))))


def number_of_planes(top: Column, step: float) -> Column:
    """Planes 0, step, 2 step ... so that every \\|w\\| up to ``top`` is within half a step of one; null for no rows."""
    return (F.ceil(top / step - 0.5) + 1).cast("long")


def plane_of(w: Column, step: float, planes: Column) -> Column:
    """The plane of a row: the nearest one, the last for what lies beyond."""
    return F.least(F.floor(F.abs(w) / step + 0.5).cast("long"), planes - 1)


def w_planes(df: DataFrame, keys: list[str], radius: float, error: float, share: float = 1.0, w: str = "w") -> DataFrame:
    """``keys, n, top, planes``: for each of ``keys`` the rows, the \\|w\\| that ``share`` of them do not exceed, and how many planes cover
    it. With ``share`` 1 the largest \\|w\\| is exact; below, its rank is that of the sketch."""
    sketches = w_sketches(df, keys, w).filter("n > 0")
    top = w_quantile(F.col("sketch"), share)
    return sketches.select(*keys, "n", top.alias("top"), number_of_planes(top, plane_step(radius, error)).alias("planes"))
