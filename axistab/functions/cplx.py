"""Complex numbers as ``struct<re, im>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cplx(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def cadd(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def cmul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conj(a: Column) -> Column:
    return cplx(a["re"], -a["im"])


def polar(radius: Column, angle: Column) -> Column:
    return cplx(radius * F.cos(angle), radius * F.sin(angle))


def cdiv(a: Column, by: Column) -> Column:
    """Division by a real number."""
    return cplx(a["re"] / by, a["im"] / by)
