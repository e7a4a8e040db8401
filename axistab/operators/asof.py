"""The nearest known values below and above, by range partitions.

Wanted and known places are sorted together into range partitions, so that a key with most of the rows lies over as many of
them as its rows need. Within a partition the last and the next known place are found by sorting; over its bounds they are
carried by one row for each key and partition.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axistab.functions.expr import let
from axistab.operators.joins import join_same
from axistab.sources.scratch import stage


def bracket(wanted: DataFrame, known: DataFrame, keys: list[str], at: str) -> DataFrame:
    """``keys, at, below, above`` of each distinct wanted place: the greatest known place not above it and the least not below.

    Both are null where there is none. Null keys are a key; rows with a null place are left out on either side.
    """
    have = known.select(*keys, F.col(at).alias("__at")).filter("__at is not null").distinct().withColumn("__have", F.col("__at"))
    none = F.lit(None).cast(have.schema["__have"].dataType)
    asked = wanted.select(*keys, F.col(at).alias("__at")).filter("__at is not null").distinct().withColumn("__have", none)
    dealt = have.unionByName(asked).repartitionByRange(*keys, "__at").withColumn("__part", F.spark_partition_id())
    placed = stage(dealt, "places")
    # One row for each key and partition: what lies before and after it within the key.
    edges = placed.groupBy(*keys, "__part").agg(F.min("__have").alias("__first"), F.max("__have").alias("__last"))
    parts = Window.partitionBy(*keys).orderBy("__part")
    edges = edges.select(
        *keys, "__part", F.max("__last").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.min("__first").over(parts.rowsBetween(1, Window.unboundedFollowing)).alias("__after"),
    )
    own = Window.partitionBy("__part", *keys)
    found = placed.withColumns(
        {
            "__lo": F.max("__have").over(own.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)),
            "__hi": F.min("__have").over(own.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)),
        }
    ).filter("__have is null")
    met = join_same(found, stage(edges, "edges"), [*keys, "__part"], "inner")
    return met.select(*keys, F.col("__at").alias(at), F.coalesce("__lo", "__before").alias("below"), F.coalesce("__hi", "__after").alias("above"))


def nearest(wanted: DataFrame, known: DataFrame, keys: list[str], at: str, name: str = "nearest") -> DataFrame:
    """``keys, at, <name>`` of each distinct wanted place: the nearest known one, of two the lower; null where there is none."""
    low = F.col("below").isNotNull() & (F.col("above").isNull() | (F.col(at) - F.col("below") <= F.col("above") - F.col(at)))
    return bracket(wanted, known, keys, at).select(*keys, at, F.when(low, F.col("below")).otherwise(F.col("above")).alias(name))


def interpolated(wanted: DataFrame, samples: DataFrame, keys: list[str], at: str, value, columns: list[str]) -> DataFrame:
    """``keys, at`` and the columns of the struct ``value(lower sample, upper sample, share)`` of each distinct wanted place.

    The samples (structs of ``columns``) are those before and after it, ``share`` is how far it lies between them, 0 at a sample.
    Outside of the samples, and where there are none, the result is null. Of samples with one key and place the least counts.
    """
    near = bracket(wanted, samples, keys, at)
    each = samples.select(*keys, F.col(at).alias("__at"), F.struct(*columns).alias("__s")).groupBy(*keys, "__at").agg(F.min("__s").alias("__s"))
    each = stage(each, "samples")
    for side in ("below", "above"):
        near = join_same(near, each.select(*keys, F.col("__at").alias(side), F.col("__s").alias(f"__{side}")), [*keys, side], "left")
    width = F.col("above") - F.col("below")
    share = F.when(width == 0, F.lit(0.0)).otherwise((F.col(at) - F.col("below")) / width)
    out = F.when(F.col("__below").isNotNull() & F.col("__above").isNotNull(), value(F.col("__below"), F.col("__above"), share))
    return near.select(*keys, at, out.alias("__v")).select(*keys, at, "__v.*")


def on_sphere(lower: Column, upper: Column, share: Column, lon: str = "lon", lat: str = "lat") -> Column:
    """``lon, lat`` in radians between two directions along the great circle; longitudes from 0 to 2 pi, whatever side of the
    wrap the samples are on. Opposite directions have no such circle and give null."""

    def vector(d: Column, name: str) -> dict[str, Column]:
        return {f"{name}x": F.cos(d[lat]) * F.cos(d[lon]), f"{name}y": F.cos(d[lat]) * F.sin(d[lon]), f"{name}z": F.sin(d[lat])}

    def weighed(v: Column) -> Column:
        cross = [v["ay"] * v["bz"] - v["az"] * v["by"], v["az"] * v["bx"] - v["ax"] * v["bz"], v["ax"] * v["by"] - v["ay"] * v["bx"]]
        sine = F.sqrt(reduce(lambda x, y: x + y, (c * c for c in cross)))
        angle = F.atan2(sine, v["ax"] * v["bx"] + v["ay"] * v["by"] + v["az"] * v["bz"])
        return let({"v": v, "angle": angle}, between)

    def between(w: Column) -> Column:
        v, near, sine = w["v"], w["angle"] < 1e-9, F.sin(w["angle"])
        left = F.when(near, 1 - v["f"]).otherwise(F.sin((1 - v["f"]) * w["angle"]) / sine)
        right = F.when(near, v["f"]).otherwise(F.sin(v["f"] * w["angle"]) / sine)
        point = {c: left * v[f"a{c}"] + right * v[f"b{c}"] for c in "xyz"}
        return F.when(w["angle"] < math.pi - 1e-9, let(point, direction))

    def direction(p: Column) -> Column:
        flat = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        return F.struct(F.pmod(F.atan2(p["y"], p["x"]), F.lit(2 * math.pi)).alias(lon), F.atan2(p["z"], flat).alias(lat))

    return let(vector(lower, "a") | vector(upper, "b") | {"f": share}, weighed)
