"""Sparse and ragged domains as runs.

A domain over axes is kept as runs ``lo, hi`` of consecutive coordinates of its last axis for each combination of the others
(the prefix). Cells, or rows with arrays of different lengths, become runs; runs are united, intersected and subtracted by
a sweep over their ends. Sorting is by range partitions and what crosses their bounds is carried by a few rows for each of
them, so that a prefix with most of the runs, or a domain without a prefix, is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axistab.operators.joins import join_same
from axistab.sources.scratch import stage


def _placed(df: DataFrame, prefix: list[str], by: str) -> DataFrame:
    """Staged in range partitions of ``prefix, by``, with their number ``__part``."""
    return stage(df.repartitionByRange(*prefix, by).withColumn("__part", F.spark_partition_id()), "runs")


def merged_runs(runs: DataFrame, prefix: list[str]) -> DataFrame:
    """``prefix, lo, hi``: disjoint runs that follow on each other made one."""
    placed = _placed(runs.select(*prefix, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")), prefix, "lo")
    own = Window.partitionBy("__part", *prefix).orderBy("lo")
    # True where a run does not go on from the one before it.
    parted = lambda w: F.coalesce(F.col("lo") != F.lag("hi").over(w) + 1, F.lit(True)).cast("long")
    islands = placed.withColumn("__new", parted(own)).withColumn("__n", F.sum("__new").over(own))
    some = stage(islands.groupBy("__part", *prefix, "__n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "islands")
    last = some.groupBy("__part", *prefix).agg(F.max("__n").alias("__top"))
    marked = join_same(some, last, ["__part", *prefix], "inner").withColumn("__edge", (F.col("__n") == 1) | (F.col("__n") == F.col("__top")))
    marked = stage(marked, "islands")
    # Only a partition's first and last run of a prefix can go on in another partition.
    through = Window.partitionBy(*(prefix or [F.lit(0)])).orderBy("lo")
    edges = marked.filter("__edge").withColumn("__new", parted(through)).withColumn("__m", F.sum("__new").over(through))
    joined = edges.groupBy(*prefix, "__m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return marked.filter("not __edge").select(*prefix, "lo", "hi").unionByName(joined.select(*prefix, "lo", "hi"))


def runs_of(cells: DataFrame, coords: list[str]) -> DataFrame:
    """The runs of a table's cells over ``coords``, repeated ones once; cells with a null last coordinate are left out."""
    *prefix, last = coords
    distinct = cells.select(*prefix, F.col(last).alias("lo")).filter("lo is not null").distinct()
    return merged_runs(distinct.withColumn("hi", F.col("lo")), prefix)


def element_runs(rows: DataFrame, coords: list[str], col: str) -> DataFrame:
    """The domain of an array column over ``coords`` and its element axis: a run from 0 for each row with elements; no element is
    touched. Each coordinate occurs once."""
    return rows.filter(F.size(col) > 0).select(*coords, F.lit(0).cast("long").alias("lo"), (F.size(col) - 1).cast("long").alias("hi"))


def cells_of(runs: DataFrame, prefix: list[str], last: str) -> DataFrame:
    """The cells of runs."""
    return runs.select(*prefix, F.explode(F.sequence("lo", "hi")).alias(last))


def runs_envelope(runs: DataFrame, prefix: list[str]) -> DataFrame:
    """One row: bounds of each axis (of the last as ``lo, hi``), rank, number of cells and of runs, and whether they fill the
    rectangle."""
    bounds = [x for c in prefix for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]
    out = runs.agg(
        *bounds, F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.sum(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("cells"),
        F.count(F.lit(1)).alias("runs"),
    )
    extents = [F.col("hi") - F.col("lo") + 1, *(F.col(f"{c}_hi") - F.col(f"{c}_lo") + 1 for c in prefix)]
    whole = reduce(lambda a, b: a * b, (e.cast("decimal(38,0)") for e in extents))
    return out.withColumns({"rank": F.lit(len(prefix) + 1), "dense": F.coalesce(F.col("cells") == whole, F.lit(False))})


def _sweep(a: DataFrame, b: DataFrame, prefix: list[str]) -> DataFrame:
    """``prefix, lo, hi, __a, __b``: stretches between neighbouring ends of runs, and whether each side covers them."""
    ends = None
    for df, one, two in ((a, 1, 0), (b, 0, 1)):
        for at, sign in ((F.col("lo"), 1), (F.col("hi") + 1, -1)):
            part = df.select(*prefix, at.cast("long").alias("__at"), F.lit(sign * one).alias("__da"), F.lit(sign * two).alias("__db"))
            ends = part if ends is None else ends.unionByName(part)
    events = ends.groupBy(*prefix, "__at").agg(F.sum("__da").alias("__da"), F.sum("__db").alias("__db"))
    placed = _placed(events, prefix, "__at")
    edges = placed.groupBy("__part", *prefix).agg(F.sum("__da").alias("__sa"), F.sum("__db").alias("__sb"), F.min("__at").alias("__first"))
    parts = Window.partitionBy(*(prefix or [F.lit(0)])).orderBy("__part")
    before = lambda c: F.coalesce(F.sum(c).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    following = F.min("__first").over(parts.rowsBetween(1, Window.unboundedFollowing))
    carried = edges.select("__part", *prefix, before("__sa").alias("__ba"), before("__sb").alias("__bb"), following.alias("__next"))
    met = join_same(placed, stage(carried, "edges"), ["__part", *prefix], "inner")
    own = Window.partitionBy("__part", *prefix).orderBy("__at")
    depth = lambda start, c: F.col(start) + F.sum(c).over(own)
    stop = F.coalesce(F.lead("__at").over(own), F.col("__next")) - 1
    out = met.select(*prefix, F.col("__at").alias("lo"), stop.alias("hi"), (depth("__ba", "__da") > 0).alias("__a"), (depth("__bb", "__db") > 0).alias("__b"))
    return out.filter("hi is not null")


def union_runs(a: DataFrame, b: DataFrame, prefix: list[str]) -> DataFrame:
    """The runs of the cells of either domain; runs may overlap on a side. Null prefixes are a prefix."""
    return merged_runs(_sweep(a, b, prefix).filter("__a or __b"), prefix)


def intersect_runs(a: DataFrame, b: DataFrame, prefix: list[str]) -> DataFrame:
    """The runs of the cells of both domains."""
    return merged_runs(_sweep(a, b, prefix).filter("__a and __b"), prefix)


def subtract_runs(a: DataFrame, b: DataFrame, prefix: list[str]) -> DataFrame:
    """The runs of the cells of ``a`` that ``b`` has not."""
    return merged_runs(_sweep(a, b, prefix).filter("__a and not __b"), prefix)


def same_runs(a: DataFrame, b: DataFrame, prefix: list[str]) -> bool:
    """Whether two domains have the same cells."""
    return not _sweep(a, b, prefix).filter("__a <> __b").take(1)
