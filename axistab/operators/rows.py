"""Row coordinates without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axistab.sources.scratch import stage


def with_row_axis(df: DataFrame, order_by: list[str | Column], name: str = "row", keep: list[str] | None = None) -> DataFrame:
    """Add a zero-based row coordinate in the order of ``order_by``, which must be unique (Spark keeps no row order).

    A range shuffle and a sort within partitions; only the row count of each partition reaches the driver. ``keep`` names
    the columns to return beside it, so that no others are written; all by default.
    """
    if not order_by:
        raise ValueError("order_by is needed: a DataFrame has no row order")
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    cols = [F.col(c) if isinstance(c, str) else c for c in order_by]
    dealt = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.withColumns({"__part": F.spark_partition_id(), "__at": within})
    placed = stage(placed if keep is None else placed.select(*keep, "__part", "__at"), "rows")
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(part, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), F.col("__part") + 1)
    return placed.withColumn(name, start + F.col("__at")).drop("__part", "__at")
