"""Indexes and reindexing: rows laid out along axes whose coordinates are sorted distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axistab.model import ROW, AxisTable, at
from axistab.operators.blocks import floor_div
from axistab.operators.joins import sized
from axistab.operators.rows import with_row_axis
from axistab.sources.scratch import stage


def from_rows(df: DataFrame, order_by: list[str | Column], uid: str = "", keep: list[str] | None = None) -> AxisTable:
    """A table with the one index axis ROW; of its columns only ``keep``, if given."""
    return AxisTable(with_row_axis(df, order_by, ROW, keep), (ROW,), {}, uid)


def axis_values(df: DataFrame, col: str) -> DataFrame:
    """``coord, value``: the sorted distinct values of a column, nulls left out."""
    distinct = df.select(F.col(col).alias("value")).filter("value is not null").distinct()
    return with_row_axis(distinct, ["value"], "coord").select("coord", "value")


def create_index(df: DataFrame, col: str, row: str = ROW) -> DataFrame:
    """``coord, value, row``: every row under its value's coordinate (long, since row lists grow with the data)."""
    dim = sized(axis_values(df, col))
    return df.select(F.col(col).alias("value"), F.col(row).alias("row")).join(dim, "value").select("coord", "value", "row")


def row_lists(index: DataFrame, most: int = 65_536) -> DataFrame:
    """``coord, value, rows``: the ascending list of the rows of each value; ``row_chunks`` where values may have any number.

    A value with more than ``most`` rows is refused when the job runs; rows are counted before any list is made.
    """
    counts = index.groupBy("coord").agg(F.count(F.lit(1)).alias("__n"))
    few = counts.select("coord", F.when(F.col("__n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"a value with over {most} rows"))).alias("__few"))
    kept = index.join(sized(few), "coord").filter("__few")
    return kept.groupBy("coord", "value").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def row_chunks(index: DataFrame, size: int = 65_536) -> DataFrame:
    """``coord, value, chunk, rows``: the ascending rows of each value from chunk x size on, at most ``size`` in a list."""
    chunk = F.floor(F.col("row") / F.lit(size)).cast("long").alias("chunk")
    return index.groupBy("coord", "value", chunk).agg(F.array_sort(F.collect_list("row")).alias("rows"))


#: Row numbers of a cell that one group numbers.
RUN = 1 << 18


def _single(df: DataFrame, coords: list[str]) -> DataFrame:
    """Rows alone in their cell. Counted with a partial aggregate, so a full cell costs one row a task."""
    rest = [c for c in df.columns if c not in coords]
    kept = df.groupBy(*coords).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__r")).filter("__n = 1")
    return kept.select(*coords, *(F.col("__r")[c].alias(c) for c in rest))


def _ordinals(df: DataFrame, coords: list[str], row: str) -> DataFrame:
    """Replaces ``row`` by the place of each row in its cell.

    A cell is cut into runs of ``RUN`` row numbers. Counts of the runs, summed within the cell, give each its first place, and
    rows are numbered within their run. So rows are shuffled once, and a cell with many rows is as many groups as it has runs.
    """
    cut = df.withColumn("__run", floor_div(F.col(row), RUN))
    runs = cut.groupBy(*coords, "__run").agg(F.count(F.lit(1)).alias("__n"))
    through = F.sum("__n").over(Window.partitionBy(*coords).orderBy("__run").rowsBetween(Window.unboundedPreceding, 0))
    before = stage(runs.withColumn("__before", through - F.col("__n")).drop("__n"), "runs")
    nth = F.row_number().over(Window.partitionBy(*coords, "__run").orderBy(row))
    met = cut.join(sized(before), [*coords, "__run"])
    return met.withColumn(row, F.col("__before") + nth - 1).drop("__run", "__before")


def reindexed(table: AxisTable, axes: list[str], allow_rows: bool = False, on_collision: str = "drop") -> AxisTable:
    """Lay a table out on ``axes``, columns that become coordinates over their sorted distinct values.

    Without rows only cells with exactly one row stay (``on_collision='error'`` refuses others). With rows all stay and ROW
    becomes the place within the cell. An indexed table may be reindexed again as long as it has ROW and ``axes`` extend its
    other axes. Rows with a null key are left out.
    """
    have = table.index_axes[:-1] if table.index_axes and table.index_axes[-1] == ROW else None
    if have is None:
        raise ValueError("a table without the axis ROW cannot be reindexed")
    if tuple(axes[: len(have)]) != have or len(set(axes)) != len(axes) or len(axes) == len(have):
        raise ValueError(f"axes {axes} do not extend {list(have)}")
    new = axes[len(have) :]
    if missing := [a for a in new if a not in table.df.columns]:
        raise ValueError(f"no such column: {missing}")
    df, dims = table.df, dict(table.dims)
    for axis in new:
        dims[axis] = axis_values(df, axis)
        df = df.join(sized(dims[axis].select(F.col("coord").alias(at(axis)), F.col("value").alias(axis))), axis).drop(axis)
    coords = [at(a) for a in axes]
    if allow_rows:
        return AxisTable(_ordinals(df, coords, ROW), (*axes, ROW), dims, table.uid)
    if on_collision == "error" and df.groupBy(*coords).count().filter("count > 1").take(1):
        raise ValueError("cells with several rows")
    return AxisTable(_single(df, coords).drop(ROW), tuple(axes), dims, table.uid)


def index_cells(table: AxisTable) -> DataFrame:
    """Occupied cells: distinct coordinates of the axes but ROW."""
    return table.df.select(*(c for c in table.coords if c != ROW)).distinct()


def lookup(table: AxisTable, where: dict[str, object]) -> DataFrame:
    """The rows at given values of axes."""
    df = table.df
    for axis, value in where.items():
        df = df.join(F.broadcast(table.dims[axis].filter(F.col("value") == F.lit(value)).select(F.col("coord").alias(at(axis)))), at(axis))
    return df


def intersect_rows(*indexes: DataFrame) -> DataFrame:
    """``row`` of the rows that all of the (filtered) indexes hold."""
    out = indexes[0].select("row")
    for other in indexes[1:]:
        out = out.join(other.select("row"), "row")
    return out.distinct()


def union_domains(*domains: DataFrame) -> DataFrame:
    """Cells of any of the domains."""
    out = domains[0]
    for other in domains[1:]:
        out = out.unionByName(other)
    return out.distinct()


def domain_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of ``a`` that ``b`` has not."""
    return a.distinct().join(b.distinct(), a.columns, "left_anti")
