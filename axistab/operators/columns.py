"""Column maintenance, profiles and conversion between arrays and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.model import AxisSet, AxisTable
from axistab.operators.joins import aligned


def select_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add all columns or, if one exists already, none."""
    if taken := [n for n in columns if n in df.columns]:
        raise ValueError(f"columns exist: {taken}")
    return df.withColumns(columns)


def add_columns_from(table: AxisTable, *others: tuple[AxisSet, DataFrame]) -> AxisTable:
    """Add the columns of tables over the same cells, ``(axes, df)`` each; all or none.

    Each must conform: the same uid, the table's index axes leading its axes, and the same domain over them. Refused are
    also two tables over one list of axes and names that exist. A table with further axes keeps them as coordinate columns,
    so its values are gathered into arrays in their order first (``collapse_elements``). All tables are shuffled once, together.
    """
    if len({axes.names for axes, _ in others}) < len(others):
        raise ValueError("two tables over the same axes")
    names = [c for _, df in others for c in df.columns if c not in table.coords]
    if taken := [n for i, n in enumerate(names) if n in table.df.columns or n in names[:i]]:
        raise ValueError(f"columns exist: {taken}")
    for axes, df in others:
        if not axes.conforms(table.axes):
            raise ValueError(f"axes {axes} do not conform to {table.axes}")
        if missing := [c for c in table.coords if c not in df.columns]:
            raise ValueError(f"no coordinates: {missing}")
    out = aligned([table.df, *(df for _, df in others)], table.coords)
    return AxisTable(out, table.index_axes, table.dims, table.uid)


def remove_columns(table: AxisTable, names: list[str]) -> AxisTable:
    """Drop columns; index coordinates go only when everything goes."""
    left = [c for c in table.df.columns if c not in names]
    if unknown := [n for n in names if n not in table.df.columns]:
        raise ValueError(f"no such column: {unknown}")
    if left and any(c in names for c in table.coords):
        raise ValueError("an index column can be removed only with all others")
    return AxisTable(table.df.select(*left), table.index_axes if left else (), table.dims if left else {}, table.uid)


def is_conformant(a: DataFrame, b: DataFrame, coords: list[str], axes: tuple[AxisSet, AxisSet] | None = None, is_index: bool = False) -> DataFrame:
    """One row ``conformant``: whether both have the same cells over ``coords``.

    With ``axes`` of the table ``a`` and the column ``b`` their uids must agree and the table's axes lead the column's; for an
    index column (``is_index``) its one axis must be an axis of the table, whatever its cells.
    """
    if axes and (is_index or not axes[1].conforms(axes[0])):
        return a.sparkSession.range(1).select(F.lit(axes[1].conforms(axes[0], is_index)).alias("conformant"))
    one, two = a.select(*coords).distinct().withColumn("s", F.lit(1)), b.select(*coords).distinct().withColumn("s", F.lit(2))
    sides = one.unionByName(two).groupBy(*coords).agg(F.count(F.lit(1)).alias("n"))
    return sides.agg((F.count(F.when(F.col("n") < 2, 1)) == 0).alias("conformant"))


def shape_of(col: Column, kind: T.DataType) -> Column:
    """The sizes of an array at every rank as text, e.g. ``[2,[3,3]]``; null for a null array, 1 for no array."""

    def sizes(c: Column, k: T.DataType) -> Column:
        n = F.coalesce(F.size(c).cast("string"), F.lit("null"))
        if not isinstance(k.elementType, T.ArrayType):
            return n
        inner = F.array_join(F.transform(c, lambda x: sizes(x, k.elementType)), ",")
        return F.concat(F.lit("["), n, F.lit(",["), F.coalesce(inner, F.lit("")), F.lit("]]"))

    return F.when(col.isNotNull(), sizes(col, kind)) if isinstance(kind, T.ArrayType) else F.lit("1")


def profile_columns(df: DataFrame, schema: dict[str, tuple[str, str | None]]) -> DataFrame:
    """One row for each column of a declared schema ``{name: (type, unit)}``: presence, types, cells with content,
    shapes (distinct sizes at every rank; 1 for a column that is no array).

    One pass: plain columns are counted as they are, those of arrays as pairs of column and shape, which are summed in each task.
    """
    present = {f.name: f.dataType for f in df.schema}
    arrays = [n for n in schema if isinstance(present.get(n), T.ArrayType)]
    plain = [n for n in schema if n in present and n not in arrays]
    shapes = [F.struct(F.lit(n).alias("name"), shape_of(F.col(f"`{n}`"), present[n]).alias("shape"), F.lit(1).alias("n")) for n in arrays]
    counted = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("shape"), F.lit(1).alias("n"))
    own = [F.col(f"`{n}`").isNotNull().cast("long").alias(f"p{i}") for i, n in enumerate(plain)]
    each = df.select(F.explode(F.array(counted, *shapes)).alias("r"), *own).select("r.*", *(F.when(F.col("r.name").isNull(), F.col(f"p{i}")).alias(f"p{i}") for i in range(len(plain))))
    sums = each.groupBy("name", "shape").agg(F.sum("n").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(len(plain))))
    of = lambda n: F.col("name") == n
    stats = [
        x for n in arrays
        for x in (F.sum(F.when(of(n) & F.col("shape").isNotNull(), F.col("n"))).alias(f"n_{n}"), F.count(F.when(of(n) & F.col("shape").isNotNull(), 1)).alias(f"s_{n}"))
    ]
    stats += [x for i, n in enumerate(plain) for x in (F.sum(f"p{i}").alias(f"n_{n}"), F.lit(1).alias(f"s_{n}"))]
    one = sums.agg(*stats) if stats else df.sparkSession.range(1)
    known = lambda kind, n: (F.coalesce(F.col(f"`{kind}_{n}`"), F.lit(0)) if n in present else F.lit(0)).cast("long")
    rows = [
        F.struct(
            F.lit(n).alias("name"), F.lit(n in present).alias("present"), F.lit(kind).alias("expected_type"),
            F.lit(present[n].simpleString() if n in present else None).cast("string").alias("found_type"), F.lit(unit).cast("string").alias("unit"),
            known("n", n).alias("cells"), known("s", n).alias("shapes"),
        ) for n, (kind, unit) in schema.items()
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def shape_groups(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """``signature, columns``: array columns that have the same sizes at every rank in every row belong together."""
    shape = lambda c: F.coalesce(shape_of(F.col(c), df.schema[c].dataType), F.lit("null"))
    sums = df.agg(*(F.sum(F.xxhash64(F.col(row), shape(c)).cast("decimal(38,0)")).cast("string").alias(c) for c in columns))
    pairs = sums.select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("signature")) for c in columns))).alias("p")
    ).select("p.*")
    return pairs.groupBy("signature").agg(F.array_sort(F.collect_list("column")).alias("columns"))


def shape_envelope(df: DataFrame, coords: list[str]) -> DataFrame:
    """One row: least and largest coordinate of each axis, number of cells, and whether they fill the rectangle."""
    cells = df.select(*coords).distinct()
    out = cells.agg(*(x for c in coords for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))), F.count(F.lit(1)).alias("cells"))
    whole = F.lit(1).cast("long")
    for c in coords:
        whole = whole * (F.col(f"{c}_hi") - F.col(f"{c}_lo") + 1)
    return out.withColumn("dense", F.col("cells") == whole)


def explode_elements(df: DataFrame, col: str, axis: str, value: str, keep_empty: bool = False) -> DataFrame:
    """A row for each element of an array column: its place as ``axis``, its value as ``value``.

    With ``keep_empty`` an array without elements gives one row with place -1, a null array one with a null place, so that
    ``collapse_elements`` gets all rows back.
    """
    rest = [c for c in df.columns if c != col]
    if not keep_empty:
        return df.select(*rest, F.posexplode(col).alias(axis, value))
    out = df.select(*rest, F.col(col).isNotNull().alias("__known"), F.posexplode_outer(col).alias(axis, value))
    return out.withColumn(axis, F.when(F.col(axis).isNull() & F.col("__known"), F.lit(-1)).otherwise(F.col(axis))).drop("__known")


def collapse_elements(df: DataFrame, keys: list[str], axis: str, value: str, col: str) -> DataFrame:
    """The inverse: elements gathered into arrays in the order of ``axis``; keys with place -1 alone get an empty array, with
    a null place alone a null one."""
    packed = F.array_sort(F.collect_list(F.when(F.col(axis) >= 0, F.struct(axis, value))))
    return df.groupBy(*keys).agg(F.when(F.count(axis) > 0, F.transform(packed, lambda e: e[value])).alias(col))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without content in any row; one pass over the table."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns))).first()
    return df.select(*(f"`{c}`" for i, c in enumerate(df.columns) if counts[str(i)]))
