"""Reading, writing and exporting tables; Parquet files with axes, keywords and measures in the schema."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axistab.model import AxisTable
from axistab.operators.blocks import floor_div
from axistab.operators.joins import aligned


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns, or the chosen ones (only these are read)."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such column: {missing}")
    return df.select(*columns)


def import_table(df: DataFrame, schema: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The columns that a declared schema ``{name: (type, unit)}`` knows, in its types, units in the metadata.

    Unknown columns are skipped; declared ones that are missing stay away. A value that its type cannot hold is refused.
    """
    known = [(n, *schema[n]) for n in schema if n in df.columns]
    out = df.select(*(F.col(n).cast(kind).alias(n) for n, kind, _ in known))
    for name, _, unit in known:
        out = with_metadata(out, name, unit=unit) if unit else out
    return out


def with_metadata(df: DataFrame, column: str, **items) -> DataFrame:
    """A column with keywords, a measure or units in its metadata, which Parquet keeps."""
    return df.withMetadata(column, {**df.schema[column].metadata, **{k: json.dumps(v) for k, v in items.items()}})


def metadata(df: DataFrame, column: str) -> dict:
    return {k: json.loads(v) for k, v in df.schema[column].metadata.items()}


def write_table(table: AxisTable, path: str, mode: str = "errorifexists") -> None:
    """Facts, dimensions and axes under ``path``; refuses existing output unless told otherwise."""
    table.df.write.mode(mode).parquet(f"{path}/facts")
    for axis, dim in table.dims.items():
        dim.write.mode(mode).parquet(f"{path}/dims/{axis}")
    spark = table.df.sparkSession
    about = [(json.dumps({"axes": list(table.index_axes), "dims": list(table.dims), "uid": table.uid}),)]
    spark.createDataFrame(about, "about string").coalesce(1).write.mode(mode).parquet(f"{path}/axes")


def load_table(spark: SparkSession, path: str) -> AxisTable:
    """What ``write_table`` wrote."""
    about = json.loads(spark.read.parquet(f"{path}/axes").first()["about"])
    dims = {a: spark.read.parquet(f"{path}/dims/{a}") for a in about["dims"]}
    return AxisTable(spark.read.parquet(f"{path}/facts"), tuple(about["axes"]), dims, about["uid"])


def chosen_tables(have: list[str], names: list[str] | None) -> list[str]:
    """Tables by a list of names; ``~NAME`` excludes, and with exclusions beside names only the names count."""
    wanted = [n for n in names or [] if not n.startswith("~")]
    without = [n[1:] for n in names or [] if n.startswith("~")]
    return [t for t in have if t in wanted] if wanted else [t for t in have if t not in without]


def stored_tables(spark: SparkSession, source: str) -> list[str]:
    """Names of the Parquet tables at ``source``, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    found = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))


def export_dataset(spark: SparkSession, source: str, target: str, have: list[str] | None = None, names: list[str] | None = None) -> list[str]:
    """Copy every non-empty chosen table; returns the copied names.

    ``have``: the tables to choose from, by default all at ``source``. A list that names some tables and excludes others is
    warned about (only the names count), unknown names are refused.
    """
    have = stored_tables(spark, source) if have is None else have
    if unknown := [n for n in names or [] if n.removeprefix("~") not in have]:
        raise ValueError(f"no such table: {unknown}")
    if len({n.startswith("~") for n in names or []}) == 2:
        warnings.warn("exclusions beside names are ignored", stacklevel=2)
    done = []
    for name in chosen_tables(have, names):
        df = spark.read.parquet(f"{source}/{name}.parquet")
        if df.take(1):
            df.write.mode("errorifexists").parquet(f"{target}/{name}.parquet")
            done.append(name)
    return done


def attach(spark: SparkSession, paths: dict[str, str], coords: list[str]) -> DataFrame:
    """Columns bound to where they are stored, ``{column: path}``; all stored with the same coordinates.

    Columns of one path are read together. Refuses a column without a path and columns that live on other coordinates or
    over another domain (each cell once on every path).
    """
    if bad := [c for c, p in paths.items() if not p]:
        raise ValueError(f"columns without a path: {bad}")
    by: dict[str, list[str]] = {}
    for c, p in paths.items():
        by.setdefault(p, []).append(c)
    parts = []
    for path, cols in by.items():
        df = spark.read.parquet(path)
        if [c for c in coords if c not in df.columns]:
            raise ValueError(f"{path} has other coordinates")
        parts.append(df.select(*coords, *cols))
    return parts[0] if len(parts) == 1 else aligned(parts, coords)


def cf_planes(df: DataFrame, axes: list[str], strip: int | None = None) -> DataFrame:
    """Planes labelled by their axis values: the cells of each as an array sorted by x and y.

    With ``strip`` a plane comes in strips of that many x, numbered from 0, so that no row has a whole plane.
    """
    cell, by = F.struct("x", "y", "re", "im"), [floor_div(F.col("x"), strip).alias("strip")] if strip else []
    return df.groupBy(*axes, *by).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
