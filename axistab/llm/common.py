"""What the operators of this subpackage share: staged tables, blob coding, batch access to texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axistab.operators.joins import fits
from axistab.sources.scratch import free, scratch_path, shared_dir, stage  # noqa: F401
from axistab.sources.ship import ship

#: ASCII white space, the separators of words in every operator here.
WHITE = b" \t\n\r\x0b\x0c"
#: The same as a class of Java's and RE2's regular expressions.
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, limit_rows: int = 200_000) -> DataFrame:
    """Join that broadcasts ``right`` only if it was measured to have at most ``limit_rows`` rows and 32 MB.

    Beyond that both sides are shuffled. ``right`` is read here, so it should be a staged table of narrow rows.
    """
    return left.join(F.broadcast(right) if fits(right, limit_rows) else right.hint("merge"), on, how)


def row_key(col: Column) -> Column:
    """An id as a string that is never null, so that null ids join like others."""
    return F.when(col.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col.cast("string")))


def text_hash(col: Column) -> Column:
    return F.xxhash64(col.cast("string"))


def remove_rows(df: DataFrame, id_col: str, text_col: str, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``df`` but those whose ``_key`` and ``_hash`` (id and text) are in ``dropped``; of ``repeated`` ones one stays.

    Both are staged tables of narrow rows. While they are small they are broadcast and texts stay where they are; beyond
    that the texts are shuffled once. Column names of ``df`` must not be ``_key`` or ``_hash``.
    """
    on = ["_key", "_hash"]
    keyed = df.withColumns({"_key": row_key(F.col(id_col)), "_hash": text_hash(F.col(text_col))})
    left = join_sized(keyed, dropped, on, "left_anti")
    if repeated.take(1):
        once = join_sized(left, repeated, on, "left_semi").dropDuplicates(on)
        left = join_sized(left, repeated, on, "left_anti").unionByName(once)
    return left.drop(*on)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def row_runs(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts take about ``max_bytes`` (or one row, if that is longer)."""
    text = batch.column(column)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(text).to_pylist()], dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with large values one by one, so that only one at a time is held beside its batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def held_out(col: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds`` (a null id counts as the empty text)."""
    return (F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % folds) == fold


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
