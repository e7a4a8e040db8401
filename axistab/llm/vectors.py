"""Vectors in shards, met by queries in blocks.

Rows are packed into shards of a bounded number of vectors, where they are read; queries into blocks. Blocks and shards
meet through an equi-join on a group of shards: each block goes out once a group, and whatever a group finds for a block
is merged before it leaves the task. So a task holds one block and one shard, however many rows there are.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axistab.llm.common import stage

#: Vectors of a shard and queries of a block.
SHARD, BLOCK = 1 << 13, 512


def usable(df: DataFrame, id_col: str, vec_col: str, **others: Column) -> DataFrame:
    """``_id`` (long), ``_vec`` (doubles) and ``others`` of the rows with an id and a vector whose components are all known and
    finite."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    out = df.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_vec"), finite.alias("_ok"), *(c.alias(n) for n, c in others.items()))
    return out.filter("_id is not null and _ok").drop("_ok")


def once_an_id(df: DataFrame) -> DataFrame:
    """Of rows with one ``_id`` the least one by its other columns."""
    rest = [c for c in df.columns if c != "_id"]
    return df.groupBy("_id").agg(F.min(F.struct(*rest)).alias("_r")).select("_id", *(F.col("_r")[c].alias(c) for c in rest))


def matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Arrays as the rows of a matrix; a shorter vector is followed by zeros."""
    rows = [x for chunk in column.chunks for x in chunk.to_numpy(zero_copy_only=False)]
    width = max(map(len, rows), default=0)
    if all(len(x) == width for x in rows):
        return np.array(rows, kind).reshape(len(rows), width)
    out = np.zeros((len(rows), width), kind)
    for to, x in zip(out, rows, strict=True):
        to[: len(x)] = x
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """Rows followed by zeros up to ``width``."""
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def packed(df: DataFrame, size: int, make: Callable[[pa.Table], object], name: str) -> DataFrame:
    """``<name>`` (a number) and ``<name>_data``: ``make`` of every ``size`` rows, staged.

    Small partitions are drawn together first, so that few packs are left part-filled; rows are not shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at, held, rows = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, size - rows)
                batch, rows = batch.slice(some.num_rows), rows + some.num_rows
                held.append(some)
                if rows == size:
                    yield pack(first + at, held)
                    at, held, rows = at + 1, [], 0
        if held:
            yield pack(first + at, held)

    def pack(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        data = pickle.dumps(make(pa.Table.from_batches(held)), protocol=5)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=[name, f"{name}_data"])

    full = -(-df.count() // size)
    return stage(df.coalesce(max(1, full)).mapInArrow(run, f"{name} long, {name}_data binary"), name)


def meet(blocks: DataFrame, shards: DataFrame, start: Callable, step: Callable, end: Callable, schema: str) -> DataFrame:
    """Every block with every shard: ``state = start(block)``, ``step(block, state, shard)`` for each shard of a group, and the rows
    ``end(block, state)``, a list of columns.

    Shards are dealt to groups, a few for each core; a block goes out once a group.
    """
    spark = blocks.sparkSession
    groups = max(1, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    number = F.shiftright("shard", 32) + F.col("shard").bitwiseAND(F.lit((1 << 32) - 1))
    dealt = shards.withColumn("_g", F.pmod(number, F.lit(groups)))
    asked = blocks.withColumn("_g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    pairs = asked.join(dealt.hint("merge"), "_g").select("_g", "block", "block_data", "shard_data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = block = state = None
        for batch in batches:
            for i in range(batch.num_rows):
                at = batch.column("_g")[i].as_py(), batch.column("block")[i].as_py()
                if at != now:
                    if now:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in end(block, state)], names=names)
                    block = pickle.loads(batch.column("block_data")[i].as_py())
                    now, state = at, start(block)
                step(block, state, pickle.loads(batch.column("shard_data")[i].as_py()))
        if now:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in end(block, state)], names=names)

    names = [part.split()[0] for part in schema.split(",")]
    return pairs.mapInArrow(run, schema)
