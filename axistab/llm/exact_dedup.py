"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries, one a partition and merged by sums, name the digests that may be frequent. An exact pass over
those alone finds their winners, which are broadcast, so rows of frequent digests are settled where they are read.
All other digests go through an ordinary shuffle. A digest that each task counts only once is left to it too, so what is
shuffled has at most one row a task, or 2 n / counters rows, of any digest.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import WHITE, remove_rows, row_key, row_runs, stage, text_hash, texts_of

COUNTERS = 4096


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_sha`` (of the text without white space) and ``_len`` (code points of the text) to each row."""
    for batch in batches:
        for run in row_runs(batch, "_text"):
            text = run.column("_text")
            sha = [hashlib.sha256(t.translate(None, WHITE)).hexdigest() for t in texts_of(text)]
            length = pc.fill_null(pc.utf8_length(text).cast(pa.int64()), 0)
            rest = [c for c in run.schema.names if c not in ("_text", "_sha", "_len")]
            yield pa.RecordBatch.from_arrays([*(run.column(c) for c in rest), pa.array(sha, pa.string()), length], names=[*rest, "_sha", "_len"])


def misra_gries(values: Iterator[list[str]], counters: int) -> dict[str, int]:
    """Lower bounds of frequencies: off by at most n / (counters + 1), at most ``counters`` of them."""
    held: Counter = Counter()
    for some in values:
        held.update(some)
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = Counter({k: v - cut for k, v in held.items() if v > cut})
    return held


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``_sha`` of at most ``counters`` digests, among them every one with 2 / counters of the rows and two in some task's count."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = misra_gries((b.column("_sha").to_pylist() for b in batches), counters)
        held = {k: v for k, v in held.items() if v > 1}
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["_sha", "_least"])

    found = digests.select("_sha").mapInArrow(summary, "_sha string, _least long")
    return found.groupBy("_sha").agg(F.sum("_least").alias("_least")).orderBy(F.desc("_least"), "_sha").limit(counters).select("_sha")


def _digest_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("_id", id_type), T.StructField("_sha", T.StringType()), T.StructField("_len", T.LongType())])
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(_digests, schema)


def _first() -> Column:
    """Orders the rows of a digest: most code points, then smallest id, a null id last."""
    return F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))


def _heavy_winners(digests: DataFrame, counters: int, total: int) -> DataFrame:
    """Exact winner and size of each frequent digest; at most ``counters`` rows, the only thing broadcast."""
    exact = digests.join(F.broadcast(frequent_digests(digests, counters)), "_sha", "left_semi")
    best = exact.groupBy("_sha").agg(_first().alias("b"), F.count(F.lit(1)).alias("_n"))
    return stage(best.filter(F.col("_n") * counters >= total).select("_sha", F.col("b.i").alias("_keep"), "_n"), "heavy")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Which row stays of each set of equal texts.

    Texts are equal when identical after deleting ASCII white space; a null text is empty, and empty texts are equal.
    The row with most code points stays, then the smallest id (a null id after all others). Every input row gives one
    output row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of rows that repeat id and text exactly one is kept.
    Other columns of the input, whatever their names, are neither read nor returned; an empty table gives no rows.
    """
    digests = stage(_digest_table(df, id_col, text_col), "digests")
    heavy = F.broadcast(_heavy_winners(digests, counters, digests.count()))

    settled = digests.join(heavy, "_sha")
    keeper = F.col("_id").eqNullSafe(F.col("_keep"))
    dropped = settled.filter(~keeper).select("_id", "_keep", "_n", F.lit(False).alias("_kept"), "_sha")
    # Rows that repeat the winner's id: counted, then dealt out again with one of them kept.
    same = settled.filter(keeper).groupBy("_id", "_keep", "_n", "_sha").agg(F.count(F.lit(1)).alias("_c"))
    winners = same.select("_id", "_keep", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("_i"), "_sha")
    winners = winners.select("_id", "_keep", "_n", (F.col("_i") == 1).alias("_kept"), "_sha")

    by = Window.partitionBy("_sha")
    order = by.orderBy(F.desc("_len"), F.col("_id").isNull(), F.col("_id"))
    rest = digests.join(heavy, "_sha", "left_anti")
    rest = rest.select(
        "_id", F.first("_id").over(order).alias("_keep"), F.count(F.lit(1)).over(by).alias("_n"), (F.row_number().over(order) == 1).alias("_kept"),
        "_sha",
    )

    out = rest.unionByName(dropped).unionByName(winners)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df``, all columns, that ``exact_dedup`` keeps; of rows that repeat id and text one stays.

    Copies of frequent digests are removed where they are read, against the broadcast winners. For all others the decision
    is made on narrow rows; texts are shuffled only if the rows to remove are too many to broadcast. A null text counts as
    empty, a null id comes after all others; an empty table gives no rows.
    """
    names = df.columns
    text = F.col(text_col).cast("string")
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("_id", id_type), T.StructField("_hash", T.LongType()), T.StructField("_sha", T.StringType()),
            T.StructField("_len", T.LongType()),
        ]
    )
    digests = stage(
        df.select(F.col(id_col).alias("_id"), text_hash(text).alias("_hash"), text.alias("_text")).mapInArrow(_digests, schema), "digests",
    )
    first = F.min(
        F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_hash").alias("h"))
    ).alias("b")
    best = lambda rows: rows.groupBy("_sha").agg(first, F.count(F.lit(1)).alias("n")).select(
        "_sha", row_key(F.col("b.i")).alias("bk"), F.col("b.h").alias("bh"), "n",
    )
    frequent = F.broadcast(frequent_digests(digests, counters))
    heavy = stage(best(digests.join(frequent, "_sha", "left_semi")).filter(F.col("n") * counters >= digests.count()), "heavy")

    keyed = digests.withColumn("_key", row_key(F.col("_id")))
    wins = (F.col("_key") == F.col("bk")) & (F.col("_hash") == F.col("bh"))
    rare = keyed.join(F.broadcast(heavy), "_sha", "left_anti")
    groups = stage(best(rare).filter("n > 1"), "groups")
    met = rare.join(groups.hint("merge"), "_sha").select("_key", "_hash", wins.alias("wins"))
    met = met.unionByName(keyed.join(F.broadcast(heavy), "_sha").filter(wins).select("_key", "_hash", F.lit(True).alias("wins")))
    judged = stage(met.groupBy("_key", "_hash", "wins").agg(F.count(F.lit(1)).alias("n")), "judged")

    plain = df.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_text", F.col(f"c{names.index(text_col)}").cast("string"))
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]
    at, of = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rows = plain.mapInArrow(_digests, T.StructType([*fields, T.StructField("_sha", T.StringType()), T.StructField("_len", T.LongType())]))
    rows = rows.join(F.broadcast(heavy.drop("n")), "_sha", "left").filter(
        F.col("bk").isNull() | ((row_key(F.col(at)) == F.col("bk")) & (text_hash(F.col(of)) == F.col("bh")))
    )
    rows = rows.select(*(f"c{i}" for i in range(len(names))))
    return remove_rows(
        rows, at, of, judged.filter("not wins").select("_key", "_hash"), judged.filter("wins and n > 1").select("_key", "_hash"),
    ).toDF(*names)


ORACLE_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
w as (
  select doc_id, sha256(norm) as text_sha256,
    first_value(doc_id) over (partition by norm order by length(t) desc, doc_id) as keep_id,
    count(*) over (partition by norm) as group_size
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w
"""
