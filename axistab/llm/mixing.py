"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget. Whole passes over the source are taken first. The rest of the budget is fitted on the
source's histogram of exact lengths: a proportional share over the lengths, then a bounded knapsack over what is left of
the budget. Which documents of a length are taken is settled by a seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import join_sized, row_key, row_runs, stage, text_hash, texts_of
from axistab.operators.rows import with_row_axis

WEIGHTS, TOTAL, REPEATS, SEED = (5.0, 2.0, 1.0), 1.5, 2, 17
#: Words of budget that are left to the knapsack at first, and at most while its sum can be larger.
KNAPSACK, KNAPSACK_MOST = 1 << 16, 1 << 23
#: Lengths that take part in exchanges.
EXCHANGED = 64


def _share(counts: dict[int, int], words: int, total: int) -> dict[int, int]:
    """Documents of each length for about ``words`` of ``total`` words: shares of the documents up to each length, rounded
    down, so that lengths with few documents get their share together; less than the longest length above ``words``."""
    taken, seen, before = {}, 0, 0
    for k in sorted(counts):
        seen += counts[k]
        taken[k] = seen * words // total - before
        before += taken[k]
    return taken


def _fit(counts: dict[int, int], taken: dict[int, int], left: int, window: int) -> dict[int, int]:
    """``taken`` and a bounded knapsack of ``left`` words over what it leaves; lengths come in a scattered order."""
    taken = dict(taken)
    for k in sorted(counts, reverse=True):
        if left <= window:
            break
        if k <= left and taken[k] < counts[k]:
            taken[k] += 1
            left -= k
    # The step that first reaches each sum is all that is kept, so memory is that of the sums.
    reach, first, steps = np.zeros(left + 1, bool), np.zeros(left + 1, np.int32), []
    reach[0] = True
    for k in sorted(counts, key=lambda k: (k * 2654435761 & 0xFFFFFFFF, k)):
        spare, piece = min(counts[k] - taken[k], left // k), 1
        while spare > 0 and not reach[left]:
            piece = min(piece, spare)
            new = np.zeros(left + 1, bool)
            new[k * piece :] = reach[: left + 1 - k * piece]
            new &= ~reach
            first[new] = len(steps)
            reach |= new
            steps.append((k, piece))
            spare, piece = spare - piece, piece * 2
    at = int(np.flatnonzero(reach)[-1])
    while at:
        k, piece = steps[first[at]]
        taken[k] += piece
        at -= k * piece
    return taken


def _exchanged(counts: dict[int, int], taken: dict[int, int], left: int) -> dict[int, int]:
    """``taken`` after adding and removing documents so that less of ``left`` words remains.

    What differs between two sums can be put in an order in which documents are added while words are left and removed while
    there are too many, so that what is left stays within the longest length either way. Those states are searched from the
    nearest on, with the documents exchanged on the way to each.
    """
    lengths = sorted(counts, key=lambda k: -min(taken[k], counts[k] - taken[k]))[:EXCHANGED]
    ks, top = np.array(lengths), max(lengths)
    spare, have = np.array([counts[k] - taken[k] for k in lengths]), np.array([taken[k] for k in lengths])
    if left > top:
        return taken
    seen, states, moved, best = np.zeros(2 * top + 1, bool), np.array([left]), np.zeros((1, len(ks)), np.int64), (left, np.zeros(len(ks), np.int64))
    seen[left + top] = True
    while len(states) and best[0]:
        more = states > 0
        on, off = moved < spare, -moved < have
        i, j = np.nonzero(np.where(more[:, None], on, off))
        sign = np.where(more[i], 1, -1)
        new = states[i] - sign * ks[j]
        fresh = (np.abs(new) <= top) & ~seen[np.clip(new, -top, top) + top]
        new, first = np.unique(new[fresh], return_index=True)
        i, j, sign = (x[fresh][first] for x in (i, j, sign))
        after = moved[i]
        after[np.arange(len(new)), j] += sign
        seen[new + top] = True
        states, moved = new, after
        if (new >= 0).any() and (least := new[new >= 0].min()) < best[0]:
            best = int(least), after[np.flatnonzero(new == least)[0]]
    return taken | {k: taken[k] + int(n) for k, n in zip(lengths, best[1], strict=True)}


def fit_budget(counts: dict[int, int], budget: int, window: int = KNAPSACK, most: int = KNAPSACK_MOST) -> dict[int, int]:
    """How many documents of each length to take for a sum as near below ``budget`` as can be.

    A proportional share over the lengths comes first, at every budget; a bounded knapsack fits what is left: 1/64 of the
    budget within ``window``, and twice as much again and again, up to ``most`` words, until the sum is the largest there can
    be. A budget of at most ``most`` words is thus fitted exactly. Beyond it documents are exchanged until no word is left that
    they can make up; what may then stay below the best sum is for lengths with few documents among many. The earliest of
    the best sums counts.
    """
    counts = {k: n for k, n in counts.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in counts.items())
    if budget >= total:
        return counts
    goal = budget - budget % math.gcd(*counts)
    rest = min(budget // 64, window // 2)
    best, top = dict.fromkeys(counts, 0), -1
    while top < goal:
        taken = _share(counts, budget - rest, total)
        left = budget - sum(k * n for k, n in taken.items())
        while left < 0:  # by less than the longest length
            some = [k for k, n in taken.items() if n]
            k = min((k for k in some if k >= -left), default=max(some))
            taken[k] -= 1
            left += k
        found = _fit(counts, taken, left, max(window, rest))
        if (words := sum(k * n for k, n in found.items())) > top:
            best, top = found, words
        if rest >= min(budget, most):
            break
        rest = min(budget, most, max(1, 2 * rest))
    if top < goal and budget > most:
        best = _exchanged(counts, best, goal - top)
    return best


def word_counts(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``_id, _source, _hash, _size`` of each row; ``_hash`` is a 64-bit hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, "_text"):
                sizes = [len(t.split()) for t in texts_of(part.column("_text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_id", "_source", "_hash")), pa.array(sizes, pa.int64())], names=["_id", "_source", "_hash", "_size"],
                )

    schema = T.StructType(
        [
            T.StructField("_id", df.schema[id_col].dataType), T.StructField("_source", T.StringType()), T.StructField("_hash", T.LongType()),
            T.StructField("_size", T.LongType()),
        ]
    )
    cols = [
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), text_hash(F.col(text_col)).alias("_hash"),
        F.col(text_col).cast("string").alias("_text"),
    ]
    return df.select(*cols).mapInArrow(run, schema)


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """``_source, source_size, target`` of each source; the driver sees three sums a round and no sources.

    A target is least(weight x rate, repeats x size). The rate that spends the whole total is found by sharing what the
    capped sources leave again and again until none is above its cap.
    """
    by = sizes.groupBy("_source").agg(F.sum("_size").alias("source_size"))
    ranked = with_row_axis(by, [F.asc_nulls_last("_source")], "rank")
    weight = F.element_at(F.lit(list(weights)).cast("array<double>"), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight), "sources").withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    rate, whole = 0.0, None
    while True:
        capped = F.col("cap") <= F.col("weight") * F.lit(rate)
        row = ranked.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("spent"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        whole = total * (row["all"] or 0)
        new = (whole - (row["spent"] or 0.0)) / row["weight"] if row["weight"] else rate
        if not new > rate:
            break
        rate = new
    return ranked.select("_source", "source_size", F.least(F.col("weight") * F.lit(rate), F.col("cap")).alias("target"))


def _mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights, total: float, repeats: int, seed: int) -> DataFrame:
    sizes = stage(word_counts(df, id_col, text_col, source_col), "sizes").withColumn("_name", row_key(F.col("_source")))
    targets = source_targets(sizes, weights, total, repeats).withColumn("_name", row_key(F.col("_source"))).drop("_source")
    cells = sizes.groupBy("_name", "_size").agg(F.count(F.lit(1)).alias("n"))

    def fit(key, hist: pd.DataFrame, goal: pd.DataFrame) -> pd.DataFrame:
        if hist.empty or goal.empty:
            return pd.DataFrame({"_name": [], "_size": [], "n": [], "passes": [], "more": [], "source_size": [], "target": []})
        size, target = int(goal["source_size"].iloc[0]), float(goal["target"].iloc[0])
        passes = min(repeats, int(target // size)) if size else 0
        budget = round(target) - passes * size if passes < repeats else 0
        more = fit_budget(dict(zip(hist["_size"].tolist(), hist["n"].tolist(), strict=True)), max(0, budget))
        return hist.assign(passes=passes, more=[more.get(k, 0) for k in hist["_size"].tolist()], source_size=size, target=target)

    plan = cells.groupBy("_name").cogroup(targets.groupBy("_name")).applyInPandas(
        fit, "_name string, _size long, n long, passes int, more long, source_size long, target double",
    )
    plan = stage(plan.withColumn("buckets", F.ceil(F.sqrt("n")).cast("long")), "plan")

    # A length that many documents share is cut into about sqrt(n) buckets by hash: whole buckets are taken in order, and
    # only the one in which the count runs out has its documents numbered.
    order = F.xxhash64("_id", F.lit(seed))
    rows = stage(
        join_sized(sizes, plan, ["_name", "_size"], "inner").withColumn("_h", order).withColumn("_b", F.pmod(F.col("_h"), F.col("buckets"))), "dealt",
    )
    counted = rows.groupBy("_name", "_size", "_b").agg(F.count(F.lit(1)).alias("c"))
    through = F.sum("c").over(Window.partitionBy("_name", "_size").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    before = stage(counted.withColumn("_before", through - F.col("c")).drop("c"), "before")
    placed = rows.join(before.hint("merge"), ["_name", "_size", "_b"])
    nth = F.row_number().over(Window.partitionBy("_name", "_size", "_b").orderBy("_h", "_id"))
    chosen = (F.col("_before") + nth <= F.col("more")).cast("long")
    return placed.withColumn("_copies", F.col("passes") + chosen)


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, total: float = TOTAL,
    repeats: int = REPEATS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row.

    Size counts words (a null text has none). Sources by code point, null last as a source of its own, weigh ``weights``
    in turn and share ``total`` times all sizes; a target stops at ``repeats`` times its source's size. A document is taken
    whole, up to ``repeats`` times. Documents without words and sources without words take nothing. Equal hashes of
    repeated ids fall together; reruns on the same rows agree. An empty table gives no rows.
    """
    out = _mix(df, id_col, text_col, source_col, weights, total, repeats, seed)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, all columns, each as often as the mix takes it.

    Rows that repeat id, text and source are one document that comes out as often as the mix takes them together, in the
    columns of any of them. Documents without words (a null text is one) add no words and come out once for each row. A null
    source is a source of its own, a null id an id like others. An empty table gives no rows.
    """
    settings = {"weights": WEIGHTS, "total": TOTAL, "repeats": REPEATS, "seed": SEED} | options
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.col("_copies"))
    on = ["_key", "_name", "_hash"]
    plan = _mix(df, id_col, text_col, source_col, **settings).withColumns({"_key": row_key(F.col("_id")), "_copies": copies})
    plan = stage(
        plan.groupBy(*on).agg(F.sum("_copies").cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0"), "copies",
    )
    names = df.columns
    at = {c: F.col(f"c{names.index(c)}") for c in (id_col, text_col, source_col)}
    plain = df.toDF(*(f"c{i}" for i in range(len(names)))).withColumns(
        {"_key": row_key(at[id_col]), "_name": row_key(at[source_col]), "_hash": text_hash(at[text_col])}
    )
    if plan.filter("_rows > 1").take(1):
        plain = plain.dropDuplicates(on)
    met = plain.join(plan.hint("merge"), on)
    return met.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
