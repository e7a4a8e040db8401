"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt out to shards of equal length make-up. Every shard is evolved on several islands,
each a task of its own: crossover injects whole well-filled bins of one parent into the other, drops the bins that hold
duplicates and best-fits the documents displaced. The islands start from unlike packings (best fit and completed bins).
Between epochs each island's elite migrates to the next island of the shard through a shuffle. An island whose best packing
meets the lower bound stops. Bins that stay under-filled are opened again and their pieces, of all shards together, are dealt
and evolved anew, level by level, until one shard holds them all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import row_runs, rows_of, stage, texts_of

CAPACITY, END, SPECIAL = 1024, 2, "<|endoftext|>"
SHARD, ISLANDS, EPOCHS, POPULATION, GENERATIONS, SEED = 4096, 2, 2, 4, 24, 7
#: Islands of a task where there are more than 4,000 tasks' worth of them.
STATES = 64
#: Share of a shard's bins, the least filled ones, whose pieces go to the next level.
REOPENED = 1 / 8
#: Words whose ids a worker remembers.
REMEMBERED = 400_000


class Encoder:
    """Ids of whole texts as little-endian 32-bit blobs, equal to those of the tokenizer file.

    Byte-level BPE never merges over a word's start, so the ids of ``" word"`` are remembered and joined. Texts in which a
    space stands before other white space or the end are encoded whole. ``special`` becomes its own id, as the file says.
    """

    def __init__(self, ranks_path: str, pattern: str, special_id: int):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = np.array([special_id], "<u4").tobytes()
        self.odd = re.compile(r" (?=\s|\Z)")
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return self.special.join(self._plain(t) for t in text.split(SPECIAL)) if SPECIAL in text else self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self.odd.search(text):
            return np.array(self.encode(text), "<u4").tobytes()
        first, *words = text.split(" ")
        out = [np.array(self.encode(first), "<u4").tobytes()]
        known = self.known
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = np.array(self.encode(" " + word), "<u4").tobytes()
                if len(word) < 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(ranks_path: str, pattern: str, special_id: int) -> Encoder:
    """One encoder a worker and file."""
    key = (ranks_path, pattern, special_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(
    df: DataFrame, tokenizer: tuple[str, str, int], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
) -> DataFrame:
    """``_id, piece, start, length, crc`` of each piece of each row."""
    names, mark = ("_id", "piece", "start", "length", "crc"), np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(*tokenizer).ids
        for batch in batches:
            for part in row_runs(batch, "_text"):
                rows = []
                for i, text in enumerate(texts_of(part.column("_text"))):
                    blob = ids_of(text.decode("utf-8", "replace")) + mark
                    rows += [(i, k, s, n, zlib.crc32(blob[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(blob) // 4, capacity))]
                at, *cols = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    names=list(names),
                )

    schema = T.StructType(
        [
            T.StructField("_id", df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
            *(T.StructField(n, T.LongType()) for n in names[2:]),
        ]
    )
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def best_fit(lengths: list[int], order: list[int], bins: np.ndarray, fills: list[int], capacity: int) -> None:
    """Put the items of ``order`` where they leave the least room; ``bins`` (of each item) and ``fills`` change."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, f in enumerate(fills):
        room[capacity - f].append(b)
        mask |= 1 << (capacity - f)
    for item in order:
        n = lengths[item]
        fitting = mask >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(fills)
            fills.append(0)
        bins[item] = b
        fills[b] += n
        room[free - n].append(b)
        mask |= 1 << (free - n)


def fresh(lengths: list[int], rng: np.random.Generator, noise: float, capacity: int) -> np.ndarray:
    """Best fit over items by falling length, disturbed by ``noise``."""
    order = np.argsort(-(np.array(lengths) * (1 + noise * rng.standard_normal(len(lengths)))), kind="stable")
    bins = np.zeros(len(lengths), np.int32)
    best_fit(lengths, order.tolist(), bins, [], capacity)
    return bins


def completed(lengths: list[int], capacity: int) -> np.ndarray:
    """Bin after bin: the longest item, then the one or two items that fill what is left to the end, or the longest that fits."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(n, []).append(i)
    have = np.zeros(capacity + 1, np.int32)
    for n, items in by.items():
        have[n] = len(items)
    bins, bin_of, left = np.zeros(len(lengths), np.int32), -1, 0
    top, lowest = max(by, default=0), min(by, default=capacity + 1)

    def put(n: int) -> None:
        bins[by[n].pop()] = bin_of
        have[n] -= 1

    for _ in range(len(lengths)):
        while top and not have[top]:
            top -= 1
        if not top:
            break
        bin_of, left = bin_of + 1, capacity - top
        put(top)
        while left >= lowest:
            if have[left]:
                put(left)
                break
            half = left // 2
            pair = np.flatnonzero((have[1 : half + 1] > 0) & (have[left - half : left][::-1] > 0)) + 1
            pair = [a for a in pair[:2].tolist() if 2 * a < left or have[a] > 1]
            if pair:
                put(pair[0])
                put(left - pair[0])
                break
            fit = np.flatnonzero(have[: left + 1])
            if not len(fit):
                break
            put(int(fit[-1]))
            left -= int(fit[-1])
    return bins


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """(number of bins, minus the mean squared fill): less is better."""
    fill = np.bincount(bins, weights=lengths)
    return len(fill), -float(((fill / capacity) ** 2).mean()) if len(fill) else 0.0


def rebuilt(bins: np.ndarray, displaced: np.ndarray, lengths: np.ndarray, plain: list[int], capacity: int) -> np.ndarray:
    """``bins`` renumbered without empty ones after best-fitting the displaced items (bin -1)."""
    held = bins >= 0
    out = np.full(len(bins), -1, np.int32)
    out[held] = np.unique(bins[held], return_inverse=True)[1]
    fills = np.bincount(out[held], weights=lengths[held]).astype(np.int64).tolist() if held.any() else []
    best_fit(plain, displaced[np.argsort(-lengths[displaced], kind="stable")].tolist(), out, fills, capacity)
    return out


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, plain: list[int], rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child of ``a`` with whole well-filled bins of ``b``: bins of ``a`` that hold their items go, the rest best-fits."""
    fill = np.bincount(b, weights=lengths)
    well = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(well, max(1, len(well) // 3), replace=False)] = True
    injected = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[injected]] = True
    displaced = hit[a] & ~injected
    child = np.where(displaced, -1, a)
    child[injected] = int(a.max()) + 1 + b[injected]
    return rebuilt(child, np.flatnonzero(displaced), lengths, plain, capacity)


def mutate(a: np.ndarray, lengths: np.ndarray, plain: list[int], rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Empties the worst-filled bins and some others and best-fits their items."""
    fill = np.bincount(a, weights=lengths)
    gone = np.zeros(len(fill), bool)
    gone[np.argsort(fill, kind="stable")[: max(1, len(fill) // 50)]] = True
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    out = np.where(gone[a], -1, a)
    return rebuilt(out, np.flatnonzero(gone[a]), lengths, plain, capacity)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the number of items over half a bin."""
    return max(-(-int(lengths.sum()) // capacity), int((lengths * 2 > capacity).sum()))


def evolve(
    lengths: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, size: int = POPULATION, generations: int = GENERATIONS,
    capacity: int = CAPACITY, island: int = 0,
) -> list[np.ndarray]:
    """The next epoch's population, best first. Without one it starts from best fit; ``island`` 1 from completed bins as well."""
    plain, least = lengths.tolist(), lower_bound(lengths, capacity)
    rank = lambda x: fitness(x, lengths, capacity)
    if not population:
        population = [fresh(plain, rng, 0.0, capacity)]
        if rank(population[0])[0] > least:
            population += [completed(plain, capacity)] if island % 2 else []
            population += [fresh(plain, rng, 0.03 * (i + 1), capacity) for i in range(size - len(population))]
    scored = sorted(((rank(x), i, x) for i, x in enumerate(population)), key=lambda s: s[:2])[:size]
    for turn in range(generations):
        if scored[0][0][0] <= least or len(scored) < 2:
            break
        i, j = rng.choice(len(scored), 2, replace=False)
        child = crossover(scored[i][2], scored[j][2], lengths, plain, rng, capacity)
        child = mutate(child, lengths, plain, rng, capacity) if turn % 2 else child
        scored = sorted([*scored, (rank(child), size + turn, child)], key=lambda s: s[:2])[:size]
    return [x for _, _, x in scored]


def _epoch(turn: int, seed: int, capacity: int, size: int, generations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
            given = [np.frombuffer(p, np.int32) for p in [*row["population"], *([row["elite"]] if row["elite"] else [])]]
            rng = np.random.default_rng([seed, turn, row["shard"], row["island"]])
            best = evolve(lengths, given, rng, size, generations, capacity, row["island"])
            count, fill = fitness(best[0], lengths, capacity)
            row |= {
                "population": [x.astype(np.int32).tobytes() for x in best], "elite": None, "bins": count, "fill": fill,
                "done": count <= lower_bound(lengths, capacity),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_STATE)

    return run


_STATE = pa.schema(
    [
        ("shard", pa.int64()), ("island", pa.int32()), ("uids", pa.binary()), ("lengths", pa.binary()), ("population", pa.list_(pa.binary())),
        ("elite", pa.binary()), ("bins", pa.int64()), ("fill", pa.float64()), ("done", pa.bool_()),
    ]
)
_STATE_SQL = "shard long, island int, uids binary, lengths binary, population array<binary>, elite binary, bins long, fill double, done boolean"


def shard_items(items: DataFrame, shard: int) -> tuple[DataFrame, int, dict[int, int]]:
    """Items ``uid, length, part`` dealt to shards so that each has the same share of every length; with the number of shards
    and of items by length.

    Items are numbered by length and, within a length, by part; counts of (length, part) give every part its first number.
    """
    counts = stage(items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    number = max(1, -(-sum(by_length.values()) // shard))
    at, first = 0, {}
    for n in sorted(by_length, reverse=True):
        first[n], at = at, at + by_length[n]
    starts = F.element_at(F.lit([first.get(i, 0) for i in range(1, max(first, default=1) + 1)]).cast("array<bigint>"), F.col("length").cast("int"))
    through = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_first", starts + through - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("uid"))
    return items.join(placed.hint("merge"), ["length", "part"]).select(
        "uid", "length", F.pmod(F.col("_first") + nth - 1, F.lit(number)).alias("shard"),
    ), number, by_length


def _gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "uid"], ascending=[False, True])
    return pd.DataFrame(
        {
            "shard": [int(pdf["shard"].iloc[0])], "uids": [pdf["uid"].to_numpy(np.int64).tobytes()],
            "lengths": [pdf["length"].to_numpy(np.int32).tobytes()],
        }
    )


def _evolved(items: DataFrame, number: int, capacity: int, islands: int, epochs: int, population: int, generations: int, seed: int) -> DataFrame:
    """``shard, bins, uids, lengths, chosen``: the best packing of each shard after all epochs."""
    states = number * islands
    tasks = max(items.sparkSession.sparkContext.defaultParallelism, min(states, 4000), states // STATES)
    shards = items.groupBy("shard").applyInPandas(_gathered, "shard long, uids binary, lengths binary")
    nothing = {
        "population": F.array().cast("array<binary>"), "elite": F.lit(None).cast("binary"), "bins": F.lit(0).cast("long"), "fill": F.lit(0.0),
        "done": F.lit(False),
    }
    state = shards.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumns(nothing).select(*_STATE.names)
    for turn in range(epochs):
        if turn:
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.element_at("population", 1).alias("elite"))
            state = state.drop("elite").join(elites.hint("merge"), ["shard", "island"]).select(*_STATE.names)
        state = stage(
            state.repartition(tasks, "shard", "island").mapInArrow(_epoch(turn, seed, capacity, population, generations), _STATE_SQL), "islands",
        )
    best = state.groupBy("shard").agg(
        F.min(F.struct("bins", "fill", "island", "uids", "lengths", F.element_at("population", 1).alias("chosen"))).alias("b")
    )
    return best.select("shard", "b.bins", "b.uids", "b.lengths", "b.chosen")


def _placed(level: int, reopened: float, capacity: int):
    """Places of the items of each shard; those of the least filled bins, a share ``reopened``, have no sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            uids, lengths, bins = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["chosen"], np.int32)
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            new = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, bool)
            offsets = ends - lengths[order]
            offsets -= offsets[new][np.cumsum(new) - 1] if len(order) else 0
            sequence = (level << 56) + row["shard"] * (1 << 24) + bins[order].astype(np.int64)
            fill = np.bincount(bins, weights=lengths)
            again = np.zeros(len(fill), bool)
            again[np.argsort(fill, kind="stable")[: math.ceil(len(fill) * reopened)]] = True
            again = (again & (fill < capacity))[bins[order]]
            cols = [pa.array(uids[order]), pa.array(lengths[order]), pa.array(sequence, mask=again), pa.array(offsets)]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "length", "sequence_id", "offset"])

    return run


def packed_items(
    items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION,
    generations: int = GENERATIONS, seed: int = SEED, reopened: float = REOPENED,
) -> DataFrame:
    """``uid, sequence_id, offset`` of the items ``uid, length, part`` shorter than a sequence; each exactly once.

    While there are several shards and more bins than the lower bound of all items together, the pieces of each shard's least
    filled bins go to the next level, at most a share ``reopened`` of the bins each time.
    """
    out, level = None, 0
    while True:
        dealt, number, by_length = shard_items(items, shard)
        best = stage(_evolved(dealt, number, capacity, islands, epochs, population, generations, seed + level), "best")
        least = max(-(-sum(k * n for k, n in by_length.items()) // capacity), sum(n for k, n in by_length.items() if 2 * k > capacity))
        last = number == 1 or (best.agg(F.sum("bins")).first()[0] or 0) <= least
        placed = best.mapInArrow(_placed(level, 0.0 if last else reopened, capacity), "uid long, length long, sequence_id long, offset long")
        placed = placed if last else stage(placed, "placed")
        done = placed.filter("sequence_id is not null").select("uid", "sequence_id", "offset")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        items = placed.filter("sequence_id is null").select(
            "uid", "length", F.pmod(F.xxhash64("uid"), F.lit(64).cast("long")).cast("int").alias("part"),
        )
        level += 1


def pack(
    df: DataFrame, tokenizer: tuple[str, str, int], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END,
    **options,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of each piece of each row.

    ``tokenizer``: path of the ranks file, split pattern and id of the special string; ``options``: those of ``packed_items``.
    A null text is empty and has the end id alone. Pieces of full length are sequences of their own; the others are packed by
    the genetic algorithm, and each comes out exactly once. Repeated rows are documents of their own; other columns are not
    read; an empty table gives no rows.
    """
    tagged = token_pieces(df, tokenizer, id_col, text_col, capacity, end).withColumns(
        {"uid": F.monotonically_increasing_id(), "part": F.spark_partition_id()}
    )
    pieces = stage(tagged, "pieces")
    where = packed_items(pieces.filter(F.col("length") < capacity).select("uid", "length", "part"), capacity, **options)
    full = pieces.filter(F.col("length") == capacity).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    met = pieces.filter(F.col("length") < capacity).join(where.hint("merge"), "uid")
    out = met.select("_id", "piece", "start", "length", "crc", "sequence_id", "offset").unionByName(
        full.select("_id", "piece", "start", "length", "crc", "sequence_id", "offset")
    )
    return out.select(F.col("_id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
