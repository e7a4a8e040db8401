"""Near copies by similarity of word shingles: wide SimHash, pigeonhole blocks, Hamming distance, then the shingle sets.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked. A fingerprint of 128 bits is
split into blocks, again and again under seeded orders of its bits; rows meet on equal blocks and their Hamming distance is
verified. Two texts that differ in fewer bits than one order has blocks share a block for sure; the number of orders is
chosen so that of pairs at the least similarity, with a standard deviation more than their expected differing bits,
``RECALL`` do. Blocks get wider with the number of texts.

What is near by fingerprint is joined to families, and within a family every link is decided by the shingle sets themselves.
Neither step gives out pairs: a task keeps a spanning forest of the links that it finds, so copies of one text cost no more
rows than they are, and no link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import free, join_sized, remove_rows, row_key, row_runs, stage, text_hash, texts_of
from axistab.llm.simhash import CHUNK, components, majority, shingles

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.97
BITS, SEED = 128, 5
#: Groups up to this size are compared together, larger ones member by member.
SMALL = 64
#: Shingles of a family, or of a chunk of a larger one, that one task holds.
HELD = 4 << 20


def differing_share(similarity: float) -> float:
    """Expected share of differing fingerprint bits of two sets of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bit_limit(similarity: float = SIMILARITY) -> int:
    """The most differing bits of a pair that is compared: the expected number and 3.7 standard deviations."""
    p = differing_share(similarity)
    return math.floor(BITS * p + 3.7 * math.sqrt(BITS * p * (1 - p)))


def wide_fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """Majority bits of the XXH3-128 of the distinct word shingles; zeros without words."""
    digest, parts = xxhash.xxh3_128_digest, set(shingles(text, shingle))
    return majority([digest(p) for p in parts]) if parts else bytes(BITS // 8)


def block_masks(count: int, similarity: float = SIMILARITY, recall: float = RECALL) -> list[tuple[int, int]]:
    """Signed masks of the blocks (upper and lower 64 bits) for ``count`` fingerprints: about 32 share a block by chance."""
    width, p = max(8, math.ceil(math.log2(max(count, 2))) - 5), differing_share(similarity)
    number = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p - math.sqrt(p * (1 - p) / BITS)) ** width))
    rng, out = np.random.default_rng(SEED), []
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    while len(out) < number:
        order = rng.permutation(BITS).tolist()
        for at in range(0, BITS - width + 1, width):
            mask = sum(1 << b for b in order[at : at + width])
            out.append((signed(mask >> 64), signed(mask & ((1 << 64) - 1))))
    return out[:number]


def wide_fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``_id, _key, _hash, _a, _b`` of each row: the fingerprint's upper and lower half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, "_text"):
                prints = b"".join(wide_fingerprint(t, shingle) for t in texts_of(part.column("_text")))
                halves = np.frombuffer(prints, ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("_id", "_key", "_hash")), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                    names=["_id", "_key", "_hash", "_a", "_b"],
                )

    longs = [T.StructField(n, T.LongType()) for n in ("_hash", "_a", "_b")]
    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_key", T.StringType()), *longs])
    text = F.col(text_col).cast("string")
    return df.select(
        F.col(id_col).alias("_id"), row_key(F.col(id_col)).alias("_key"), text.alias("_text"), text_hash(text).alias("_hash"),
    ).mapInArrow(run, schema)


def _close(group: np.ndarray, halves: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``i, j`` and distance of the pairs within ``limit`` bits in runs of equal ``group``."""
    apart = lambda i, j: np.bitwise_count(halves[i] ^ halves[j]).sum(axis=-1, dtype=np.int64)
    stop = np.searchsorted(group, group, side="right")
    start = np.searchsorted(group, group, side="left")
    found = []
    left, step = np.flatnonzero((stop - start <= SMALL) & (stop - start > 1)), 1
    while len(left):
        left = left[left + step < stop[left]]
        d = apart(left, left + step)
        near = d <= limit
        found.append((left[near], left[near] + step, d[near]))
        step += 1
    for lo in np.unique(start[stop - start > SMALL]).tolist():
        for i in range(lo, stop[lo] - 1):
            j = np.arange(i + 1, stop[lo])
            d = apart(i, j)
            near = d <= limit
            found.append((np.full(int(near.sum()), i), j[near], d[near]))
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


class Forest:
    """Which items are joined already; ``join`` tells whether a link is the first between two trees."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x, y) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[a] = b
        return a != b


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """A partition sorted by ``keys``, cut so that no run of equal keys is cut apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.all([batch.column(k).to_numpy(zero_copy_only=False) == batch.column(k)[batch.num_rows - 1].as_py() for k in keys], axis=0)
        first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if first == 0 and held and all(held[-1].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in keys):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, first)], batch.schema)
        held = [batch.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


def _near(limit: int):
    """``a, b, c, d``: links between fingerprints ``_a, _b`` of equal ``key`` within ``limit`` bits, a spanning forest a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for part in _runs(batches, ["key"]):
            key, *halves = (part.column(c).to_numpy() for c in ("key", "_a", "_b"))
            both = np.stack(halves, axis=1).view(np.uint64)
            i, j, _ = _close(np.cumsum(np.r_[True, key[1:] != key[:-1]])[: len(key)], both, limit)
            ends = zip(zip(*(h[i].tolist() for h in halves), strict=True), zip(*(h[j].tolist() for h in halves), strict=True), strict=True)
            links = [(*x, *y) for x, y in ends if x != y and forest.join(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(4)], names=["a", "b", "c", "d"])

    return run


def _dealt(keys: DataFrame, sizes: DataFrame, on: str, by: list[str]) -> DataFrame:
    """``keys`` with those of ``sizes`` (``on``, ``chunks``) dealt as pairs of chunks: ``pair`` tells them apart, 0 for others."""
    met = join_sized(keys, sizes, [on], "left")
    own = F.pmod(F.xxhash64(*by), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j))
    return met.withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs))).drop("chunks")


def dealt_blocks(prints: DataFrame, masks: list[tuple[int, int]], chunk: int = CHUNK) -> DataFrame:
    """``_a, _b, key``: each fingerprint in each of its blocks; fingerprints of one ``key`` are to be compared.

    A block of over ``chunk`` fingerprints is dealt as pairs of chunks, so about two chunks have one key. Blocks are counted
    exactly, combined before the shuffle: a block with any share of all rows is one row a task, and none is missed.
    """
    block = lambda i, m: F.xxhash64(F.lit(i), F.col("_a").bitwiseAND(F.lit(m[0])), F.col("_b").bitwiseAND(F.lit(m[1])))
    keys = prints.select("_a", "_b", F.explode(F.array(*(block(i, m) for i, m in enumerate(masks)))).alias("key"))
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > chunk)
    large = stage(often.select("key", F.ceil(F.col("n") / chunk).alias("chunks")), "crowded")
    if not large.take(1):
        return keys
    return _dealt(keys, large, "key", ["_a", "_b"]).select(
        "_a", "_b", F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("key"),
    )


def near_links(prints: DataFrame, masks: list[tuple[int, int]], limit: int, chunk: int = CHUNK) -> DataFrame:
    """``a, b, c, d``: links between fingerprints (``_a, _b``: halves of distinct ones) that connect what is near by blocks."""
    dealt = dealt_blocks(prints, masks, chunk)
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_near(limit), "a long, b long, c long, d long").distinct()


def _hashes(shingle: int):
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, "_text", 1 << 20):
                sets = [
                    np.unique(np.array([digest(p) for p in shingles(t, shingle)], np.uint64)).view(np.int64) for t in texts_of(part.column("_text"))
                ]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["node", "set"],
                )

    return run


def linked_sets(starts: np.ndarray, values: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (``values`` from ``starts[i]`` to ``starts[i + 1]``), each a distinct value once."""
    sizes, n = np.diff(starts), len(starts) - 1
    ids = np.unique(values, return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    first = np.searchsorted(ids[order], np.arange(int(ids.max(initial=-1)) + 2))
    left, out = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo and left.any():
            i = todo.pop()
            own = ids[starts[i] : starts[i + 1]]
            lens = first[own + 1] - first[own]
            places = np.repeat(first[own] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(int(lens.sum())) if len(own) else own
            both = np.bincount(owner[places], minlength=n)
            near = np.flatnonzero(left & (both > 0) & (both >= similarity * (sizes[i] + sizes - both)))
            out += [(root, int(j)) for j in near]
            left[near] = False
            todo += near.tolist()
    return out


def _verified(similarity: float):
    """``a, b``: links between the ``node`` of each run of equal ``rep`` and ``pair``, by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches, ["rep", "pair"]):
            part = part.combine_chunks()
            rep, pair, node = (part.column(c).to_numpy() for c in ("rep", "pair", "node"))
            column = part.column("set").combine_chunks() if part.num_rows else None
            if column is None:
                continue
            ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
            values = column.flatten().to_numpy()
            new = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (pair[1:] != pair[:-1])])
            links = []
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(rep)], strict=True):
                links += [(lo + i, lo + j) for i, j in linked_sets(ends[lo : hi + 1] - ends[lo], values[ends[lo] : ends[hi]], similarity)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[[x[k] for x in links]] if links else np.zeros(0, np.int64)) for k in (0, 1)], names=["a", "b"],
            )

    return run


def similar_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL,
    chunk: int = CHUNK, held: int = HELD,
) -> DataFrame:
    """``_id, _key, _hash, _n, _first``: each id and text of ``df``, how often it occurs, and whether it leads its group.

    Groups are connected over links of ``similarity`` or more; the smallest id leads (a null id last, then by text hash).
    Texts of one fingerprint are one. Null and empty texts, which have no shingles, are one group; texts with fewer than
    ``shingle`` words have one shingle. An empty table gives no rows.
    """
    docs = stage(wide_fingerprints(df, id_col, text_col, shingle), "fingerprints")
    lead = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_hash").alias("h"), F.col("_key").alias("k"))
    distinct = docs.groupBy("_a", "_b").agg(F.min(lead).alias("lead"))
    nodes = stage(
        distinct.select(F.xxhash64("_a", "_b").alias("node"), "_a", "_b", "lead", F.col("lead.k").alias("_key"), F.col("lead.h").alias("_hash")),
        "nodes",
    )

    near = near_links(nodes.select("_a", "_b"), block_masks(nodes.count(), similarity, recall), bit_limit(similarity), chunk)
    families = components(near.select(F.xxhash64("a", "b").alias("a"), F.xxhash64("c", "d").alias("b")))
    wanted = stage(families.join(nodes.hint("merge"), "node").select("node", "rep", "_key", "_hash"), "wanted")
    texts = df.select(row_key(F.col(id_col)).alias("_key"), text_hash(F.col(text_col)).alias("_hash"), F.col(text_col).cast("string").alias("_text"))
    some = join_sized(
        texts, wanted.drop("rep"), ["_key", "_hash"], "inner",
    ).select("node", "_text").mapInArrow(_hashes(shingle), "node long, set array<long>")
    sets = some.groupBy("node").agg(F.any_value("set").alias("set")).join(wanted.select("node", "rep").hint("merge"), "node")
    sets = stage(sets, "sets")
    sizes = sets.groupBy("rep").agg(F.sum(F.size("set")).alias("n")).filter(F.col("n") > held)
    dealt = _dealt(sets, stage(sizes.select("rep", F.ceil(F.col("n") / held).alias("chunks")), "large"), "rep", ["node"])
    dealt = dealt.select("rep", "pair", "node", "set").repartition("rep", "pair").sortWithinPartitions("rep", "pair")
    reps = components(dealt.mapInArrow(_verified(similarity), "a long, b long"))
    free(sets)

    of = nodes.join(reps.hint("merge"), "node", "left").withColumn("rep", F.coalesce("rep", "node"))
    leads = of.groupBy("rep").agg(F.min("lead").alias("best"))
    best = stage(of.join(leads.hint("merge"), "rep").select("_a", "_b", F.col("best.k").alias("bk"), F.col("best.h").alias("bh")), "leads")
    members = docs.groupBy("_id", "_key", "_hash", "_a", "_b").agg(F.count(F.lit(1)).alias("_n")).join(best.hint("merge"), ["_a", "_b"])
    return members.select("_id", "_key", "_hash", "_n", ((F.col("_key") == F.col("bk")) & (F.col("_hash") == F.col("bh"))).alias("_first"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, that lead their group of ``similar_groups``.

    A row is told by its id and text, so rows that share an id (or have none) but not their texts are judged apart; of rows
    with equal id and text one stays. An empty table gives no rows.
    """
    names = df.columns
    groups = stage(similar_groups(df, id_col, text_col, **options), "groups")
    dropped, repeated = groups.filter("not _first").select("_key", "_hash"), groups.filter("_first and _n > 1").select("_key", "_hash")
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return remove_rows(plain, f"c{names.index(id_col)}", f"c{names.index(text_col)}", dropped, repeated).toDF(*names)
