"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into ``distance + shared`` blocks; two fingerprints that differ in at most ``distance``
bits agree on at least ``shared`` of them. Fingerprints meet on every choice of ``shared`` blocks and their Hamming
distance is verified. ``shared`` grows with the logarithm of their number, so that blocks stay selective. Blocks that
many fingerprints share are split into pairs of chunks, and within a block links come out as a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.llm.common import free, join_sized, row_runs, stage, texts_of

SHINGLE, DISTANCE = 4, 4
#: Fingerprints of one block that one task compares; larger blocks are dealt out as pairs of chunks of this size.
CHUNK = 2048


def shingles(text: bytes, width: int) -> list[bytes]:
    """Runs of ``width`` words with A-Z lowered, a space between; the whole sequence if there are fewer; none without words."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def majority(digests: list[bytes]) -> bytes:
    """The bits that are set in over half of the digests."""
    hashes = np.frombuffer(b"".join(digests), np.uint8).reshape(len(digests), -1)
    return np.packbits(np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64) * 2 > len(digests)).tobytes()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed integer; 0 without words."""
    digest, parts = xxhash.xxh64_digest, shingles(text, shingle)
    return int.from_bytes(majority([digest(p, 42) for p in parts]), "big", signed=True) if parts else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``_id, _fp`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_runs(batch, "_text"):
                found = [fingerprint(t, shingle) for t in texts_of(part.column("_text"))]
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found, pa.int64())], names=["_id", "_fp"])

    schema = T.StructType([T.StructField("_id", df.schema[id_col].dataType), T.StructField("_fp", T.LongType())])
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def block_masks(shared: int, distance: int = DISTANCE) -> list[int]:
    """Signed masks of every choice of ``shared`` out of ``distance + shared`` blocks."""
    n = distance + shared
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in map(sum, combinations(blocks, shared))]


def shared_blocks(count: int, distance: int = DISTANCE) -> int:
    """The fewest shared blocks whose bits number at least log2(count) + 3."""
    return next((s for s in range(1, 9) if 64 * s / (distance + s) >= math.log2(max(count, 1)) + 3), 8)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints."""
    left, edges = np.arange(len(fps)), []
    while len(left) > 1:
        root, left, seen = left[0], left[1:], [left[0]]
        while seen and len(left):
            near = np.bitwise_count((fps[left][:, None] ^ fps[seen[:64]][None, :]).view(np.uint64)).min(axis=1) <= distance
            seen = [*seen[64:], *left[near].tolist()]
            edges += [(int(fps[root]), int(fps[x])) for x in left[near]]
            left = left[~near]
    return edges


def _links(distance: int):
    """Links within runs of equal keys; a partition comes sorted by key, a run may go on in the next batch."""

    def of(keys: list[np.ndarray], fps: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(fps), bool)
        if len(fps):
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        group = np.cumsum(new)
        size = np.bincount(group)[group] if len(fps) else group
        a, b = [], []
        small = np.flatnonzero(size <= 16)
        for step in range(1, 16):
            i, j = small[:-step], small[step:]
            pair = group[i] == group[j]
            if not pair.any():
                break
            i, j = i[pair], j[pair]
            near = (np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= distance) & (fps[i] != fps[j])
            a.append(fps[i[near]])
            b.append(fps[j[near]])
        for g in np.unique(group[size > 16]):
            lo, hi = np.searchsorted(group, [g, g + 1])
            edges = _forest(np.unique(fps[lo:hi]), distance)
            a.append(np.array([e[0] for e in edges], np.int64))
            b.append(np.array([e[1] for e in edges], np.int64))
        ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "pair", "_fp")]
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)] if held else cols
            last = np.any([k != k[-1] for k in cols[:3]], axis=0)
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield of([c[:cut] for c in cols[:3]], cols[3][:cut])
        if held:
            yield of(held[:3], held[3])

    return run


def near_links(fps: DataFrame, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """``a, b``: links that connect whatever distinct fingerprints ``_fp`` connect at ``distance`` bits or fewer."""
    masks = block_masks(shared_blocks(fps.count(), distance), distance)
    choice = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("_fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)))
    keys = fps.select("_fp", F.explode(choice).alias("m")).select("_fp", "m.mask", "m.key")
    counts = stage(keys.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "blocks")
    large = counts.filter(F.col("n") > chunk).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int"))
    met = join_sized(keys, large.select("mask", "key", "chunks"), ["mask", "key"], "left")
    own = F.pmod(F.xxhash64("_fp"), F.col("chunks").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j))
    dealt = met.withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
    # 16 rows of 20 bytes a fingerprint: about as many partitions as the session shuffles to, sorted so that blocks are runs.
    dealt = dealt.select("mask", "key", "pair", "_fp").repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair")
    return dealt.mapInArrow(_links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, rep`` of every node of the edges ``a, b``: one representative for each connected component.

    Randomised contraction: each round every node joins the neighbour (or itself) with the least hash of that round, and
    the edges are redrawn between what they joined. The number of nodes falls by a constant factor a round.
    """
    edges = stage(edges.filter("a <> b"), "edges")
    labels, turn = None, 0  # each round's tables go as soon as the next ones stand
    while True:
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("v"))
        joined = both.groupBy("node").agg(F.min(F.least(rank("node"), rank("other"))).alias("m")).select("node", F.col("m.v").alias("to"))
        joined = stage(joined, "joined")
        if labels is None:
            labels = stage(joined.select("node", F.col("to").alias("rep")), "labels")
        else:
            moved = labels.join(joined.select(F.col("node").alias("rep"), "to").hint("merge"), "rep", "left")
            before, labels = labels, stage(moved.select("node", F.coalesce("to", "rep").alias("rep")), "labels")
            free(before)
        ends = edges.join(joined.select(F.col("node").alias("a"), F.col("to").alias("x")).hint("merge"), "a")
        ends = ends.join(joined.select(F.col("node").alias("b"), F.col("to").alias("y")).hint("merge"), "b")
        before, edges = edges, stage(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        free(before, joined)
        if not edges.take(1):
            return labels
        turn += 1


def _first() -> Column:
    """Orders the rows of a group: smallest id, a null id last."""
    return F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))


def _groups(docs: DataFrame, distance: int) -> DataFrame:
    """``_fp, rep, first``: the component and the first row of each distinct fingerprint."""
    distinct = stage(docs.groupBy("_fp").agg(_first().alias("first")), "distinct")
    reps = components(near_links(distinct.select("_fp"), distance)).withColumnRenamed("node", "_fp")
    return stage(distinct.join(reps.hint("merge"), "_fp", "left").withColumn("rep", F.coalesce("rep", "_fp")), "reps")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Documents whose fingerprints differ in at most ``distance`` bits are linked; ``component_id`` is the smallest id
    reachable over links, itself included (null only if every id there is null). A null or empty text has fingerprint 0
    and is linked like any other. Equal fingerprints count once in the search, so copies cost nothing. Repeated rows come
    out as often as they come in; other columns are not read; an empty table gives no rows.
    """
    docs = stage(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    of = _groups(docs, distance)
    least = of.groupBy("rep").agg(F.min("first").alias("first")).select("rep", F.col("first.i").alias("component_id"))
    known = stage(of.select("_fp", "rep").join(least.hint("merge"), "rep").select("_fp", "component_id"), "component")
    out = docs.join(known.hint("merge"), "_fp")
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
