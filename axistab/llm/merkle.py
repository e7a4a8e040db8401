"""A Merkle manifest of a dataset as a postorder append log.

The rows of a tree, in order, are its leaves; every eight consecutive nodes have one parent. Nodes are logged in the order in
which they are completed: a parent right after its last child. So the place of each node follows from the number of leaves
alone (``position``). Builders work on aligned ranges of 4,096 leaves, whose nodes are one contiguous segment of the log;
their roots are the leaves of the next round's builders. A proof reads its siblings from its own segment and, above
it, from a few places of the log that it computes. The roots of all trees are the leaves of one last tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axistab.functions.expr import let
from axistab.llm.common import join_sized, row_key, stage
from axistab.operators.rows import with_row_axis

#: Children of a node, and levels that one builder completes.
FAN, LEVELS = 8, 4
#: Segments whose proofs one task extracts.
TASK = 4


def height(leaves: int) -> int:
    """Levels above the leaves."""
    out = 0
    while leaves > 1:
        leaves, out = -(-leaves // FAN), out + 1
    return out


def position(level: int, index: int, leaves: int) -> int:
    """Place in the log of node ``index`` of a level: it comes after all of its subtree and before the next leaf.

    With the leaf that completes it, all nodes up to its level that end there are logged, and of higher levels those that
    ended before.
    """
    end = min((index + 1) * FAN**level, leaves)
    return sum(-(-end // FAN**j) if j <= level else (end - 1) // FAN**j for j in range(height(leaves) + 1)) - 1


def combine(children: list[bytes]) -> bytes:
    """The hex digest of a node from those of its children."""
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def completed(leaves: list[bytes], first: int, size: int, levels: int) -> list[tuple[int, int, bytes]]:
    """(level, index, hex digest) of ``leaves``, from number ``first`` of ``size`` on, and of the nodes up to ``levels`` above them,
    in the order of their completion."""
    out, open_ = [], [[] for _ in range(levels + 1)]
    for at, leaf in enumerate(leaves, first + 1):
        out.append((0, at - 1, leaf))
        open_[0].append(leaf)
        for level in range(levels):
            if at % FAN ** (level + 1) and at < size:
                break
            node = combine(open_[level])
            open_[level] = []
            open_[level + 1].append(node)
            out.append((level + 1, (at - 1) // FAN ** (level + 1), node))
    return out


def digest_of(fields: list[Column]) -> Column:
    """Hex sha256 of the fields' texts: ``-`` for null, else bytes in UTF-8, a colon, the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


@dataclass(frozen=True)
class Log:
    """``segments``: a row for each builder of leaves with its ``nodes`` (32 bytes each) from place ``start`` on and what it carries;
    ``upper``: the nodes of level ``levels`` and more by place; ``roots``: tree, root."""

    segments: DataFrame
    upper: DataFrame
    roots: DataFrame
    levels: int

    def records(self) -> DataFrame:
        """The log: ``_tree, start, nodes``; the places of a tree's records follow on each other."""
        higher = self.upper.filter(F.col("_level") > self.levels).select("_tree", F.col("_pos").alias("start"), F.unhex("_digest").alias("nodes"))
        return self.segments.select("_tree", "start", "nodes").unionByName(higher)


def _built(leaves: DataFrame, carried: list[str], levels: int) -> DataFrame:
    """Segments of ``_tree, _at, _size, _digest`` (hex) with lists of what is ``carried``."""
    kinds = {c: leaves.schema[c].dataType for c in carried}

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        first, size = rows["_at"][0].as_py(), rows["_size"][0].as_py()
        made = completed([x.encode() for x in rows["_digest"].to_pylist()], first, size, min(levels, height(size)))
        lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows[c].combine_chunks()) for c in carried]
        return pa.Table.from_arrays(
            [
                rows["_tree"].slice(0, 1), pa.array([first // FAN**levels]), pa.array([size]), pa.array([position(0, first, size)]),
                pa.array([bytes.fromhex(b"".join(x for *_, x in made).decode())], pa.binary()), pa.array([made[-1][2].decode()]), *lists,
            ],
            names=["_tree", "_block", "_size", "start", "nodes", "_top", *carried],
        )

    schema = T.StructType(
        [
            T.StructField("_tree", T.StringType()), T.StructField("_block", T.LongType()), T.StructField("_size", T.LongType()),
            T.StructField("start", T.LongType()), T.StructField("nodes", T.BinaryType()), T.StructField("_top", T.StringType()),
            *(T.StructField(c, T.ArrayType(kinds[c])) for c in carried),
        ]
    )
    dealt = leaves.withColumn("_block", F.shiftright("_at", 3 * levels))
    return dealt.groupBy("_tree", "_block").applyInArrow(build, schema)


def _raised(tops: DataFrame, base: int, levels: int) -> DataFrame:
    """``_tree, _level, _pos, _digest, _index, _leaves`` of the nodes above the ``tops`` of level ``base``."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_at")
        tree, first, leaves = rows["_tree"][0].as_py(), rows["_at"][0].as_py(), rows["_leaves"][0].as_py()
        nodes = completed([x.encode() for x in rows["_digest"].to_pylist()], first, -(-leaves // FAN**base), min(levels, height(leaves) - base))
        above = [(base + level, i, d.decode()) for level, i, d in nodes if level]
        return pa.Table.from_arrays(
            [
                pa.array([tree] * len(above), pa.string()), pa.array([level for level, *_ in above], pa.int64()),
                pa.array([position(level, i, leaves) for level, i, _ in above], pa.int64()), pa.array([d for *_, d in above], pa.string()),
                pa.array([i for _, i, _ in above], pa.int64()), pa.array([leaves] * len(above), pa.int64()),
            ],
            names=["_tree", "_level", "_pos", "_digest", "_index", "_leaves"],
        )

    dealt = tops.withColumn("_block", F.shiftright("_at", 3 * levels))
    return dealt.groupBy("_tree", "_block").applyInArrow(build, "_tree string, _level long, _pos long, _digest string, _index long, _leaves long")


def _placed(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [position(level, i, n) for i, n in zip(batch.column("_index").to_pylist(), batch.column("_leaves").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, "_pos"])

    return run


def append_log(leaves: DataFrame, carried: list[str], levels: int = LEVELS) -> Log:
    """The log of the trees whose leaves are ``_tree, _at, _size, _digest``: a name, the leaf's number, the tree's leaves, hex."""
    segments = stage(_built(leaves, carried, levels), "segments")
    level, cols = levels, "_tree string, _digest string, _index long, _leaves long"
    tops = segments.select("_tree", F.col("_top").alias("_digest"), F.col("_block").alias("_index"), F.col("_size").alias("_leaves"))
    roots = tops.filter(F.col("_leaves") <= FAN**levels).select("_tree", F.col("_digest").alias("root"))
    tops = tops.filter(F.col("_leaves") > FAN**levels)
    upper = stage(tops.mapInArrow(_placed(level), cols + ", _pos long").withColumn("_level", F.lit(level).cast("long")), "nodes")
    parts, over = [upper], upper
    while over.take(1):
        made = stage(_raised(over.withColumnRenamed("_index", "_at"), level, levels), "nodes")
        level += levels
        parts.append(made)
        whole = F.col("_leaves") <= F.pow(F.lit(float(FAN)), F.col("_level"))
        roots = roots.unionByName(made.filter(whole).select("_tree", F.col("_digest").alias("root")))
        over = made.filter(~whole & (F.col("_level") == level))
    for part in parts[1:]:
        upper = upper.unionByName(part)
    return Log(segments, upper, stage(roots, "roots"), levels)


def _siblings_above(block: int, leaves: int, levels: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the siblings on the way from a segment's root to the tree's, level by level, left to right."""
    for level in range(levels, height(leaves)):
        own = block // FAN ** (level - levels)
        run = range(own // FAN * FAN, min(own // FAN * FAN + FAN, -(-leaves // FAN**level)))
        yield from ((level, i) for i in run if i != own)


def _wanted(levels: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``_tree, _block, _nth, _pos``: where the log has the siblings above a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, block, leaves in zip(*(batch.column(c).to_pylist() for c in ("_tree", "_block", "_size")), strict=True):
                rows += [(tree, block, nth, position(level, i, leaves)) for nth, (level, i) in enumerate(_siblings_above(block, leaves, levels))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["_tree", "_block", "_nth", "_pos"],
            )

    return run


def paths_of(
    nodes: bytes, block: int, leaves: int, start: int, above: bytes, levels: int = LEVELS,
) -> tuple[list[bytes], list[list[int]], list[list[int]]]:
    """For each leaf of a segment its siblings' digests up to the root, one after another, and of each level how many of them stand
    before and after its own node.

    Places in the segment follow from ``position``; what leaves have in common is put together once.
    """
    base, top = block * FAN**levels, min(levels, height(leaves))
    counts = [-(-leaves // FAN**level) for level in range(height(leaves))]
    before, after = [], []
    for level in range(levels, height(leaves)):
        own = block // FAN ** (level - levels)
        before.append(own % FAN)
        after.append(min(FAN, counts[level] - own // FAN * FAN) - own % FAN - 1)
    paths, left, right = [above], [before], [after]
    for level in range(top - 1, -1, -1):
        first = base // FAN**level
        last = min(first + FAN ** (levels - level), counts[level])
        found = []
        for run in range(first, last, FAN):
            own = [32 * (position(level, i, leaves) - start) for i in range(run, min(run + FAN, last))]
            found.append([nodes[at : at + 32] for at in own])
        paths = [b"".join(run[:k] + run[k + 1 :]) + paths[j] for j, run in enumerate(found) for k in range(len(run))]
        left = [[k, *left[j]] for j, run in enumerate(found) for k in range(len(run))]
        right = [[len(run) - k - 1, *right[j]] for j, run in enumerate(found) for k in range(len(run))]
    return paths, left, right


def proofs(log: Log, carried: list[str]) -> DataFrame:
    """``_tree``, what is ``carried``, ``leaf`` (hex), ``path`` (siblings, 32 bytes each), ``before`` and ``after`` of each level, of
    every leaf."""
    levels = log.levels
    asked = log.segments.filter(F.col("_size") > FAN**levels).select("_tree", "_block", "_size")
    wanted = asked.mapInArrow(_wanted(levels), "_tree string, _block long, _nth long, _pos long")
    met = wanted.join(log.upper.select("_tree", "_pos", "_digest").hint("merge"), ["_tree", "_pos"])
    packed = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "_digest"))), lambda x: x["_digest"])
    above = met.groupBy("_tree", "_block").agg(F.unhex(F.array_join(packed, "")).alias("_above"))
    both = log.segments.join(above.hint("merge"), ["_tree", "_block"], "left").select("_tree", "_block", "_size", "start", "nodes", "_above", *carried)
    kinds = [both.schema[c].dataType.elementType for c in carried]
    both = both.repartition(max(1, -(-log.segments.count() // TASK)), "_tree", "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tree, block, leaves, start, nodes, higher = (batch.column(c)[r].as_py() for c in ("_tree", "_block", "_size", "start", "nodes", "_above"))
                paths, before, after = paths_of(nodes, block, leaves, start, higher or b"", levels)
                places = (32 * (position(0, block * FAN**levels + i, leaves) - start) for i in range(len(paths)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(paths), pa.string()), *(batch.column(c)[r].values for c in carried),
                        pa.array([nodes[at : at + 32].hex() for at in places]), pa.array(paths, pa.binary()), pa.array(before, pa.list_(pa.int32())),
                        pa.array(after, pa.list_(pa.int32())),
                    ],
                    names=["_tree", *carried, "leaf", "path", "before", "after"],
                )

    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField("_tree", T.StringType()), *(T.StructField(c, k) for c, k in zip(carried, kinds, strict=True)),
            T.StructField("leaf", T.StringType()), T.StructField("path", T.BinaryType()), T.StructField("before", ints), T.StructField("after", ints),
        ]
    )
    return both.mapInArrow(run, schema)


def folded(leaf: Column, path: Column, before: Column, after: Column) -> Column:
    """The root that a leaf's hex digest and its siblings give."""

    def climbed(v: Column) -> Column:
        def up(held: Column, run: Column) -> Column:
            left, right = run["b"] * 64, run["a"] * 64
            parts = F.concat(F.substring(v["text"], held["at"], left), held["h"], F.substring(v["text"], held["at"] + left, right))
            return F.struct(F.sha2(parts, 256).alias("h"), (held["at"] + left + right).alias("at"))

        return F.aggregate(v["runs"], F.struct(v["leaf"].alias("h"), F.lit(1).alias("at")), up, lambda held: held["h"])

    return let({"text": F.lower(F.hex(path)), "leaf": leaf, "runs": F.arrays_zip(before.alias("b"), after.alias("a"))}, climbed)


@dataclass(frozen=True)
class Manifest:
    """``log`` of the trees, ``tops`` of the last tree over their roots, and what the proofs bring along."""

    log: Log
    tops: Log
    carried: tuple[str, ...]

    @property
    def root(self) -> DataFrame:
        return self.tops.roots.select("root")

    def proofs(self) -> DataFrame:
        """What is carried, ``leaf, subroot, root, path, before, after`` of each row, up to the root over all trees."""
        own = proofs(self.log, list(self.carried))
        last = proofs(self.tops, ["_name"]).join(F.broadcast(self.tops.roots), "_tree").select(
            F.col("_name").alias("_tree"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("_p"), F.col("before").alias("_b"),
            F.col("after").alias("_a"),
        )
        met = join_sized(own, stage(last, "subroots"), ["_tree"], "inner")
        return met.select(
            *self.carried, "leaf", "subroot", "root", F.concat("path", "_p").alias("path"), F.concat("before", "_b").alias("before"),
            F.concat("after", "_a").alias("after"),
        )


def manifest(df: DataFrame, fields: list[Column], tree: str = "lang", order: str = "doc_id", carried: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The append log of a dataset: a leaf for each row, the digest of ``fields``; a tree for each value of ``tree``, its leaves by
    rising ``order``.

    Nulls are values: a null tree is the first one, a null order comes first, a null field has its own code. Rows that repeat
    tree and order stand in the order of their digests. ``carried`` are narrow columns that the proofs bring along. Other
    columns are not read, whatever their names; an empty table has an empty log and no root. A builder completes ``levels`` levels.
    """
    carried = carried or {}
    rows = df.select(
        F.col(tree).cast("string").alias("_name"), F.col(order).alias("_order"), digest_of(fields).alias("_digest"),
        *(c.alias(n) for n, c in carried.items()),
    )
    by = [F.asc_nulls_first("_name"), F.asc_nulls_first("_order"), F.col("_digest")]
    placed = with_row_axis(stage(rows, "leaves"), by, "_row").withColumn("_tree", row_key(F.col("_name")))
    sizes = placed.groupBy("_tree", "_name").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    trees = with_row_axis(sizes, [F.asc_nulls_first("_name")], "_at")
    met = join_sized(placed, trees.select("_tree", "_first", "_size"), ["_tree"], "inner").withColumn("_at", F.col("_row") - F.col("_first"))
    log = append_log(met.select("_tree", "_at", "_size", "_digest", *carried), list(carried), levels)
    roots = trees.select("_tree", "_at").join(log.roots.hint("merge"), "_tree").select(
        F.lit("").alias("_tree"), "_at", F.lit(trees.count()).cast("long").alias("_size"), F.col("root").alias("_digest"), F.col("_tree").alias("_name"),
    )
    return Manifest(log, append_log(roots, ["_name"], levels), tuple(carried))


def audited(df: DataFrame, fields: list[Column], tampered: Column, tree: str = "lang", order: str = "doc_id", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: a manifest of ``df``, and each row folded from its digest
    now, ``tampered`` (null: as it was), up the proof it had. Nulls and repeated rows as in ``manifest``; an empty table gives no rows."""
    made = manifest(df, fields, tree, order, {"_id": F.col(id_col), "_now": F.unhex(tampered)})
    fold = folded(F.coalesce(F.lower(F.hex("_now")), F.col("leaf")), F.col("path"), F.col("before"), F.col("after"))
    out = made.proofs().select(
        F.col("_id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("path")), 256).alias("proof_sha256"), fold.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, source: str, key: str, levels: int) -> str:
    """CTEs that bring ``source`` (``key, i, n, h, f, p``: tree, place, leaves, digest, folded, proof) to the root of each tree."""
    same, tree = (f"s.{key} is not distinct from r.{key}", f"{key}, ") if key else ("true", "")
    out = [f"{name}0 as (select *, i as spot from {source})", f"{name}n0 as (select distinct {tree}spot, n, h from {name}0)"]
    for level in range(levels):
        own, siblings = "hs[1:s.spot % 8] || [f] || hs[s.spot % 8 + 2:]", "hs[1:s.spot % 8] || hs[s.spot % 8 + 2:]"
        done = f"n <= {8**level}"
        out.append(f"{name}r{level} as (select {tree}spot // 8 as run, n, list(h order by spot) as hs from {name}n{level} group by all)")
        out.append(
            f"{name}n{level + 1} as (select {tree}run as spot, n, case when {done} then hs[1] else sha256(array_to_string(hs, '')) end as h from {name}r{level})"
        )
        out.append(
            f"{name}{level + 1} as (select s.* replace (s.spot // 8 as spot, case when s.{done} then f else sha256(array_to_string({own}, '')) end as f, "
            f"case when s.{done} then p else p || array_to_string({siblings}, '') end as p) from {name}{level} s join {name}r{level} r on {same} and s.spot // 8 = r.run)"
        )
    return ",\n".join(out)


def _crc_table() -> str:
    """The table of the reflected polynomial, from its rule."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return f"{table}::bigint[]"


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_REST = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = f"""xor(list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
  lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), 4294967295::bigint)"""
#: Up to 8^7 leaves a tree and 8^4 trees.
ORACLE_SQL = f"""
with d as (select doc_id, lang, sha256({_REST} || {_FIELD.format("text")}) as h, case when {_CRC} % 3 = 0 then sha256({_REST} || {_FIELD.format(_LOWER)}) end as now from documents),
l as (select doc_id, lang, h, h as leaf, coalesce(now, h) as f, '' as p, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as i, count(*) over (partition by lang) as n from d),
{_levels_sql("t", "l", "lang", 7)},
g as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from tn7),
u as (select t.doc_id, t.leaf, t.f, t.p, g.i, g.n, g.subroot, g.subroot as h from t7 t join g on t.lang is not distinct from g.lang),
{_levels_sql("w", "u", "", 4)}
select doc_id, leaf, subroot, wn4.h as root, sha256(p) as proof_sha256, f as folded_root, f = wn4.h as verified from w4, wn4"""
