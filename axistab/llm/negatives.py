"""Hard negatives by a vertical scan with bounds.

Shards hold their vectors by dimension. For each anchor the dimensions are read in the order of its components' size. What
the dimensions not read yet can add at least and at most follows from their least and largest values in the shard; it
bounds each score, and candidates that cannot come into the result leave the bitmap until exact scores are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axistab.llm import vectors
from axistab.llm.common import stage

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score as a share of the positive's, in hundredths.
SHARES = (30, 90)
#: Dimensions read before the first look at the bounds; twice as many are read before each next one.
FIRST = 4


def exact_kind(width: int, a: int, b: int) -> type:
    """The cheapest type that holds sums of ``width`` products of integers up to ``a`` and ``b`` exactly."""
    most = max(1, width) * max(1, a) * max(1, b)
    if most >= 1 << 62:
        raise ValueError("scores of these vectors do not fit 64 bits")
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def columnar(rows: pa.Table) -> dict:
    """A shard: ids, labels as numbers of its own list, and the components by dimension with each one's range."""
    by_dim = np.ascontiguousarray(vectors.matrix(rows["_vec"], np.int64).T)
    names, label = np.unique(np.array(rows["_label"].to_pylist(), object).astype(str), return_inverse=True)
    low, high = by_dim.min(axis=1), by_dim.max(axis=1)
    top = int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
    kind = next(k for k in (np.int16, np.int32, np.int64) if top <= np.iinfo(k).max)
    return {
        "id": rows["_id"].to_numpy(), "label": label.astype(np.int32), "names": {str(n): i for i, n in enumerate(names)},
        "x": by_dim.astype(kind), "low": low, "high": high, "top": top,
    }


class Scan:
    """The scores of one anchor against a shard, known ever more exactly for ever fewer candidates."""

    def __init__(self, q: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray):
        used = np.flatnonzero(q)
        self.order = used[np.argsort(-np.abs(q[used]), kind="stable")]
        self.q, self.x, self.alive = q, x, alive
        ends = np.stack([q * low, q * high])[:, self.order]
        rest = lambda part: np.concatenate((np.cumsum(part[::-1])[::-1], np.zeros(1, part.dtype)))
        self.least, self.most = rest(ends.min(axis=0)), rest(ends.max(axis=0))
        self.read, self.sums = 0, np.zeros(x.shape[1], x.dtype)
        self.at = np.flatnonzero(alive)

    def done(self) -> bool:
        return self.read >= len(self.order) or not len(self.at)

    def advance(self) -> tuple[np.ndarray, np.ndarray]:
        """Reads the next dimensions; least and largest score of each candidate that is left."""
        stop = min(len(self.order), max(FIRST, 2 * self.read))
        dims = self.order[self.read : stop]
        if 4 * len(self.at) > self.x.shape[1]:
            for d in dims:
                self.sums += self.q[d] * self.x[d]
        else:
            self.sums[self.at] += self.q[dims] @ self.x[np.ix_(dims, self.at)]
        self.read = stop
        known = self.sums[self.at]
        return known + self.least[stop], known + self.most[stop]

    def keep(self, left: np.ndarray) -> None:
        """Candidates that stay; the bitmap loses the others."""
        if not left.all():
            self.alive[self.at[~left]] = False
            self.at = self.at[left]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, then by id."""
    first = np.lexsort((ids, -score))[:k]
    return score[first], ids[first]


def _largest(x: np.ndarray, k: int):
    """The k-th largest value; none if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def _scan(block: dict, i: int, shard: dict, alive: np.ndarray, cache: dict) -> Scan:
    if "x" not in cache:
        width = max(block["q"].shape[1], shard["x"].shape[0])
        kind = exact_kind(width, int(np.abs(block["q"]).max(initial=0)), shard["top"])
        grown = lambda a: np.concatenate((a, np.zeros((width - len(a), *a.shape[1:]), a.dtype))).astype(kind)
        cache |= {"x": grown(shard["x"]), "low": grown(shard["low"]), "high": grown(shard["high"]), "q": vectors.widened(block["q"], width).astype(kind)}
    return Scan(cache["q"][i], cache["x"], cache["low"], cache["high"], alive)


def nearest_positives(block: dict, i: int, shard: dict, cache: dict, have: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of the same label among ``have`` and the shard."""
    label = shard["names"].get(block["label"][i])
    if label is None:
        return have
    scan = _scan(block, i, shard, (shard["label"] == label) & (shard["id"] != block["id"][i]), cache)
    known = have[0][k - 1] if len(have[0]) >= k else None
    while not scan.done():
        low, high = scan.advance()
        worst = [t for t in (known, _largest(low, k)) if t is not None]
        if worst:
            scan.keep(high >= max(worst))
    score = scan.sums[scan.at].astype(np.int64)
    return _best(np.concatenate((have[0], score)), np.concatenate((have[1], shard["id"][scan.at])), k)


def window_of(positive: int, shares: tuple[int, int] = SHARES) -> tuple[int, int]:
    """Least and largest score of a negative: ``shares`` hundredths of the positive's."""
    return -((-shares[0] * positive) // 100), (shares[1] * positive) // 100


def negatives_in_windows(block: dict, i: int, shard: dict, cache: dict, have: list[tuple[np.ndarray, np.ndarray]], k: int, shares: tuple[int, int]) -> None:
    """For every positive of an anchor the first ``k`` of other labels within its window, merged into ``have``.

    The windows are scanned together. A candidate stays while it may lie in a window and may still be among the first ``k``
    there: with k candidates certain to be inside, one whose largest score is below theirs is out.
    """
    label = shard["names"].get(block["label"][i], -1)
    scan, bounds = _scan(block, i, shard, shard["label"] != label, cache), [window_of(p, shares) for p in block["scores"][i]]
    while not scan.done():
        low, high = scan.advance()
        left = np.zeros(len(low), bool)
        for (lo, hi), (score, _) in zip(bounds, have, strict=True):
            may, sure = (high >= lo) & (low <= hi), low[(low >= lo) & (high <= hi)]
            for t in (score[k - 1] if len(score) >= k else None, _largest(sure, k)):
                if t is not None:
                    may &= high >= t
            left |= may
        scan.keep(left)
    score, ids = scan.sums[scan.at].astype(np.int64), shard["id"][scan.at]
    for w, (lo, hi) in enumerate(bounds):
        inside = (score >= lo) & (score <= hi)
        have[w] = _best(np.concatenate((have[w][0], score[inside])), np.concatenate((have[w][1], ids[inside])), k)


def _asked(rows: pa.Table) -> dict:
    out = {"id": rows["_id"].to_numpy(), "q": vectors.matrix(rows["_vec"], np.int64), "label": rows["_label"].to_pylist()}
    return out | ({"scores": [[p["score"] for p in x] for x in rows["_pos"].to_pylist()]} if "_pos" in rows.column_names else {})


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES, scale: int = SCALE, shard: int = vectors.SHARD, block: int = vectors.BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as floor(scale x); the score is the inner product of these integers. For each row where ``anchor``
    holds, its first ``positives`` other rows of the same label and for each of them the first
    ``negatives`` rows of other labels whose score is within ``shares`` hundredths of the positive's; higher scores first, ties
    by smaller id. All rows are searched, exactly.

    Rows without an id or a label, without a vector or with a component that is null or not finite take no part; ids are
    integers. A shorter vector counts as followed by zeros. "Other" rows are those with another id; rows that repeat an id
    each count, but as an anchor the least of them is asked once. Fewer rows give fewer results, an empty table none. Scores
    that could exceed 64 bits are refused. Other columns are not read.
    """
    rows = vectors.usable(df, id_col, vec_col, _label=F.col(label_col).cast("string"), _ask=anchor).filter("_label is not null")
    rows = rows.withColumn("_vec", F.transform("_vec", lambda x: F.floor(x * F.lit(float(scale)))))
    asked = stage(vectors.once_an_id(rows.filter("_ask").drop("_ask")), "anchors")
    shards = vectors.packed(rows.drop("_ask"), shard, columnar, "shard")

    def first(b: dict) -> dict:
        return {"best": [_NONE] * len(b["id"])}

    def find_positives(b: dict, state: dict, s: dict) -> None:
        cache: dict = {}
        state["best"] = [nearest_positives(b, i, s, cache, have, positives) for i, have in enumerate(state["best"])]

    def positives_of(b: dict, state: dict) -> list[np.ndarray]:
        n = [len(score) for score, _ in state["best"]]
        return [np.repeat(b["id"], n), np.concatenate([x for _, x in state["best"]]), np.concatenate([x for x, _ in state["best"]])]

    found = vectors.meet(
        vectors.packed(asked, block, _asked, "block"), shards, first, find_positives, positives_of, "_id long, positive long, score long",
    )
    nth = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("score"), "positive"))
    best = found.withColumn("nth", nth).filter(F.col("nth") <= positives)
    lists = best.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("nth", "positive", "score"))).alias("_pos"))
    with_positives = stage(asked.join(lists.hint("merge"), "_id"), "positives")

    def windows(b: dict) -> list:
        return [[_NONE] * len(s) for s in b["scores"]]

    def find_negatives(b: dict, state: list, s: dict) -> None:
        cache: dict = {}
        for i, have in enumerate(state):
            negatives_in_windows(b, i, s, cache, have, negatives, shares)

    def negatives_of(b: dict, state: list) -> list[np.ndarray]:
        each = [(i, w, score, ids) for i, have in enumerate(state) for w, (score, ids) in enumerate(have)]
        n = [len(score) for *_, score, _ in each]
        spread = lambda values: np.repeat(np.array(values, np.int64), n)
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        return [spread([b["id"][i] for i, *_ in each]), spread([w + 1 for _, w, *_ in each]), flat([x for *_, x in each]), flat([x for *_, x, _ in each])]

    near = vectors.meet(
        vectors.packed(with_positives, block, _asked, "block"), shards, windows, find_negatives, negatives_of,
        "anchor_id long, nth long, negative_id long, negative_score long",
    )
    order = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    pairs = with_positives.select(F.col("_id").alias("anchor_id"), F.explode("_pos").alias("p")).select(
        "anchor_id", F.col("p.nth").cast("long").alias("nth"), F.col("p.positive").alias("positive_id"), F.col("p.score").alias("positive_score"),
    )
    return near.join(pairs.hint("merge"), ["anchor_id", "nth"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    )


#: Every anchor with all rows, for tables of any size that DuckDB can bear. Of the columns it reads the query's relabelled ones.
ORACLE_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other)::int as rank, s.other as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) <= 10"""
