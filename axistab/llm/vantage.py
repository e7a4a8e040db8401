"""Nearest neighbours by vantage-point trees.

Each shard of vectors has a tree: a vantage point's distances split a node at their median, and the range of distances on
either side bounds, by the triangle inequality, how near a query can come to what lies there. Largest inner products are
nearest neighbours once every vector of a shard has the same length, which one more component gives it; queries are scaled
to that length. A leaf is read while its bound times ``factor`` is at most the distance of the k-th best so far, or while it
may hold a product over ``factor`` times the k-th best one: with factor one both say the same and the search is exact, a
larger one reads fewer leaves. The first serves vectors of one length, whose near ones all have products near the largest,
the second vectors of unequal lengths, whose distances are all alike once their lengths are made equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axistab.llm import vectors
from axistab.llm.common import stage

NEIGHBOURS = 20
#: Relaxation of the triangle inequality in production; README has its recall.
FACTOR = 1.25
#: Vectors of a leaf at most, vantage points tried for a node and vectors that they are tried on.
LEAF, TRIED, TRIED_ON = 128, 12, 96
#: What rounding may take from a distance or add to it, as a share of the vectors' length.
SLACK = 1e-7


def _apart(x: np.ndarray, v: np.ndarray, length: float) -> np.ndarray:
    """Distances of rows to vectors; both have ``length`` once the missing component is added to the rows alone or to neither."""
    return np.sqrt(np.maximum(0.0, 2 * length * length - 2 * (x @ v.T)))


def tree(rows: pa.Table) -> dict:
    """A shard in the order of its leaves: ids, vectors, vantage points by heap number, distance ranges of their two sides."""
    ids, x = rows["_id"].to_numpy(), vectors.matrix(rows["_vec"])
    scale = float(np.abs(x).max(initial=0.0)) or 1.0
    points = x / scale
    norms = np.einsum("ij,ij->i", points, points)
    points = np.concatenate((points, np.sqrt(np.maximum(0.0, norms.max(initial=0.0) - norms))[:, None]), axis=1)
    length = float(np.sqrt(norms.max(initial=0.0)))
    depth, rng = max(0, int(np.ceil(np.log2(max(1, len(ids) / LEAF))))), np.random.default_rng(5)
    order, cuts = np.arange(len(ids)), [0, len(ids)]
    vantage, ranges = np.zeros((1 << depth) - 1, np.int64), np.zeros(((1 << depth) - 1, 2, 2))
    for level in range(depth):
        new = [0]
        for nth, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            node, own = (1 << level) - 1 + nth, order[lo:hi]
            tried, on = (own[rng.integers(0, hi - lo, k)] for k in (TRIED, TRIED_ON))
            best = tried[int(np.argmax(_apart(points[tried], points[on], length).std(axis=1)))]
            far = _apart(points[own], points[best : best + 1], length)[:, 0]
            by, middle = np.argsort(far, kind="stable"), (hi - lo) // 2
            order[lo:hi], far = own[by], far[by]
            vantage[node], ranges[node] = best, [[far[0], far[middle - 1]], [far[middle], far[-1]]]
            new += [lo + middle, hi]
        cuts = new
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    kept = x[order]
    return {
        "id": ids[order], "x": kept.astype(np.float32) if (kept == kept.astype(np.float32)).all() else kept, "cuts": np.array(cuts),
        "vantage": place[vantage], "ranges": ranges, "scale": scale, "length": length,
    }


def leaf_bounds(q: np.ndarray, x: np.ndarray, shard: dict) -> np.ndarray:
    """The least distance of each query (scaled to the shard's length) to what each leaf can hold."""
    far = _apart(q, x[shard["vantage"]] / shard["scale"], shard["length"])
    bound = np.zeros((len(q), 1))
    for level in range(len(shard["cuts"]).bit_length() - 1):
        nodes = np.arange((1 << level) - 1, (1 << level + 1) - 1)
        if nodes[-1:] >= len(shard["vantage"]):
            break
        d, r = far[:, nodes, None], shard["ranges"][nodes][None]
        own = np.maximum(r[..., 0] - d, d - r[..., 1])
        bound = np.maximum(np.repeat(bound, 2, axis=1), own.reshape(len(q), -1))
    return np.maximum(0.0, bound - SLACK * shard["length"])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components, so that equal vectors have equal products."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Best:
    """The k best (score, id) of every query of a block so far, by falling score, then by id."""

    def __init__(self, n: int, k: int):
        self.k, self.ask = k, np.zeros(0, np.int64)
        self.score, self.id, self.worst = np.zeros(0), np.zeros(0, np.int64), np.full(n, -np.inf)

    def add(self, ask: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        ask, score, ids = np.concatenate((self.ask, ask)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, ask))
        ask = ask[order]
        nth = np.arange(len(ask)) - np.searchsorted(ask, ask)
        left = nth < self.k
        self.ask, self.score, self.id = ask[left], score[order][left], ids[order][left]
        full = nth == self.k - 1
        self.worst[ask[full]] = score[order][full]


def search(block: dict, best: Best, shard: dict, factor: float) -> int:
    """Brings what a shard has for the queries of a block into ``best``; returns how many pairs of query and leaf were read."""
    q, x = block["q"], shard["x"].astype(np.float64)
    width = max(q.shape[1], x.shape[1])
    q, x = vectors.widened(q, width), vectors.widened(x, width)
    norm = block["norm"] * shard["scale"]
    at = leaf_bounds(q * (shard["length"] / block["norm"])[:, None], x, shard)
    order, length, reads, start = np.argsort(at, axis=1, kind="stable"), shard["length"], 0, 0
    near = np.take_along_axis(at, order, axis=1)
    leaves = order.shape[1]
    while start < leaves:
        stop = min(leaves, max(1, 2 * start))
        with np.errstate(invalid="ignore"):
            wanted = np.stack((best.worst, np.where(best.worst > 0, factor, 1.0) * best.worst))
            reach = np.sqrt(np.maximum(0.0, 2 * length * length - 2 * length * wanted / norm))
        reach = np.maximum(reach[0] / factor, reach[1]) + SLACK * length
        ask, turn = np.nonzero(near[:, start:stop] <= reach[:, None])
        if not len(ask):
            break
        leaf, found = order[ask, start + turn], []
        by = np.argsort(leaf, kind="stable")
        ask, leaf = ask[by], leaf[by]
        for one in np.unique(leaf):
            own = ask[np.searchsorted(leaf, one) : np.searchsorted(leaf, one, side="right")]
            lo, hi = shard["cuts"][one], shard["cuts"][one + 1]
            score = q[own] @ x[lo:hi].T
            good = (score >= (best.worst[own] - 1e-9 * norm[own] * length)[:, None]) & (shard["id"][lo:hi][None] != block["id"][own][:, None])
            i, j = np.nonzero(good)
            found.append((own[i], lo + j))
        who, what = (np.concatenate(c) for c in zip(*found, strict=True))
        reads, start = reads + len(ask), stop
        best.add(who, products(q[who], x[what]), shard["id"][what])
    return reads


def _asked(rows: pa.Table) -> dict:
    q = vectors.matrix(rows["_vec"])
    top = np.abs(q).max(axis=1, initial=0.0)
    return {"id": rows["_id"].to_numpy(), "q": q, "norm": top * np.linalg.norm(q / np.where(top > 0, top, 1.0)[:, None], axis=1)}


def nearest_neighbours(
    df: DataFrame, query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR,
    shard: int = vectors.SHARD, block: int = vectors.BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``query`` holds its ``k`` nearest other rows, nearest first.

    Nearest is the largest inner product in double precision, summed in the order of the components; ties go to the smaller
    id. Every row is in the tree of its shard and may be found; ``factor`` 1 finds exactly the nearest, a larger one reads
    fewer leaves and may miss some.

    Rows without an id, without a vector, with a component that is null or not finite, and vectors that are zero or empty
    take no part; ids are integers. A shorter vector counts as followed by zeros. "Other" rows are those with another id; rows
    that repeat an id can each be found, but as a query the least of them is asked once. With fewer rows all are returned; an
    empty table gives no rows. Other columns are not read.
    """
    if not factor >= 1:
        raise ValueError("factor must be 1 or more")
    rows = vectors.usable(df, id_col, vec_col, _ask=query).filter(F.exists("_vec", lambda x: x != 0))
    asked = stage(vectors.once_an_id(rows.filter("_ask").drop("_ask")), "queries")
    shards = vectors.packed(rows.drop("_ask"), shard, tree, "shard")

    def results(b: dict, best: Best) -> list[np.ndarray]:
        return [b["id"][best.ask], best.id, best.score]

    found = vectors.meet(
        vectors.packed(asked, block, _asked, "block"), shards, lambda b: Best(len(b["id"]), k), lambda b, best, s: search(b, best, s, factor), results,
        "query_id long, vec_id long, score double",
    )
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Every query with all rows, for tables of any size that DuckDB can bear.
ORACLE_SQL = """
with v as (select vec_id, embedding::double[] as q from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q) as score from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20"""
