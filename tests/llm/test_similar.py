"""Near copies by five-word similarity against a comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from axistab.llm import similar
from tests.llm.conftest import words

STEMS = ["ba", "ke", "li", "to", "nu", "shr", "und"]


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_groups(rows, least=0.8):
    """Smallest (id is null, id) of the group of each row over links of all pairs."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(STEMS) * 2
    return " ".join(w)


@pytest.mark.parametrize(("chunk", "held"), [(2048, 4 << 20), (7, 9000)])
def test_near_copies_equal_all_pairs(spark, chunk, held):
    rng, rows = random.Random(11), []
    for i in range(60):
        rows.append((i, words(rng, STEMS, rng.randrange(60, 200))))
    for i in range(60):
        base = rows[rng.randrange(60)][1]
        rows.append((100 + i, edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 25))))
    star = words(rng, STEMS, 400)  # copies near to one text, hardly to each other
    rows += [(1000 + i, edited(rng, star, 7)) for i in range(120)] + [(2000, star)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "one two"), (3004, "ONE  two"), (3005, "two one")]
    roots = brute_groups(rows)
    expected = {min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, _key string, node string").repartition(3)
    kept = similar.drop_near_copies(df, chunk=chunk, held=held)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)


def test_linked_sets_join_what_all_pairs_join():
    rng = random.Random(3)
    for _ in range(30):
        base = [rng.sample(range(60), 30) for _ in range(3)]
        sets = [
            sorted({*rng.choice(base), *rng.sample(range(60), rng.randrange(6))} - set(rng.sample(range(60), 4))) for _ in range(rng.randrange(1, 40))
        ]
        edges = similar.linked_sets(np.cumsum([0, *map(len, sets)]), np.array([v for s in sets for v in s], np.int64), 0.8)
        forest, true = similar.Forest(), similar.Forest()
        assert all(forest.join(a, b) for a, b in edges)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(set(a) & set(b))
                if both >= 0.8 * (len(a) + len(b) - both):
                    true.join(i, j)
        n = range(len(sets))
        assert len({(forest.root(i), true.root(i)) for i in n}) == len({forest.root(i) for i in n}) == len({true.root(i) for i in n})


def test_shared_missing_and_repeated_rows(spark, messy, nothing):
    rng, rows = random.Random(9), []
    for i in (5, 5, None, None):
        rows.append((i, words(rng, STEMS, 60)))
    rows += [rows[0], rows[2], (6, rows[1][1]), (4, rows[3][1])]
    kept = similar.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in kept.collect()} == {rows[0], rows[1], rows[2], rows[7]}
    assert kept.count() == 4
    known = [(r["doc_id"], r["text"]) for r in messy.collect()]
    roots = brute_groups(known)
    least = {r: min((known[i][0] is None, known[i][0] or 0) for i in range(len(known)) if roots[i] == r) for r in set(roots)}
    out = similar.drop_near_copies(messy)
    assert out.columns == messy.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == sorted(least.values())
    assert similar.drop_near_copies(nothing).count() == 0


def test_blocks_thin_in_every_task_are_dealt(spark):
    """A block with few rows in each of many tasks is dealt as one with all its rows in one task is."""
    rng, chunk = random.Random(12), 50
    prints = list({(rng.getrandbits(62), 7 if i % 3 else rng.getrandbits(62)) for i in range(900)})
    masks = [(0, 2**63 - 1), (2**63 - 1, 0)]
    rows = spark.createDataFrame(prints, "_a long, _b long")
    thin, thick = (similar.dealt_blocks(rows.repartition(n), masks, chunk) for n in (90, 1))
    assert sorted(map(tuple, thin.collect())) == sorted(map(tuple, thick.collect()))
    assert 50 < thin.groupBy("key").count().agg({"count": "max"}).first()[0] < 3 * chunk
    # Every two fingerprints of the block have a key in common.
    held = {}
    for a, b, key in thin.filter("_b = 7").collect():
        held.setdefault((a, b), set()).add(key)
    some = list(held.values())
    assert len(some) > 590 and all(x & y for i, x in enumerate(some[:60]) for y in some[i + 1 :])


def test_blocks_bring_similar_texts_together():
    """Of pairs of texts around the least similarity nearly all share a block and are within the limit of bits."""
    rng = random.Random(4)
    masks = np.array([[m & (2**64 - 1) for m in pair] for pair in similar.block_masks(200_000)], np.uint64)
    met = near = total = 0
    for _ in range(400):
        base = words(rng, STEMS, 300)
        other = edited(rng, base, 6)
        a, b = shingle_set(base), shingle_set(other)
        if len(a & b) / len(a | b) < 0.8:
            continue
        x, y = (np.frombuffer(similar.wide_fingerprint(t.encode()), ">u8").astype(np.uint64) for t in (base, other))
        total += 1
        met += bool(((x ^ y) & masks == 0).all(axis=1).any())
        near += int(np.bitwise_count(x ^ y).sum()) <= similar.bit_limit()
    assert total > 150 and met / total > 0.95 and near == total
