"""The ten operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from axistab.llm import brown, chat, exact_dedup, language, mixing, packing, qda, quality_rules, simhash, textstats, warc
from axistab.llm.common import held_out
from axistab.llm.queries import tokenizer
from tests.llm.conftest import SCHEMA, messy_rows, words


def squeezed(text):
    return (text or "").encode().translate(None, b" \t\n\r\x0b\x0c")


# Brown scores


def test_brown_base_scores_and_held_out_gain(spark, messy):
    out = brown.brown_scores(messy, held_out(F.col("doc_id"), 5, 1), classes=8, sweeps=2).collect()
    rows = messy.collect()
    assert len(out) == len(rows)
    of = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    token = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for r in rows if not of(r["doc_id"]) for w in token(r["text"]))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (
            r["doc_id"] if r["doc_id"] is not None else -1, len(token(r["text"])), sum(w in counts for w in token(r["text"])),
            round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token(r["text"])), 5),
        ) for r in rows
    )
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in out) == expected
    assert {r["train_tokens"] for r in out} == {n}
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] <= 0 for r in out)


def test_brown_scores_follow_from_the_classes(spark, messy):
    """Transitions and emissions counted anew from the words' classes give the same scores."""
    held, k = held_out(F.col("doc_id"), 5, 1), 8
    known = {bytes(r["word"]): (r["class"], r["count"]) for r in brown.word_classes(messy, held, classes=k, sweeps=2).collect()}
    rows = messy.select("doc_id", "text").collect()
    token = lambda t: [*(t or "").encode().lower().split(), b""]
    of = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    train = [w for r in rows if not of(r["doc_id"]) for w in token(r["text"])]
    counts = Counter(train)
    assert {w: n for w, (_, n) in known.items()} == counts and known[b""][0] == k + 1
    size, moves, once, after = Counter(), Counter(), Counter(), Counter()
    for w, n in counts.items():
        size[known[w][0]] += n
    for r in rows:
        if not of(r["doc_id"]):
            before = k + 1
            for w in token(r["text"]):
                moves[before, known[w][0]] += 1
                once[before] += counts[w] == 1
                after[before] += 1
                before = known[w][0]
    n, singles = len(train), max(sum(c == 1 for c in counts.values()), 1)
    unknown = lambda b: min(0.5, max(1e-9, (once[b] + brown.BACKOFF_UNKNOWN * singles / (n + 2)) / (after[b] + brown.BACKOFF_UNKNOWN)))
    out = {}
    for r in brown.brown_scores(messy, held, classes=k, sweeps=2).collect():
        out.setdefault(r["doc_id"], []).append(r["score"])
    expected = {}
    for r in rows:
        before, score = k + 1, 0.0
        for w in token(r["text"]):
            if w in known:
                c, m = known[w]
                p = (moves[before, c] + brown.BACKOFF * size[c] / n) / (after[before] + brown.BACKOFF)
                score += math.log10(p * (1 - unknown(before))) + math.log10(m / size[c])
                before = c
            else:
                score += math.log10(unknown(before))
        expected.setdefault(r["doc_id"], []).append(score)
    assert all(np.allclose(sorted(out[i]), sorted(expected[i]), rtol=1e-9) for i in expected) and out.keys() == expected.keys()


def test_brown_edges(nothing, messy):
    assert brown.brown_scores(nothing, F.lit(False)).count() == 0
    assert {r["score"] for r in brown.brown_scores(messy.limit(5), F.lit(True)).collect()} == {0.0}


def test_exchange_joins_words_with_like_contexts():
    matrix = np.array([[0.0, 40, 0], [0, 0, 40], [40, 0, 0]])
    right, left = np.array([[0.0, 5, 0]]), np.array([[0.0, 0, 5]])
    assert brown.exchange(right, left, np.array([2], np.uint8), matrix + 1, 3)[0] == 0


# Exact deduplication


@pytest.mark.parametrize("counters", [4, 4096])
def test_exact_dedup(messy, counters):
    groups = defaultdict(list)
    for r in messy.collect():
        groups[squeezed(r["text"])].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    expected = []
    for norm, members in groups.items():
        members.sort(key=lambda m: m[:3])
        expected += [(m[3], members[0][3], len(members), i == 0, hashlib.sha256(norm).hexdigest()) for i, m in enumerate(members)]
    out = [tuple(r) for r in exact_dedup.exact_dedup(messy, counters=counters).collect()]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    kept = exact_dedup.drop_exact_copies(messy, counters=counters)
    assert kept.columns == messy.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((e[0] is None, e[0]) for e in expected if e[3])


def test_exact_dedup_empty(nothing):
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_exact_copies(nothing).count() == 0


def test_misra_gries_bounds():
    rng = random.Random(1)
    values = ["hot"] * 300 + [f"v{rng.randrange(400)}" for _ in range(700)]
    rng.shuffle(values)
    found = exact_dedup.misra_gries(iter(values[i : i + 100] for i in range(0, 1000, 100)), 9)
    assert len(found) <= 9 and 300 - 100 <= found["hot"] <= 300


# Discriminant


def test_discriminant_separates_held_out(spark, messy):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        good = i % 4 > 0
        text = " ".join(
            "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("" if good else "###") for _ in range(rng.randrange(5, 60))
        )
        rows.append((i, text))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        labels + [(None, 1), (3, None)], "doc_id long, quality int",
    )
    out = qda.quality_scores(docs, marks, "_id % 3 <> 0").collect()
    held = [(r["score"] >= 0.3) == (r["doc_id"] % 4 > 0) for r in out if r["doc_id"] % 3 == 0]
    assert len(out) == 300 and sum(held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    assert qda.quality_scores(messy, marks).count() == messy.count()


def test_discriminant_equals_dense_densities(spark, messy):
    """Scores are those of two normal densities with dense covariances, inverted and not factored."""
    rows = [r for r in messy.select("doc_id", "text").collect() if r["doc_id"] is not None]
    labels = [(r["doc_id"], int((r["doc_id"] * 7) % 3 > 0)) for r in {r["doc_id"]: r for r in rows}.values()]
    x = {i: qda.transform(np.array([textstats.statistics((t or "").encode())]))[0] for i, t in rows}
    per = [(x[i], y) for i, y in labels for j, _ in rows if j == i]
    data, y = np.array([a for a, _ in per]), np.array([b for _, b in per])
    mean, scale = data.mean(axis=0), np.sqrt(np.maximum(data.var(axis=0), 1e-9))
    z, dense = (data - mean) / scale, []
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    common = sum((y == k).sum() * own[k] for k in (0, 1)) / len(y)
    for k in (0, 1):
        share = min(1.0, qda.SHRINK_POOLED + qda.DIMENSIONS / ((y == k).sum() + qda.DIMENSIONS))
        cov = (1 - share) * own[k] + share * common
        cov = (1 - qda.SHRINK_DIAGONAL) * cov + qda.SHRINK_DIAGONAL * np.diag(np.diag(cov)) + qda.RIDGE * np.eye(qda.DIMENSIONS)
        dense.append((z[y == k].mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))

    def score(text):
        v = (qda.transform(np.array([textstats.statistics((text or "").encode())]))[0] - mean) / scale
        logs = [-0.5 * ((v - m) @ inverse @ (v - m) + det) for m, inverse, det in dense]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + np.log(((y == 1).sum() + 1) / ((y == 0).sum() + 1)), -500, 500)))

    out = qda.quality_scores(
        messy, spark.createDataFrame(labels, "doc_id long, quality int").withColumns({"_id": F.lit("x"), "_x": F.lit("y")}),
    ).collect()
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    assert all(min(abs(r["score"] - score(t)) for t in texts[r["doc_id"]]) < 1e-6 for r in out if r["doc_id"] is not None)


def test_discriminant_without_labels(spark, messy, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in qda.quality_scores(messy, none).collect()} == {0.5}
    assert qda.quality_scores(nothing, none).count() == 0


# Mixing


def test_fit_budget_reaches_what_can_be_reached():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 5) for _ in range(4)}
        budget, sums = rng.randrange(0, 150), {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        for window in (1 << 16, 20):
            taken = mixing.fit_budget(counts, budget, window)
            total = sum(k * n for k, n in taken.items())
            assert all(0 <= n <= counts[k] for k, n in taken.items()) and total <= budget or total == sum(k * n for k, n in counts.items())
            if window > 150:
                assert total == max(s for s in sums if s <= budget)


@pytest.mark.parametrize(("each", "budget"), [(1, 30_000), (2, 60_000), (40, 1_200_000)])
def test_fit_budget_keeps_the_make_up_of_lengths(each, budget):
    rng = random.Random(3)
    counts = dict.fromkeys(range(50, 501), each)
    counts = {k: n for k, n in counts.items() if n > 1 or rng.random() < 0.9}
    taken = mixing.fit_budget(counts, budget)
    assert sum(k * n for k, n in taken.items()) == budget and all(0 <= n <= counts[k] for k, n in taken.items())
    share = budget / sum(k * n for k, n in counts.items())
    for low in range(50, 500, 90):
        part = [k for k in counts if low <= k < low + 90]
        assert 0.75 * share < sum(taken[k] for k in part) / sum(counts[k] for k in part) < 1.3 * share


def test_mix(messy, nothing):
    out = mixing.mix_sources(messy).collect()
    rows = messy.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"]) for r in out) == sorted(
        (r["doc_id"] is None, r["doc_id"], len((r["text"] or "").encode().split())) for r in rows
    )
    source = {r["doc_id"]: r["source"] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, (s or "").encode())), [5, 2, 1] * 9, strict=False))
    want, capped = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        want = {s: 2 * sizes[s] if s in capped else left * weights[s] / sum(weights[f] for f in free) for s in sizes}
        over = {s for s in free if want[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert all(math.isclose(target[s], want[s], abs_tol=1e-6) for s in sizes)
    assert all(abs(taken[s] - want[s]) <= 25 for s in sizes if s not in ("src0", "src3"))
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix_sources(messy.repartition(2)).collect()))
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    copies = mixing.mixed_documents(messy)
    assert copies.columns == messy.columns
    size = lambda t: len((t or "").encode().split())
    assert sum(size(r["text"]) for r in copies.collect()) == sum(taken.values())


def test_mixed_rows_of_one_id_do_not_overshoot(spark):
    rng = random.Random(13)
    rows = [(i % 3 if i % 4 else None, words(rng, ["ba", "ke", "li"], rng.randrange(1, 60)), f"s{i % 2}") for i in range(300)]
    rows += rows[:40] + [(7, "twice here", "s0"), (7, "twice here", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {tuple(r) for r in mixing.mix_sources(df).groupBy("target").agg(F.sum("taken")).collect()}
    out = mixing.mixed_documents(df).collect()
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += len(r["text"].split())
    assert sorted(sizes.values()) == sorted(t for _, t in taken) and all(abs(a - b) < 60 for a, b in taken)


def reachable(counts, most):
    """All sums up to ``most`` as bits."""
    sums, mask = 1, (1 << most + 1) - 1
    for k, n in counts.items():
        piece = 1
        while n:
            piece = min(piece, n)
            sums = (sums | sums << k * piece) & mask
            n, piece = n - piece, 2 * piece
    return sums


@pytest.mark.parametrize("copies", [5, 60])
def test_fit_budget_of_few_long_lengths(copies):
    """Budgets on both sides of the knapsack's first window: the sum is the largest there is."""
    rng = random.Random(copies)
    for _ in range(60 if copies == 5 else 25):
        counts = {rng.randrange(800, 20_000): rng.randrange(1, copies) for _ in range(rng.randrange(3, 12))}
        total = sum(k * n for k, n in counts.items())
        budget = rng.randrange(total // 4, total)
        taken = mixing.fit_budget(counts, budget)
        assert all(0 <= n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == (reachable(counts, budget)).bit_length() - 1
    assert mixing.fit_budget({11539: 4, 19375: 4, 16578: 2}, 94_087) and sum(
        k * n for k, n in mixing.fit_budget({11539: 4, 19375: 4, 16578: 2}, 94_087).items()
    ) == 94_078


def test_fit_budget_beyond_the_window_exchanges():
    """Few lengths, more words than the knapsack's table: what a proportional share misses is exchanged for."""
    rng = random.Random(11)
    for _ in range(12):
        counts = {rng.randrange(800, 20_000): rng.randrange(20_000, 60_000) for _ in range(rng.randrange(2, 6))}
        budget = sum(k * n for k, n in counts.items()) * rng.randrange(20, 80) // 100
        taken = mixing.fit_budget(counts, budget, most=1 << 18)
        assert all(0 <= n <= counts[k] for k, n in taken.items())
        assert sum(k * n for k, n in taken.items()) == budget - budget % math.gcd(*counts)


def test_fit_budget_keeps_little_memory():
    import tracemalloc

    tracemalloc.start()
    taken = mixing.fit_budget(dict.fromkeys(range(4, 8000, 2), 3), 65_535)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k * n for k, n in taken.items()) == 65_534 and peak < 30 << 20


# SimHash


def brute_components(found, distance=4):
    fps = sorted(set(found.values()))
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                parent[root(a)] = root(b)
    return root


def test_simhash(spark, messy, nothing):
    out = simhash.simhash_components(messy).collect()
    rows = messy.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    text = "one two three Four five"
    hashes = spark.createDataFrame([("one two three four",), ("two three four five",)], "s string").select(F.xxhash64("s").alias("h")).collect()
    both = [h["h"] & (2**64 - 1) for h in hashes]
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == both[0] & both[1]
    found = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in rows}
    root, least = brute_components(found), {}
    for d, f in found.items():
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    assert all(r["fingerprint"] == f"{found[r['doc_id']] & (2**64 - 1):016x}" for r in out)
    assert all(r["component_id"] == least.get(root(found[r["doc_id"]])) for r in out)
    assert simhash.simhash_components(nothing).count() == 0


@pytest.mark.parametrize("chunk", [50, 2048])
def test_near_links_connect_dense_and_spread_groups(spark, chunk):
    rng = random.Random(4)
    fps = {0, -1}
    base = rng.getrandbits(64)
    for i in range(300):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(40), rng.randrange(0, 5))))
        fps.add(rng.getrandbits(64))
        fps.add(base ^ ((1 << (i % 60)) - 1))
    signed = [f - (1 << 64) if f >> 63 else f for f in (f & (2**64 - 1) for f in fps)]
    edges = simhash.near_links(spark.createDataFrame([(f,) for f in set(signed)], "_fp long"), chunk=chunk)
    reps = {r["node"]: r["rep"] for r in simhash.components(edges).collect()}
    root = brute_components(dict(enumerate(signed)))
    pairs = {(reps.get(f, f), root(f)) for f in signed}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# Packing


def test_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [r[1] for r in messy_rows() if r[1]] + [
        "a  b", "a ", " a", "a\n b\t c ", "it's  we'll x  ", "x <|endoftext|> y", "\n\n  \n", "a  b", "naïve 中文 😀 ok",
    ]
    true = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = packing.encoder(*tokenizer())
    for t in texts:
        assert np.frombuffer(mine.ids(t), "<u4").tolist() == true.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("shard", [4096, 20])
def test_pack(messy, nothing, shard):
    out = packing.pack(messy, tokenizer(), shard=shard).collect()
    ids = packing.encoder(*tokenizer()).ids
    expected = []
    for r in messy.collect():
        blob = ids(r["text"] or "") + np.array([2], "<u4").tobytes()
        expected += [(r["doc_id"], k, s, n, zlib.crc32(blob[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(blob) // 4))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(expected, key=repr)
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= -(-sum(r["length"] for r in out) // 1024) * 1.1 + 2
    assert packing.pack(nothing, tokenizer()).count() == 0
    assert packing.cut(2500) == [
        (0, 452), (452, 1024), (1476, 1024),
    ] and packing.cut(2048) == [(0, 1024), (1024, 1024)] and packing.cut(1024) == [(0, 1024)]


def test_evolution_never_loses_items_and_improves():
    rng = np.random.default_rng(0)
    lengths = rng.integers(200, 500, 400)
    start = packing.fresh(lengths.tolist(), rng, 0.2, 1024)
    out = packing.evolve(lengths, [packing.fresh(lengths.tolist(), rng, 0.2, 1024) for _ in range(4)], rng, 4, 60)
    for bins in out:
        assert len(bins) == 400 and (np.bincount(bins, weights=lengths) <= 1024).all()
    assert packing.fitness(out[0], lengths, 1024) <= packing.fitness(start, lengths, 1024)


def triplets(rng, n):
    """Lengths that fill sequences in threes, on which best fit by falling length does badly."""
    out = []
    for _ in range(n):
        a = rng.randrange(260, 480)
        b = rng.randrange(260, 764 - a)
        out += [a, b, 1024 - a - b]
    return out


@pytest.mark.parametrize("kind", ["triplets", "wide", "small", "halves"])
def test_packing_beats_best_fit_over_all_pieces(spark, kind):
    rng = random.Random(21)
    lengths = {
        "triplets": triplets(rng, 400), "wide": [rng.randrange(200, 700) for _ in range(1200)], "small": [rng.randrange(3, 300) for _ in range(1500)],
        "halves": [600] * 300,
    }[kind]
    best_fit = packing.fresh(lengths, np.random.default_rng(0), 0.0, 1024).max() + 1
    items = spark.createDataFrame([(i, n, i % 5) for i, n in enumerate(lengths)], "uid long, length long, part int")
    rows = packing.packed_items(items, shard=200).collect()
    assert sorted(r["uid"] for r in rows) == list(range(len(lengths)))
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], lengths[r["uid"]]))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= best_fit
    if kind in ("triplets", "wide"):
        assert len(bins) < best_fit


def test_islands_gain_over_their_starts():
    rng = random.Random(2)
    lengths = np.array(triplets(rng, 1300))
    starts = [packing.fresh(lengths.tolist(), np.random.default_rng(0), 0.0, 1024).max() + 1, packing.completed(lengths.tolist(), 1024).max() + 1]
    out = packing.evolve(lengths, [], np.random.default_rng(0), island=1, generations=60)[0]
    assert (np.bincount(out, weights=lengths) <= 1024).all() and len(np.unique(out)) < min(starts) < max(starts)


# Quality rules


def test_statistics_and_repeated_windows():
    rng = random.Random(9)
    for _ in range(200):
        ids = [rng.randrange(3) for _ in range(rng.randrange(0, 30))]
        seen = Counter(tuple(ids[i : i + 5]) for i in range(len(ids) - 4))
        expected = [any(seen[tuple(ids[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(ids) - 5) + 1)) for i in range(len(ids))]
        assert textstats.repeated_windows(np.array(ids, np.int64)).tolist() == expected
    got = dict(zip(textstats.NAMES, textstats.statistics("Aé b#\nAé b#\n \n\nx $%".encode()), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_chars"], got["n_lines"]) == (6, 11, 4, 1, 19, 3)
    assert textstats.statistics(b"")[:5] == [0] * 5


def brute_posteriors(vote, rounds=400):
    """Plain expectation-maximisation document by document, as ``fit_votes`` states it."""
    number, m = vote.shape
    prior, against = quality_rules.GOOD, [[quality_rules.START[k]] * m for k in (0, 1)]
    good = prior
    for _ in range(rounds):
        p = []
        for row in vote:
            odds = math.log(good / (1 - good))
            for i, v in enumerate(row):
                a, b = against[0][i], against[1][i]
                odds += min(0.0, math.log(a / b)) if v < 0 else max(0.0, math.log((1 - a) / (1 - b))) if v > 0 else 0.0
            p.append(1 / (1 + math.exp(-odds)))
        s = quality_rules.STRENGTH
        good = (sum(p) + prior * s) / (number + s)
        for k, w in enumerate((p, [1 - x for x in p])):
            for i in range(m):
                no, yes = (sum(x for x, v in zip(w, vote[:, i], strict=True) if v == u) for u in (-1, 1))
                against[k][i] = (no + s * quality_rules.START[k]) / (no + yes + s)
    return p, against


def test_posteriors_equal_plain_estimation(spark):
    rng = np.random.default_rng(3)
    bad = rng.random(150) < 0.25
    vote = np.where(rng.random((150, len(quality_rules.RULES))) < np.where(bad, 0.35, 0.02)[:, None], -1, 1)
    vote[rng.random(vote.shape) < 0.2] = 0
    counts = Counter(quality_rules.pattern_of(vote).tolist())
    start, weights, against = quality_rules.fit_votes(sorted(counts.items()))
    expected, shares = brute_posteriors(vote)
    assert np.allclose(1 / (1 + np.exp(-quality_rules.odds_of(vote, start, weights))), expected, atol=1e-6)
    assert np.allclose(against, shares, atol=1e-6)
    assert ((np.array(expected) < 0.5) == bad).mean() > 0.95
    assert (weights[0] <= 0).all() and (weights[2] >= 0).all()
    one_against = (vote == -1).sum(axis=1) == 1
    assert (np.array(expected)[one_against & ~bad] > 0.5).any(), "one vote against does not decide"


def test_quality_rules_keep_clean_and_drop_junk(spark, messy, nothing):
    rng = random.Random(6)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."
    rows = [(i, plain(rng.randrange(30, 200))) for i in range(300)]
    rows += [
        (1000 + i, " ".join(w + "###" for w in plain(60).split())) for i in range(30)
    ] + [(2000 + i, ("spam spam ham eggs jam " * 20)) for i in range(10)]
    rows += [(3000 + i, " ".join(w.upper() + "!!" for w in plain(60).split())) for i in range(30)]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r["kept"] == (i < 1000) for i, r in out.items())
    judged = quality_rules.quality_rules(messy).collect()
    assert len(judged) == messy.count() and not any(r["kept"] for r in judged if r["doc_id"] in (103, 104, 105))
    rules = quality_rules.rule_accuracies(messy).collect()
    assert [r["rule"] for r in rules] == [r[0] for r in quality_rules.RULES] and all(
        0 <= r["against_good"] <= 1 and 0 <= r["against_bad"] <= 1 for r in rules
    )
    kept = quality_rules.drop_low_quality(messy)
    assert kept.columns == messy.columns and kept.count() == sum(r["kept"] for r in judged)
    passed = sum(not r["base_failed"] for r in judged)
    assert quality_rules.drop_low_quality(messy, threshold=0).count() == passed
    assert quality_rules.drop_low_quality(messy, threshold=1.1).count() == 0
    assert quality_rules.quality_rules(nothing).count() == 0 and quality_rules.drop_low_quality(nothing).count() == 0


# Languages


def test_languages(messy, nothing):
    out = {r["doc_id"]: r for r in language.identify_languages(messy, F.coalesce(F.col("doc_id") % 4 != 2, F.lit(False))).collect()}
    truth = {r["doc_id"]: r["lang"] for r in messy.collect()}
    held = [i for i in range(80) if i % 4 == 2]
    assert sum(out[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.95
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 and out[i]["rejected"] for i in (103, 104, 105, 109))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language.identify_languages(nothing, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language.identify_languages(messy, F.lit(False)).collect()} == {"und"}


@pytest.mark.parametrize("size", [language.DICTIONARY_BYTES, 5000])
def test_languages_of_short_or_long_texts_only(spark, size):
    rng = random.Random(12)
    stems = {"short": ["ba", "ke", "li", "to", "nu"], "long": ["shr", "und", "ach", "eit", "ver"], "mid": ["xo", "qui", "zy", "wam"]}
    rows = [(i, words(rng, stems["short"], rng.randrange(3, 10)), "short") for i in range(1000)]
    rows += [(2000 + i, words(rng, stems["long"], 5000), "long") for i in range(6)]
    rows += [(3000 + i, words(rng, stems["mid"], 40), "mid") for i in range(40)] + [(4000, "12 34", "digits"), (4001, None, "none")]
    assert max(len(t) for _, t, g in rows if g == "short") < 80 and min(len(t) for _, t, g in rows if g == "long") > 20000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.dictionaries(df, F.lit(True), "text", "lang", size)
    assert set(found) == {"short", "long", "mid"} and all(0 < len(d) <= size for d in found.values())
    assert len(found["short"]) > 0.95 * min(size, sum(len(language.fold(t)) for _, t, g in rows if g == "short"))
    out = language.identify_languages(df, F.col("doc_id") % 4 != 2).collect()
    truth = {i: g for i, _, g in rows}
    held = [r for r in out if r["doc_id"] % 4 == 2 and r["doc_id"] < 4000]
    assert {truth[r["doc_id"]] for r in held} == {"short", "long", "mid"} and sum(
        r["lang_pred"] == truth[r["doc_id"]] for r in held
    ) / len(held) > 0.95


def test_language_sizes_and_long_texts(spark):
    """The choice is that of plain compression by ``zstandard``; a long text is as sure as a short one."""
    import zstandard

    rng = random.Random(5)
    stems = {"x": ["ba", "ke", "li", "to", "nu"], "y": ["shr", "und", "ach", "eit", "ver"]}
    rows = [(i, words(rng, stems["x" if i % 2 else "y"], 40), "x" if i % 2 else "y") for i in range(200)]
    rows += [(1000, words(rng, stems["x"], 200_000), None), (1001, words(rng, stems["y"], 60), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identify_languages(df, F.col("doc_id") < 100).collect()}
    assert out[1000]["lang_pred"] == "x" and not out[1000]["rejected"] and out[1000]["score"] > 0.6
    assert out[1001]["lang_pred"] == "y" and not out[1001]["rejected"]
    learned = language.dictionaries(df, F.col("doc_id") < 100, "text", "lang")
    for i, text, _ in rows[100:]:
        folded, sizes = language.fold(text), {}
        assert b"".join(language.windows(folded)) == folded and max(map(len, language.windows(folded))) <= 1.5 * language.WINDOW
        for g, content in learned.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[g] = sum(len(c.compress(part)) for part in language.windows(folded))
        best = min(sizes.values())
        assert abs(sizes[out[i]["lang_pred"]] - best) <= 0.02 * best


def test_letters_are_those_of_one_definition(spark):
    rows = [(i, "wo ord te ext " * 5, "x") for i in range(3)] + [(10, "7 " * 15_000 + "sh und ver " * 20, "late")]
    asked = {20: "\u00b2", 21: "\u00bd \u2460 \u2167", 22: "\u0661\u0662 _ 12", 23: "\u4e2d\u6587", 24: "\u00e9", 25: "\u02b0", 26: "\u0301", 27: "sh und ver"}
    df = spark.createDataFrame(rows + [(i, t, None) for i, t in asked.items()], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identify_languages(df, F.col("doc_id") < 20).collect()}
    assert [i for i in asked if out[i]["lang_pred"] == "und"] == [20, 21, 22, 26]
    assert out[10]["lang_pred"] == out[27]["lang_pred"] == "late"


def test_many_languages_share_the_bytes(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text {chr(97 + i // 26 % 26)}", f"l{i}") for i in range(300)]
    found = language.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), "text", "lang", total=3000)
    assert len(found) == 300 and all(0 < len(d) <= 10 for d in found.values())


# Chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "[\\INST] <\\/s> \\", "<s><s>[INST][/INST]</s></s>", "", "plain", "[/INST]</", "<", None, "é 😀 \\<\\s>"]
    rng = random.Random(8)
    rows = [
        (
            c, t, rng.choice(["user", "assistant", "system", "</s>", None]), rng.choice(nasty),
        ) for c in [*range(12), None] for t in range(rng.randrange(1, 7))
    ]
    rows += [(50, None, "assistant", "null turn"), (50, 1, "user", "a"), (50, 1, "user", "a"), (51, 0, "user", "no answer")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, whole string, ends string")
    examples = chat.prefix_target_examples(df)
    found = chat.digest_examples(examples).collect()
    out = {r["conv_id"]: r for r in found if r["conv_id"] is not None}
    convs, alone = defaultdict(list), []
    for c, t, role, text in rows:
        (alone if c is None else convs[c]).append((t is None, t or 0, role or "", text or ""))
    assert out.keys() == convs.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        assert (
            out[c]["n_turns"], out[c]["turns_sha256"], out[c]["loss_chars"], out[c]["loss_sha256"],
        ) == (len(turns), sha(said), len(loss), sha(loss))
    # A row without a conversation id is a conversation of its own.
    assert sorted((r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in found if r["conv_id"] is None) == sorted(
        (1, sha(f"{t[2]}\n{t[3]}\n"), len(t[3]) if t[2] == "assistant" else 0) for t in alone
    )
    each = examples.filter("trained and conv_id is not null").groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in each} == {c: n for c, ts in convs.items() if (n := sum(t[2] == "assistant" for t in ts))}
    assert all(r["text"].endswith("</s>") and r["text"][r["loss_start"] + r["loss_length"] :] == "</s>" for r in examples.filter("trained").collect())
    assert chat.digest_examples(chat.prefix_target_examples(df.filter("false"))).count() == 0


# WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(7)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    body = "".join(rng.choice("abcdef <>/\r\n") for _ in range(3000))
    pages = [(i, f"http://h/{i} x\r\n", f"<p>{i}</p>" + body[: rng.randrange(0, 2500)]) for i in range(60)]
    pages += [(100, None, body), (101, "u", body), (102, "u", body), (103, "u", body[:900]), (104, "u", body[:900]), (105, "u", None), (106, "u", "")]
    pages += [
        (107, "u", fake), (108, "u", "x" + fake * 20 + "y"), (109, "u", "é" * 600 + "WARC/1.0\r\n"), (110, "u", "WARC/1.0\r\n" * 3),
        (111, "u", "é" * 600 + "WARC/1.0\r\n"),
    ]
    df = spark.createDataFrame([(*p, "e", "f") for p in pages], "page_id long, url string, html string, value string, _sha string").repartition(3)
    payload = {i: (h or "").encode() for i, _, h in pages}
    top = {b: max(i for i, x in payload.items() if x == b) for b in payload.values()}
    expected = sorted(
        (i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", top[b]) if len(b) >= 1000 and top[b] != i else ("response", None))) for i,
        b in payload.items()
    )
    path = str(tmp_path / "archive")
    out = warc.archive_round_trip(df, path)
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == expected
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("777", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert sorted((tuple(r) for r in warc.read_warc(spark, path).collect()), key=lambda r: r[0]) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert warc.archive_round_trip(df.filter("false"), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("segment", [300, 4000, 8 << 20])
def test_warc_chains_over_segments(spark, tmp_path, segment):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, "u", f"<p>{i}</p>" + ("z" * (40 * i) + fake) * (i % 5)) for i in range(60)]
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path)
    out = sorted((r["page_id"], r["payload_digest"]) for r in warc.read_warc(spark, path, segment=segment).collect())
    assert out == [(i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in pages]


def test_warc_revisits_of_repeated_ids(spark, tmp_path):
    one, two = "a" * 1500, "b" * 2000
    pages = [(5, "u", one), (5, "u", two), (1, "u", one), (2, "u", two)]
    out = warc.archive_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"), str(tmp_path / "archive"))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    expected = [
        (1, 1500, sha(one), "revisit", 5), (2, 2000, sha(two), "revisit", 5), (5, 1500, sha(one), "response", None),
        (5, 2000, sha(two), "response", None),
    ]
    assert sorted(tuple(r) for r in out.collect()) == expected


def test_warc_string_ids_come_back_whole(spark, tmp_path):
    ids = ["a>\r\nWARC-Type: revisit", "a>", "<urn:page:b>", "é %41+ c", "plain-1", "\n", "%"]
    pages = [(x, "u", f"page {i}") for i, x in enumerate(ids)] + [("y>\r\n", "u", "z" * 1200), ("z>\r\n", "u", "z" * 1200), (None, "u", "none")]
    out = warc.archive_round_trip(spark.createDataFrame(pages, "page_id string, url string, html string"), str(tmp_path / "archive")).collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert {(r["page_id"], r["payload_digest"]) for r in out} == {(x, sha(h)) for x, _, h in pages}
    assert len(out) == len(pages)
    assert [(r["page_id"], r["refers_to"]) for r in out if r["record_type"] == "revisit"] == [("y>\r\n", "z>\r\n")]


def test_warc_chain_ends_at_a_damaged_record(spark, tmp_path):
    head = "HTTP/1.1 200 OK\r\nA: bcd\r\n\r\n"
    record = lambda i, body, more=0: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(head + body) + more}\r\n\r\n{head}{body}\r\n\r\n"
    (tmp_path / "archive").mkdir()
    (tmp_path / "archive/part").write_bytes((record(1, "one") + record(2, "two", 7) + record(3, "three")).encode())
    assert [
        r["page_id"] for r in warc.read_warc(spark, str(tmp_path / "archive")).collect() if r["payload_digest"] == hashlib.sha1(b"one").hexdigest()
    ] == [1]
    assert all(r["page_id"] != 3 for r in warc.read_warc(spark, str(tmp_path / "archive")).collect())


def test_warc_reads_may_split_differently(spark, tmp_path, monkeypatch):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(i, "u", f"<p>{i}</p>" + ("z" * 300 + fake) * (i % 4)) for i in range(40)]
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    reads, sizes, before = warc._pieces, iter(["777", "5000"] * 2), spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(warc, "_pieces", lambda *a: spark.conf.set("spark.sql.files.maxPartitionBytes", next(sizes)) or reads(*a))
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = sorted((r["page_id"], r["payload_digest"]) for r in warc.read_warc(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert out == [(i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in pages]
