"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from axistab.llm import merkle
from axistab.llm.queries import oracle_sql, queries
from tests.oracle import connect, difference

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row[c] for c in FIELDS[:-1]] + [text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(level):
    """Every level up to the root, as lists."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings_of(levels, i):
    out = []
    for level in levels[:-1]:
        run = range(i // 8 * 8, min(i // 8 * 8 + 8, len(level)))
        out.append(([level[j] for j in run if j < i], [level[j] for j in run if j > i]))
        i //= 8
    return out


def audited(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    levels = {t: climbed([leaf_of(r) for r in own]) for t, own in trees.items()}
    last = climbed([levels[t][-1][0] for t in names])
    out = []
    for t in names:
        for i, r in enumerate(trees[t]):
            path = siblings_of(levels[t], i) + siblings_of(last, names.index(t))
            bent = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            fold = leaf_of(r, bent)
            for left, right in path:
                fold = h(*left, fold, *right)
            out.append((r["doc_id"], leaf_of(r), levels[t][-1][0], last[-1][0], h(*(x for a, b in path for x in a + b)), fold, fold == last[-1][0]))
    return sorted(out, key=repr)


def run(df, **options):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [F.col(c) for c in FIELDS]
    now = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest_of([*fields[:-1], lowered]))
    return merkle.audited(df, fields, now, **options)


@pytest.mark.parametrize("leaves", [1, 2, 7, 8, 9, 63, 64, 65, 100, 513, 777])
def test_positions_are_those_of_the_log(leaves):
    digests = [h(str(i)).encode() for i in range(leaves)]
    made = merkle.completed(digests, 0, leaves, merkle.height(leaves))
    assert [merkle.position(level, i, leaves) for level, i, _ in made] == list(range(len(made)))
    assert [d.decode() for *_, d in made if d] and made[-1][2].decode() == climbed([d.decode() for d in digests])[-1][0]


def test_audit_equals_a_plain_tree(spark, messy, nothing):
    out = run(messy)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=repr) == audited(messy.collect())
    assert run(nothing).count() == 0
    one = messy.filter("doc_id = 5")
    assert sorted(map(tuple, run(one).collect())) == audited(one.collect())
    bare = messy.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "text": F.concat(F.lit("AB"), "text")})
    got = run(bare).collect()
    assert sorted(map(tuple, got), key=repr) == audited(bare.collect()) and {r["verified"] for r in got} == {True, False}


def test_builders_of_several_rounds(spark):
    """Two levels a builder: trees of 700, 64, 65 and 1 leaves take up to three rounds, and 80 trees two more."""
    rows = [(i, f"T{i % 7}", "a" if i < 700 else "b" if i < 764 else "c" if i < 829 else f"t{i}", "s", i) for i in range(909)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    fields = [F.col(c) for c in FIELDS]
    made = merkle.manifest(df, fields, carried={"doc_id": F.col("doc_id")}, levels=2)
    fold = merkle.folded(F.col("leaf"), F.col("path"), F.col("before"), F.col("after"))
    got = made.proofs().select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("path")), 256).alias("p"), fold.alias("f")).collect()
    assert sorted(map(tuple, got)) == [r[:5] + (r[3],) for r in sorted(audited(df.collect()))]
    at = {}
    for r in sorted(made.log.records().collect(), key=lambda r: (r["_tree"], r["start"])):
        assert r["start"] == at.get(r["_tree"], 0)
        at[r["_tree"]] = r["start"] + len(r["nodes"]) // 32
    assert at["+a"] == sum(len(level) for level in climbed(["x"] * 700)) and at["+t900"] == 1


def test_a_tree_over_many_segments(spark):
    df = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.lit("Aa").alias("text"), F.lit("x").alias("lang"), F.lit(None).cast("string").alias("source"),
        F.lit(2).cast("long").alias("n_chars"),
    )
    assert sorted(map(tuple, run(df).collect()), key=repr) == audited(df.collect())


def test_query_equals_its_sql(spark, sf_dir):
    assert difference(queries()["op12_merkle_manifest"](spark, sf_dir), oracle_sql()["op12_merkle_manifest"], connect(sf_dir)) == ""
