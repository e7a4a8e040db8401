from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from axistab.llm import mixing, packing, quality_rules, queries
from axistab.llm.common import stage
from tests.llm.conftest import messy_rows
from tests.llm.test_similar import brute_groups
from tests.oracle import connect, difference


def test_stages_over_messy_documents(spark, messy):
    """Each stage against a plain version of it over the rows that the one before it kept."""
    docs, seen = messy, {}
    for name, f in corpus_pipeline.STAGES:
        before, docs = docs, stage(f(spark, docs, ""), name)
        seen[name] = [(r["doc_id"], r["text"], r["source"]) if name != "best_fit_packing" else r for r in docs.collect()]
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")

    judged = quality_rules.quality_rules(messy).filter("kept").collect()
    assert sorted(Counter(r["doc_id"] for r in judged).items()) == sorted(Counter(r[0] for r in seen["quality_rules"]).items())

    groups = defaultdict(list)
    for r in seen["quality_rules"]:
        groups[(r[1] or "").encode().translate(None, b" \t\n\r\x0b\x0c")].append(r)
    best = [min(g, key=lambda r: (-len(r[1] or ""), *key(r))) for g in groups.values()]
    assert sorted(map(key, seen["exact_dedup"])) == sorted(map(key, best))

    roots = brute_groups([(r[0], r[1]) for r in seen["exact_dedup"]])
    leads = [min((key(r) for r, x in zip(seen["exact_dedup"], roots, strict=True) if x == root)) for root in set(roots)]
    assert sorted(map(key, seen["near_dedup"])) == sorted(leads)

    taken = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix_sources(docs_of(spark, seen["near_dedup"])).collect()}
    words = lambda t: len((t or "").encode().split())
    times = Counter((r[0], words(r[1])) for r in seen["mix_sources"])
    assert all(times[i, n] * n == taken[i, n] for i, n in taken) and times.keys() <= taken.keys()

    texts = {r[0]: r[1] for r in messy_rows()}
    ids, expected = packing.encoder(*queries.tokenizer()).ids, []
    for d, _, _ in seen["mix_sources"]:
        blob = ids(texts[d] or "") + np.array([2], "<u4").tobytes()
        expected += [(d, k, zlib.crc32(blob[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(packing.cut(len(blob) // 4))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen["best_fit_packing"]) == sorted(expected)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


#: Columns of each query whose result no SQL gives, in order.
COLUMNS = {
    "op1_brown_scores": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op3_quality_discriminant": "doc_id held_out score predicted",
    "op4_mix_sources": "doc_id size source_size target taken",
    "op5_simhash_components": "doc_id fingerprint component_id",
    "op6_pack_sequences": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept quality",
    "op8_identify_languages": "doc_id held_out lang_pred score margin rejected",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_over_its_whole_table(spark, sf_dir, name):
    out = queries.queries()[name](spark, sf_dir)
    assert out.columns == COLUMNS[name].split()
    rows, ids = out.collect(), sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    assert (sorted({r["doc_id"] for r in rows}) == ids) if name.startswith("op6") else (sorted(r["doc_id"] for r in rows) == ids)
    fold = {"op1_brown_scores": (5, 1), "op3_quality_discriminant": (5, 0), "op8_identify_languages": (4, 2)}.get(name)
    if fold:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) for r in rows)
    if name.startswith("op3"):
        assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_pipeline_runs_over_its_tables(spark, sf_dir):
    assert queries.queries().keys() >= set(COLUMNS) and corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert difference(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], connect(sf_dir)) == ""
