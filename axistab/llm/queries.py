"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axistab.llm import brown, chat, exact_dedup, language, merkle, mixing, negatives, packing, qda, quality_rules, simhash, vantage, warc
from axistab.llm.common import held_out, read_table


def tokenizer() -> tuple[str, str, int]:
    """The public 50k byte-level BPE: its ranks (the same vocabulary as its json file), pattern and special id."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(read_table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = "crc32(cast(_id as string)) % 5 <> 0"
    scored = qda.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer())


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op8_identify_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_languages(read_table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 4, 2))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digest_examples(chat.prefix_target_examples(known.unionByName(extra)))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.digest_of([*fields, lowered]))
    return merkle.audited(docs, [*fields, F.col("text")], tampered)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict:
    return {
        f.__name__: f for f in (
            op1_brown_scores, op2_exact_dedup, op3_quality_discriminant, op4_mix_sources, op5_simhash_components, op6_pack_sequences,
            op7_quality_rules, op8_identify_languages, op9_format_conversations, op10_warc_round_trip, op11_hard_negatives,
            op12_merkle_manifest, op13_nearest_neighbours,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL, "op9_format_conversations": chat.ORACLE_SQL, "op10_warc_round_trip": warc.ORACLE_SQL,
        "op11_hard_negatives": negatives.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL,
        "op13_nearest_neighbours": vantage.ORACLE_SQL,
    }
