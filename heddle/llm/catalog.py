"""The registered corpus queries: each reads whole tables and returns its full result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import chat, exact_dedup, langid, mixing, packing, quality_model, quality_rules, secrets, simhash, substring
from heddle.llm.common import remainder, table
from heddle.llm.oracle import SQL


def vocabulary() -> str:
    """The public vocabulary that packing encodes with; every executor has it installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("picks")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    found = quality_model.classify(table(spark, sf_dir, "documents"), labels, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.windows(turns.unionByName(own)))


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_secret_scan": op3_secret_scan,
        "op4_mix_sources": op4_mix_sources,
        "op5_simhash_near_dedup": op5_simhash_near_dedup,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_chat_format": op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in queries()}
