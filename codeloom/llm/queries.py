"""The registered queries of the operators: each applies one of them, with its production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, decontaminate, filter_audit, importance, mixing, pii, quality_model, quality_rules, secrets, simhash, substring_dedup, token_output, toxicity
from codeloom.llm.common import read
from codeloom.llm.sql import SQL


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.withColumn("spans", spans)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken")
    )


def _span_digests(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    counts = [secrets.count("spans", k).alias(f"n_{k}") for k in kinds]
    return rows.select("doc_id", *counts, F.sha2(secrets.joined("spans", base_only=True), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.find_personal_data(read(spark, sf_dir, "documents")), pii.KINDS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(read(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.digest(token_output.encode(read(spark, sf_dir, "documents")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secrets.find_secrets(read(spark, sf_dir, "documents")), secrets.KINDS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = toxicity.fold("doc_id", 5) == 0
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), held_out=held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold("doc_id", 3) == 1
    out = quality_model.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out=held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"))))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
