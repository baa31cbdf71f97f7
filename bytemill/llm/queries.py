"""The queries of this folder's operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytemill.llm import exact_dedup, langid, line_dedup, mixing, packing, pii, ppm, quality_rules, simhash, weak_quality
from bytemill.plans.scratch import put_on_path, short_batches, spread, stage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    put_on_path(spark)
    short_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = stage(mixing.sized(documents(spark, sf_dir)).select("doc_id", "source", "size", "_draw"), "sized")
    return mixing.with_copies(slim).select("doc_id", "size", "source_size", "target", "taken")


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.score(documents(spark, sf_dir)).select("doc_id", "posterior", "score", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).select("doc_id", *quality_rules.ADDED)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.lm_scores(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out(F.col("doc_id"), 3, 1)
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs.filter(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_weak_quality, op4_quality_rules, op5_pii, op6_exact_dedup, op7_simhash, op8_ppm, op9_line_dedup, op10_language_id)}
SQL = {"op2_mixing": mixing.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE}
