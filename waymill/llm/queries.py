"""The registered query of each corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymill.llm import chat, html_extract, lattice, merkle, mixing, mixing_model, periods, simhash, suffix_dedup, tokens, toxicity, warc, winnow
from waymill.llm.common import table

#: The conversation that op4 adds: texts full of control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), ("source", "text"), tokens.bare_lines).drop("section_names")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_model.scores(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_tokens", "weight", "block", "position", "copies")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (
            op1_html_extraction,
            op2_simhash_near_dedup,
            op3_token_counts,
            op4_chat_formatting,
            op5_benchmark_decontamination,
            op6_embedding_near_dedup,
            op7_toxicity,
            op8_lm_scoring,
            op9_suffix_array_dedup,
            op10_source_mixing,
            op11_merkle_manifest,
            op12_periodic_runs,
            op13_warc,
        )}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": chat.ORACLE_SQL, "op5_benchmark_decontamination": winnow.ORACLE_SQL, "op6_embedding_near_dedup": lattice.ORACLE_SQL, "op9_suffix_array_dedup": suffix_dedup.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_periodic_runs": periods.ORACLE_SQL, "op13_warc": warc.ORACLE_SQL}
