"""From raw documents to a training mixture: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm import mixing, shingles, suffix_dedup, toxicity, winnow
from waymill.llm.common import packed, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain trained on the labels calls toxic go.

    Null and empty texts have no words and are judged by the constant alone. Rows that repeat stay or go
    together. An empty table stays empty; without labels nothing goes. No column name clashes: the row travels
    as one value beside the text.
    """
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), without=("text",))
    clean = toxicity.toxicity(rows, table(spark, sf_dir, "labels")).where("NOT is_toxic")
    return clean.select(*[F.col("text") if c == "text" else clean["_row"].getField(c).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays: of texts whose SimHash fingerprints (as in op2) differ in two bits
    or fewer, and of those with Jaccard 0.8 and more over five-word shingles, which SimHash misses in part.

    Null, empty and blank texts are copies of each other. Rows with a null doc_id all stay, of rows that repeat
    a kept doc_id the one that sorts first. An empty table stays empty; any column name may be there.
    """
    return shingles.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that an earlier text holds are cut out; a text may become empty, its row stays.

    A null text becomes empty; n_chars, where there is one, follows the text. Every row and column stays; an empty
    table stays empty; any column name may be there.
    """
    rows = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), without=("text", "n_chars"))
    kept = suffix_dedup.dedup(rows, keep_text=True, carry=("_row",))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else kept["_row"].getField(c).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, and with them every row of the same doc_id.

    Null texts have no words and stay, and so do rows with a null doc_id. An empty table stays empty; any column name
    may be there.
    """
    narrow = docs.select("doc_id", "text")
    bad = winnow.contamination(narrow, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(bad.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document with the number of its copies; those with none go.

    Null sources are one source; null and empty texts have no tokens and follow their neighbours. Columns
    named like the five new ones are replaced. An empty table stays empty.
    """
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

#: The chain of stages holds a trained classifier and iterated links, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
