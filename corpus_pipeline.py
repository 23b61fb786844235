"""A corpus clean-up in five stages; each stage is one operator of the llm subpackage and reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pdpspark.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from pdpspark.llm.common import scratch, table
from pdpspark.llm.queries import toxicity_model, word_tokenizer


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go; null and empty texts stay."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go but for their first place; every document stays, n_chars follows its text."""
    cleaned = line_dedup.drop_spread_lines(docs)
    return cleaned.selectExpr(*["if(n_removed > 0, length(text), n_chars) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns]).to(docs.schema)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows with a null id stay."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences."""
    return packing.pack(docs, word_tokenizer())


STAGES = [("toxicity", clean_toxicity), ("line_dedup", drop_lines), ("near_dedup", drop_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: A tokenizer and a fitted model are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written in the shared folder and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
