"""A training corpus from raw documents: filtered, deduplicated, decontaminated and mixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farol.llm.common import Stages, ready
from farol.llm.decontaminate import clean_documents
from farol.llm.jaccard import without_near_duplicates
from farol.llm.mixing import mixed_documents
from farol.llm.quality import kept_documents
from farol.llm.suffix_dedup import deduplicated


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates (five words, similarity 0.8)."""
    return without_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document has."""
    return deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per copy of a document in it, in the order of virtual finish times."""
    return mixed_documents(docs).orderBy("finish", "source", "doc_id")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("suffix_dedup", suffix_dedup),
          ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

#: The language model and the banded alignment have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as a table before the next one reads it."""
    stages = Stages(ready(spark))
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stages.put(name, stage(spark, docs, sf_dir))
        if before:
            stages.drop(before)
        before = name
    return docs
