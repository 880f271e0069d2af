"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farol.llm.chat_tree import chat_digests
from farol.llm.common import Job
from farol.llm.decontaminate import contaminated
from farol.llm.exact_dedup import copy_groups
from farol.llm.jaccard import near_duplicates
from farol.llm.language import predicted_languages
from farol.llm.licenses import license_scan
from farol.llm.mixing import mixed
from farol.llm.oracles import ORACLES
from farol.llm.quality import judged
from farol.llm.ranked_search import ranked
from farol.llm.revisits import revisit_digests
from farol.llm.suffix_dedup import digest
from farol.llm.url_filter import judged_urls
from farol.llm.whitening import whitened

QUERIES: dict[str, Job] = {}


def query(job: Job) -> Job:
    QUERIES[job.__name__] = job
    return job


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_suffix_dedup(spark, folder):
    return digest(table(spark, folder, "documents"), length=50)


@query
def op2_decontaminate(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


@query
def op3_chat_tree(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_digests(rows.unionByName(more))


@query
def op4_quality_rules(spark, folder):
    return judged(table(spark, folder, "documents")).drop("text_hash")


@query
def op5_license_scan(spark, folder):
    return license_scan(table(spark, folder, "documents"))


@query
def op6_weighted_fair_mix(spark, folder):
    return mixed(table(spark, folder, "documents"))


@query
def op7_language_id(spark, folder):
    return predicted_languages(table(spark, folder, "documents"))


@query
def op8_ngram_jaccard(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), percent=85, shingle=4).select("doc_id", "n_shingles", "component_id")


@query
def op9_revisits(spark, folder):
    return revisit_digests(table(spark, folder, "pages"))


@query
def op10_url_filter(spark, folder):
    return judged_urls(table(spark, folder, "pages"))


@query
def op11_ranked_search(spark, folder):
    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op12_exact_dedup(spark, folder):
    return copy_groups(table(spark, folder, "documents"), text_sha256=F.sha2(F.coalesce("text", F.lit("")), 256))


@query
def op13_whitening(spark, folder):
    rows = whitened(table(spark, folder, "embeddings"))
    return rows.select("vec_id", "n", "deviation", "identity_error", F.inline(F.transform(F.arrays_zip("white", "explained"), lambda c, i: F.struct(
        (i + 1).cast("int").alias("component"), c["white"].alias("whitened"), c["explained"].alias("explained")))))


__all__ = ["ORACLES", "QUERIES"]
