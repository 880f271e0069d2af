"""Statistics over question pairs and the question/SQL catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farol.functions.text import squeeze_space
from farol.operators.quantiles import exact_quantiles

RECORD_SCHEMA = T.StructType([
    T.StructField("original_nl_query", T.StringType()),
    T.StructField("nl_query", T.StringType()),
    T.StructField("sql_query", T.StringType()),
    T.StructField("complexity", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("tables_involved", T.ArrayType(T.StringType())),
    T.StructField("generation_metadata", T.StructType([T.StructField("original_sql", T.StringType())])),
])


def stats_by_original(scored: DataFrame, original: str, metrics: list[str]) -> DataFrame:
    """Pairs per original, with mean and exact median of every metric."""
    means = scored.groupBy(original).agg(
        F.count("*").alias("pairs"), *[F.avg(m).alias(f"{m}_mean") for m in metrics])
    long = scored.unpivot([original], metrics, "__metric", "__score")
    medians = exact_quantiles(long, [original, "__metric"], "__score", {"__median": 0.5}).groupBy(original).agg(
        *[F.max(F.when(F.col("__metric") == m, F.col("__median"))).alias(f"{m}_median") for m in metrics])
    return means.join(medians, original, "left")


def overall_stats(scored: DataFrame, original: str, metric: str) -> DataFrame:
    """Originals, pairs, mean, exact median and population deviation of one metric."""
    moments = scored.agg(
        F.count_distinct(original).alias("originals"), F.count(metric).alias("pairs"),
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))
    middle = exact_quantiles(scored, [], metric, {"median": 0.5})
    return moments.withColumn("median", middle.select("median").scalar())


def catalogue_counts(records: DataFrame) -> DataFrame:
    """Records per complexity, per query type and per table, counted in one pass."""
    def entry(kind: str, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    entries = F.concat(
        F.array(entry("complexity", F.col("complexity")), entry("query_type", F.col("query_type"))),
        F.transform("tables_involved", lambda t: entry("table", t)))
    return records.select(F.explode(entries).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("records"))


def paraphrase_counts(records: DataFrame) -> DataFrame:
    """Per original: paraphrases, and how many keep the SQL up to white space."""
    same = squeeze_space(F.col("sql_query")) == squeeze_space(F.col("generation_metadata.original_sql"))
    return records.groupBy("original_nl_query").agg(
        F.count("*").alias("paraphrases"), F.count_if(same).alias("same_sql"))
