"""Rankings, first rows per group, modes, counts and repeatable samples.

``row_number() <= k`` filters are cut per partition before the shuffle (WindowGroupLimit), so
a group that holds most rows sends k rows per task, not itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = str | Column


def top_k(df: DataFrame, order: list[Order], k: int) -> DataFrame:
    """First k rows in total order; the caller's last key breaks ties."""
    return df.orderBy(*order).limit(k)


def first_rows(df: DataFrame, keys: list[str], order: Iterable[Order], k: int = 1) -> DataFrame:
    """First k rows of every group in the given order."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") <= k).drop("__rn")


def latest_rows(df: DataFrame, key: str, date: str, ties: list[Order]) -> DataFrame:
    """Newest row per key; equal dates are decided by ``ties``."""
    return first_rows(df, [key], [F.desc_nulls_last(date), *ties])


def keep_first(df: DataFrame, keys: list[str], order: list[Order]) -> DataFrame:
    """Drop later duplicates of a key, first row in the given order wins."""
    return first_rows(df, keys, order)


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    """Rows per value; the null group only with ``dropna=False``."""
    source = df.where(F.col(column).isNotNull()) if dropna else df
    return source.groupBy(column).agg(F.count("*").alias("records"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return top_k(value_counts(df, column), [F.desc("records"), F.asc(column)], k)


def group_mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest among equals."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("records"))
    return first_rows(counts, keys, [F.desc("records"), F.asc(column)])


def duplicate_total(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows whose key occurs more than once, all copies counted."""
    copies = df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    return copies.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"))


def stable_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of seed and keys; repeatable on any partitioning and in any engine."""
    text = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return df.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), *text)), *keys).limit(n)


def max_then_sum(df: DataFrame, unit: list[str], period: str, metrics: list[str]) -> DataFrame:
    """Highest value per unit and period, then totals per period: copies count once."""
    once = df.groupBy(*unit, period).agg(*[F.max(m).alias(m) for m in metrics])
    return once.groupBy(period).agg(*[F.sum(m).alias(m) for m in metrics])
