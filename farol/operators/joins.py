"""Joins against dimensions, reference tables and one-row aggregates.

No side carries a hint: adaptive execution broadcasts one only when its measured size is below
``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], take: list[str]) -> DataFrame:
    """Left join that adds ``take`` from a dimension with unique keys; null = null matches."""
    side = dim.select(*[F.col(d).alias(f"__k{i}") for i, d in enumerate(on.values())], *take)
    pairs = [(s, f"__k{i}") for i, s in enumerate(on)]
    joined = fact.join(side, _null_safe(fact, side, pairs), "left")
    return joined.drop(*[k for _, k in pairs])


def hot_hashes(df: DataFrame, keys: dict[str, list[str]], share: float = 0.02) -> dict[str, list[int]]:
    """Per key set, the hashes of the key values that hold more than ``share`` of all rows.

    All key sets are counted in one pass; at most 1 / share hashes each reach the driver.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("name"), F.xxhash64(*columns).alias("hash"))
                      for name, columns in keys.items()])
    counts = df.select(F.explode(cells).alias("k")).groupBy("k.name", "k.hash").agg(F.count("*").alias("rows"))
    total = df.select(F.count("*").alias("t")).scalar()
    found: dict[str, list[int]] = {name: [] for name in keys}
    for row in counts.where(F.col("rows") > total * F.lit(share)).toLocalIterator():
        found[row["name"]].append(row["hash"])
    return found


def salted_lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], take: list[str], spread: list[str],
                  hot: list[int] | None = None, salt: int = 32, share: float = 0.02) -> DataFrame:
    """``lookup`` for a fact in which a few key values hold most rows.

    Rows of a hot key are spread over ``salt`` values and only the matching dimension rows are
    repeated that often. ``spread`` names columns that tell rows apart, copies included; their
    hash is the salt, so a task that runs again sends every row where it went before. ``hot``
    gives the hashes of the hot keys when they are known. Key columns of both sides must have
    the same types, as the hash depends on them.
    """
    hashes = hot if hot is not None else hot_hashes(fact, {"key": list(on)}, share)["key"]
    if not hashes:
        return lookup(fact, dim, on, take)
    targets = [f"__k{i}" for i in range(len(on))]
    left = fact.withColumn("__salt", F.when(
        F.xxhash64(*on).isin(hashes), F.pmod(F.xxhash64(*spread), F.lit(salt))).otherwise(F.lit(0)).cast("int"))
    side = dim.select(*[F.col(d).alias(k) for d, k in zip(on.values(), targets)], *take)
    copies = F.when(F.xxhash64(*targets).isin(hashes), F.sequence(F.lit(0), F.lit(salt - 1)))
    side = side.withColumn("__dsalt", F.explode(copies.otherwise(F.array(F.lit(0)))))
    cond = _null_safe(left, side, list(zip(on, targets))) & (left["__salt"] == side["__dsalt"])
    return left.join(side, cond, "left").drop("__salt", "__dsalt", *targets)


def new_rows(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not yet in ``known``; null = null counts as the same key."""
    side = known.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    return incoming.join(side, _null_safe(incoming, side, [(k, f"__k{i}") for i, k in enumerate(keys)]), "left_anti")


def members(df: DataFrame, reference: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose key tuple occurs in the reference (semi-join).

    The reference is reduced to its distinct keys, map side first, so copies of a key in it cost
    nothing; the join then uses the same partitioning.
    """
    side = reference.select(*[F.col(r).alias(f"__k{i}") for i, r in enumerate(on.values())]).distinct()
    cond = reduce(lambda a, b: a & b, [df[s] == side[f"__k{i}"] for i, s in enumerate(on)])
    return df.join(side, cond, "left_semi")


def complete_domain(domain: DataFrame, data: DataFrame, key: str, fill: float = 0) -> DataFrame:
    """Every value of the domain with its data; numbers missing there become ``fill``."""
    return domain.select(key).join(data, key, "left").fillna(fill)


def where_latest(df: DataFrame, column: str, among: Column | None = None) -> DataFrame:
    """Rows at the highest value of ``column``, optionally the highest among a filter."""
    source = df if among is None else df.where(among)
    return df.where(F.col(column) == source.select(F.max(column)).scalar())
