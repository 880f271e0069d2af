"""Exact quantiles of any column and group without gathering a group in one task.

``percentile`` and ``median`` keep every distinct value of a group in one buffer. Here rows
are first counted per (group, value) and staged. The value range is cut into as many ranges of about equally
many of these counts as the data asks for, and only ranges that hold a wanted rank go on: they are cut again while they
are too large, and sorted at last. Range bounds come from a sketch; they steer the work split and do not touch the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farol.session import staged

#: (group, value) counts that a range holds about, and ranges of one round at most.
RANGE_ROWS, MOST_RANGES = 20_000, 4096


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null; the right side's keys go."""
    side = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(side[f"__r{i}"]) for i, k in enumerate(keys)], F.lit(True))
    return left.join(side, on, how).drop(*[f"__r{i}" for i in range(len(keys))])


def _ranged(counts: DataFrame, ranges: int) -> DataFrame:
    """Counts with the number of the range of their value, from 0; all groups share the bounds."""
    shares = [F.lit(i / ranges) for i in range(1, ranges)]
    bounds = counts.select(F.percentile_approx("__v", F.array(*shares), F.lit(100 * ranges))).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length() - 1))])
    # binary search: how many bounds lie below the value
    return counts.withColumn("__bounds", bounds).withColumn("__b", F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(F.element_at("__bounds", at + step) < F.col("__v"), at + step).otherwise(at),
    )).drop("__bounds")


def _values_at(counts: DataFrame, rows: int, keys: list[str], wanted: DataFrame, range_rows: int) -> DataFrame:
    """(group, name, at, rank, value) of the wanted ranks (from 0) of each group; ``counts`` are ``rows`` staged rows."""
    ranges = min(MOST_RANGES, 1 << max(0, (rows // range_rows).bit_length()))
    if ranges > 1:
        spread = _ranged(counts, ranges)
        running = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        # at most ``ranges`` rows per group
        sizes = spread.groupBy(*keys, "__b").agg(F.sum("__c").alias("__n")).withColumn(
            "__before", F.coalesce(F.sum("__n").over(running), F.lit(0)))
        inside = (F.col("__rank") >= F.col("__before")) & (F.col("__rank") < F.col("__before") + F.col("__n"))
        wanted = _matched(sizes, wanted, keys, "inner").where(inside).select(
            *keys, "__b", "__name", "__at", "__whole", (F.col("__rank") - F.col("__before")).alias("__rank"))
        _, wanted = staged(wanted, "quantile-ranks")
        keys = [*keys, "__b"]
        counts = _matched(spread, wanted.select(*keys).distinct(), keys, "left_semi")
        if rows > 4 * ranges * range_rows:
            # ranges are still large: those that are wanted are cut again, as long as that leaves the greater part out
            name = f"__b{len(keys)}"
            _, counts = staged(counts.withColumnRenamed("__b", name), "quantile-range")
            wanted, keys, left = wanted.withColumnRenamed("__b", name), [*keys[:-1], name], counts.count()
            if 2 * left <= rows:
                return _values_at(counts, left, keys, wanted, range_rows)
    order = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("__from", F.coalesce(F.sum("__c").over(order), F.lit(0)))
    covers = (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__from") + F.col("__c"))
    return _matched(placed, wanted, keys, "inner").where(covers)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float], weight: str | None = None,
                    range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per group with a column per named point, linear between neighbouring ranks.

    ``weight`` names a column that says how often a row counts.
    """
    number, own = F.col(value).cast("double"), [f"__k{i}" for i in range(len(keys))]
    times = F.count("*") if weight is None else F.sum(F.col(weight).cast("bigint"))
    _, counts = staged(df.where(number.isNotNull()).groupBy(
        *[F.col(c).alias(k) for c, k in zip(keys, own)], number.alias("__v")).agg(times.alias("__c")), "quantile-counts")
    totals = counts.groupBy(*own).agg(F.sum("__c").alias("__total"))
    names = F.array(*[F.struct(F.lit(name).alias("__name"), (F.lit(p) * (F.col("__total") - 1)).alias("__at")) for name, p in points.items()])
    ends = totals.select(*own, F.inline(names)).select(*own, "__name", "__at", F.explode(
        F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))).alias("__rank")).withColumn("__whole", F.col("__rank"))
    found = _values_at(counts, counts.count(), own, ends, range_rows)

    def value_at(rank):
        return F.max(F.when(F.col("__whole") == rank, F.col("__v")))

    both = found.groupBy(*own, "__name", "__at").agg(value_at(F.floor("__at")).alias("__low"), value_at(F.ceil("__at")).alias("__high"))
    between = F.col("__low") + (F.col("__high") - F.col("__low")) * (F.col("__at") - F.floor("__at"))
    return both.groupBy(*own).agg(*[F.max(F.when(F.col("__name") == name, between)).alias(name) for name in points]).select(
        *[F.col(k).alias(c) for c, k in zip(keys, own)], *points)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
