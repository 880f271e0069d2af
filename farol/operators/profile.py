"""Table profiles: missing values, frequencies, distinct counts, moments, correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farol.functions.numeric import ratio
from farol.operators.quantiles import exact_quantiles
from farol.operators.ranking import first_rows
from farol.session import staged


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def number_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _long(df: DataFrame, columns: list[str], as_type: str) -> DataFrame:
    """One (column, value) row per cell of the chosen columns."""
    return df.select(*[F.col(c).cast(as_type).alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")


def missing_values(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Null count and percent per column, one pass over the table."""
    nulls = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = nulls.unpivot(["__rows"], df.columns, "column", "missing")
    out = long.select("column", "missing", F.try_divide(F.col("missing") * 100.0, F.col("__rows")).alias("percent"))
    return out.where(F.col("missing") > 0) if only_missing else out


def table_info(df: DataFrame) -> DataFrame:
    """Column, non-null count and type."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema], "column string, type string")
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "non_null")
    return counts.join(F.broadcast(types), "column")


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, non-null value) for many columns in one pass."""
    return _long(df, columns, "string").where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("records"))


def value_shares(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Share of each value among the non-null cells, k most frequent per column."""
    counts = value_frequencies(df, columns)
    top = first_rows(counts, ["column"], [F.desc("records"), F.asc("value")], k)
    totals = counts.groupBy("column").agg(F.sum("records").alias("total"))
    shares = top.join(F.broadcast(totals), "column")  # one row per column
    return shares.select("column", "value", "records",
                         (F.col("records") / F.col("total")).alias("share"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact number of distinct non-null values per column."""
    return value_frequencies(df, columns or df.columns).groupBy("column").agg(
        F.count("*").alias("distinct_values"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per column."""
    long = _long(df, columns, "double").where(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(
        F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = exact_quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, "column")


def table_profile(df: DataFrame, k: int = 1) -> DataFrame:
    """One row per column: type, missing and distinct values, the k most frequent values with their shares, and of
    numbers the moments and exact quartiles.

    The table is read once: every cell is counted as (column, value), which is staged, and all else follows from the counts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    numeric = number_columns(df)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                               (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number")) for c in df.columns])
    _, counts = staged(df.select(F.inline(cells)).groupBy("column", "value", "number").agg(F.count("*").alias("n")), "profile-counts")
    filled = counts.where(F.col("value").isNotNull())
    whole = counts.groupBy("column").agg(
        F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count("value").alias("distinct_values"), ratio(F.sum(F.col("number") * F.col("n")), F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean"),
        F.min("number").alias("min"), F.max("number").alias("max"))
    _, whole = staged(whole, "profile-columns")
    # squares of distances from the mean, not of values; one row per column is joined
    spread = filled.where(F.col("number").isNotNull()).join(F.broadcast(whole.select("column", "mean")), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(F.pow(F.col("number") - F.col("mean"), 2) * F.col("n")), F.sum("n") - 1)).alias("std"))
    quartiles = exact_quantiles(filled.where(F.col("number").isNotNull()), ["column"], "number", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, "n")
    top = first_rows(filled, ["column"], [F.desc("n"), F.asc("value")], k).join(F.broadcast(whole.select("column", "records", "missing")), "column").groupBy(
        "column").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("order"), "value", (F.col("n") / (F.col("records") - F.col("missing"))).alias("share")))).alias("top"))
    types = df.sparkSession.createDataFrame(list(kinds.items()), "column string, type string")
    out = types
    for part in (whole, spread, quartiles, top):
        out = out.join(part, "column", "left")
    return out.select("column", "type", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("missing", F.lit(0)).alias("missing"),
                      F.try_divide(F.col("missing") * 100.0, F.col("records")).alias("percent"), F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
                      "mean", "std", "min", "q25", "q50", "q75", "max", F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["share"].alias("share"))).alias("top"))


#: Sums of one aggregate: few enough for its code to be generated and compiled.
SUMS_PER_PASS = 48


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation per pair of columns, rows complete in the pair; full matrix.

    Plain sums of the pairwise complete rows: counts, values, squares and products. Values are shifted by their
    column's mean first, so that the sums of squares do not lose the spread. Pairs of columns without nulls share the sums of
    their columns. What comes back is a number per sum. A column or pair without spread has null.
    """
    names = [f"c{i}" for i in range(len(columns))]
    numbers = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    first = numbers.agg(F.count(F.lit(1)).alias("rows"), *[
        f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.count, F.min, F.max)]).first()
    shifted = {n: F.col(n) - F.lit(first[f"avg_{n}"] or 0.0) for n in names}
    whole = {n for n in names if first[f"count_{n}"] == first["rows"]}
    pairs = list(combinations(names, 2))
    sums: dict[str, Column] = {}

    def terms(a: str, b: str) -> list[str]:
        """Names of the five sums of a pair."""
        together = F.col(a).isNotNull() & F.col(b).isNotNull()

        def term(x: str, power: int) -> str:
            value = shifted[x] if power == 1 else shifted[x] * shifted[x]
            name = f"{x}^{power}" if {a, b} <= whole else f"{x}^{power}|{a},{b}"
            sums[name] = F.sum(value if {a, b} <= whole else F.when(together, value))
            return name

        if not {a, b} <= whole:
            sums[f"n|{a},{b}"] = F.sum(F.when(together, 1.0))
        sums[f"{a}*{b}"] = F.sum(shifted[a] * shifted[b])
        return [term(a, 1), term(b, 1), term(a, 2), term(b, 2), f"{a}*{b}"]

    needed = {pair: terms(*pair) for pair in pairs}
    order, totals = list(sums), {}
    for at in range(0, len(order), SUMS_PER_PASS):
        some = order[at:at + SUMS_PER_PASS]
        totals |= dict(zip(some, numbers.agg(*[sums[name].alias(f"s{i}") for i, name in enumerate(some)]).first()))

    def correlation(a: str, b: str) -> float | None:
        n = first["rows"] if {a, b} <= whole else totals[f"n|{a},{b}"]
        x, y, xx, yy, xy = (totals[name] for name in needed[a, b])
        if not n:
            return None
        spread = (n * xx - x * x) * (n * yy - y * y)
        return (n * xy - x * y) / spread**0.5 if spread > 0 else None

    label = dict(zip(names, columns))
    cells = [(label[n], label[n], 1.0 if first[f"count_{n}"] and first[f"max_{n}"] > first[f"min_{n}"] else None) for n in names]
    for a, b in pairs:
        r = correlation(a, b)
        cells += [(label[a], label[b], r), (label[b], label[a], r)]
    return df.sparkSession.createDataFrame(cells, "column_a string, column_b string, correlation double")


def center_statistics(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, minimum, maximum and largest distance from the mean per metric."""
    long = _long(df, metrics, "double")
    stats = long.groupBy("column").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.withColumn("half_range", F.greatest(F.abs(F.col("min") - F.col("mean")),
                                                     F.abs(F.col("max") - F.col("mean"))))
