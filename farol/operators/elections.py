"""Spelling of a column, elected per file: the format most of its cells have, not the one a single cell has."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.functions.dates import date_of, month_of


@dataclass(frozen=True)
class Spelling:
    """A name and how text in that spelling is read; null where it does not fit."""

    name: str
    read: Callable[[Column], Column]


#: In the order in which they are tried.
DATE_SPELLINGS = [Spelling("dates", date_of), Spelling("months", month_of)]


def elect(rows: DataFrame, columns: list[str], spellings: list[Spelling], group: str, tolerance: float = 0.5) -> DataFrame:
    """(group, column, spelling, null_share) of every column in every group, all counted in one pass.

    The first spelling that leaves at most ``tolerance`` of the filled cells null wins; if none does, the one
    that leaves the fewest, the first of equal ones. A column without a filled cell takes the first spelling, with a null share.
    """
    def counts(c: str) -> Column:
        return F.struct(F.count(c).alias("filled"), F.array(*[F.count(s.read(F.col(c))) for s in spellings]).alias("read"))

    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("counts")) for i, c in enumerate(columns)])
    long = rows.groupBy(group).agg(*[counts(c).alias(f"__{i}") for i, c in enumerate(columns)]).select(group, F.inline(entries))
    shares = F.transform("counts.read", lambda n: F.try_divide(F.col("counts.filled") - n, F.col("counts.filled")))
    long = long.select(group, "column", shares.alias("shares"))
    fitting = F.filter(F.sequence(F.lit(1), F.lit(len(spellings))), lambda i: F.element_at("shares", i) <= tolerance)
    place = F.coalesce(F.get(fitting, 0), F.array_position("shares", F.array_min("shares")).cast("int"), F.lit(1))
    names = F.array(*[F.lit(s.name) for s in spellings])
    return long.withColumn("place", place).select(
        group, "column", F.element_at(names, F.col("place")).alias("spelling"), F.element_at("shares", F.col("place")).alias("null_share"))


def read_elected(rows: DataFrame, elected: DataFrame, columns: list[str], spellings: list[Spelling], group: str) -> DataFrame:
    """The columns read in the spelling of their group; cells in another spelling become null.

    ``elected`` has a row per group and column; a written table of it is small enough to be joined without a shuffle of the rows.
    """
    wide = elected.groupBy(group).agg(*[F.max(F.when(F.col("column") == c, F.col("spelling"))).alias(f"__{i}") for i, c in enumerate(columns)])
    joined = rows.join(wide, group, "left")

    def read(i: int, c: str) -> Column:
        value = F.lit(None).cast("date")
        for s in spellings:
            value = F.when(F.col(f"__{i}") == s.name, s.read(F.col(c))).otherwise(value)
        return value

    return joined.withColumns({c: read(i, c) for i, c in enumerate(columns)}).select(*rows.columns)
