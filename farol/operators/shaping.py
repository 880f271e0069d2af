"""Column renaming, rule-driven projection and swapped-column repair."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.functions import dates, numeric, text


@dataclass(frozen=True)
class Rule:
    """One output column: source column (or a literal in its place), target name and type."""

    source: str
    target: str
    kind: str = "text"
    literal: str | None = None


#: Prefix of the columns that hold ``style_flags``.
POINTED = "__pointed_"

# Spark type per rule type.
KIND_TYPES = {
    "text": "string", "int": "int", "decimal": "decimal(20,4)", "latlong": "decimal(12,9)",
    "date": "date", "timestamp": "timestamp",
}


def typed(c: Column, kind: str, pointed: Column | None = None) -> Column:
    """Text to the rule's type; whatever does not parse becomes null (0 for integers).

    ``pointed`` says of a decimal that its whole column writes decimals with a point.
    """
    if kind == "text":
        return text.text_or_empty(c)
    if kind == "int":
        return numeric.int_or_zero(c)
    if kind == "decimal":
        plain = numeric.br_decimal(c)
        return plain if pointed is None else F.when(pointed, numeric.br_decimal(c, point_style=True)).otherwise(plain)
    if kind == "latlong":
        # a coordinate has no thousands points
        return numeric.comma_decimal(c, 12, 9)
    if kind == "date":
        return F.coalesce(dates.date_of(c), dates.month_of(c))
    if kind == "timestamp":
        return dates.utc_timestamp(c)
    raise ValueError(f"unknown rule type {kind}")


def rule_column(df: DataFrame, rule: Rule) -> Column:
    if rule.literal is not None:
        return F.lit(rule.literal).alias(rule.target)
    source = F.col(rule.source) if rule.source in df.columns else F.lit(None).cast("string")
    flag = f"{POINTED}{rule.source}"
    return typed(source, rule.kind, F.col(flag) if flag in df.columns else None).alias(rule.target)


def style_flags(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Per group, whether each column writes its decimals with a point."""
    return df.groupBy(group).agg(*[numeric.point_style_hint(F.col(c)).alias(f"{POINTED}{c}") for c in columns])


def project(df: DataFrame, wanted: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """One select built from the rules, plus columns kept as they are."""
    return df.select(*(keep or []), *[rule_column(df, r) for r in wanted])


def ensure_columns(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Add missing text columns with a fixed value."""
    missing = {c: F.lit(fill) for c in columns if c not in df.columns}
    return df.withColumns(missing) if missing else df


def clean_names(df: DataFrame) -> DataFrame:
    """Column names without accents and punctuation."""
    return df.toDF(*[text.column_name(c) for c in df.columns])


def resolve_aliases(columns: list[str], accepted: dict[str, list[str]]) -> dict[str, str]:
    """Source column per final name; the first source column that fits wins."""
    finals = {text.column_name(spelling): final for final, names in accepted.items() for spelling in names}
    chosen: dict[str, str] = {}
    for column in columns:
        final = finals.get(text.column_name(column))
        if final is not None:
            chosen.setdefault(final, column)
    return chosen


def swap_flags(df: DataFrame, pairs: list[tuple[str, str]], group: str) -> DataFrame:
    """Per group and id column, whether most of its values are names; one pass for all pairs."""
    return df.groupBy(group).agg(*[
        (F.count_if(F.col(ident).rlike("[A-Z]")) * 2 > F.count(ident)).alias(f"__swap_{ident}") for ident, _ in pairs])


def apply_swaps(df: DataFrame, flags: DataFrame, pairs: list[tuple[str, str]], group: str) -> DataFrame:
    """Exchange the columns of a pair in the groups whose flag is set."""
    # one row per file; adaptive execution broadcasts it when it is small
    out = df.join(flags, group, "left")
    fixed: dict[str, Column] = {}
    for ident, name in pairs:
        swapped = F.coalesce(F.col(f"__swap_{ident}"), F.lit(False))
        fixed[ident] = F.when(swapped, F.col(name)).otherwise(F.col(ident))
        fixed[name] = F.when(swapped, F.col(ident)).otherwise(F.col(name))
    return out.withColumns(fixed).select(*df.columns)


def repair_swaps(df: DataFrame, pairs: list[tuple[str, str]], group: str) -> DataFrame:
    """Put id and name columns back in the groups (files) where they are exchanged."""
    present = [(a, b) for a, b in pairs if a in df.columns and b in df.columns]
    return apply_swaps(df, swap_flags(df, present, group), present, group) if present else df


def month_totals(df: DataFrame, month: str, category: str, metrics: list[str]) -> DataFrame:
    """Sums of many metrics per month and category, as (month, category, metric, total)."""
    known = df.where(F.col(month).isNotNull() & F.col(category).isNotNull())
    wide = known.groupBy(month, category).agg(*[F.sum(F.col(m).cast("bigint")).alias(m) for m in metrics])
    return wide.unpivot([month, category], metrics, "metric", "total")


def month_matrix(df: DataFrame, month: str, category: str, metric: str, categories: list) -> DataFrame:
    """Months by categories; every month that occurs is kept."""
    known = df.where(F.col(month).isNotNull() & F.col(category).isNotNull())
    return known.groupBy(month).pivot(category, categories).agg(F.sum(F.col(metric).cast("bigint")))
