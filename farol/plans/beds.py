"""Bed capacity reports over the flat capacity table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farol.functions import text
from farol.functions.dates import period_bounds
from farol.functions.numeric import per_thousand, percent_of
from farol.operators.elections import DATE_SPELLINGS, elect, read_elected
from farol.operators.joins import members
from farol.operators.ranking import latest_rows, max_then_sum
from farol.operators.shaping import month_totals
from farol.plans.reference import CITY_SPELLINGS, states
from farol.session import staged

# The fourteen bed counts of a capacity row.
BED_METRICS = [
    "leitos_sus", "leitos_geral",
    "uti_total", "uti_sus_total",
    "uti_adulto", "uti_sus_adulto",
    "uti_pediatrico", "uti_sus_pediatrico",
    "uti_neonatal", "uti_sus_neonatal",
    "uti_queimado", "uti_sus_queimado",
    "uti_coronariana", "uti_sus_coronariana",
]
MAIN_METRICS = ["leitos_geral", "leitos_sus", "uti_total", "uti_sus_total"]
MONTH = "data_competencia_info"


def latest_snapshot(leitos: DataFrame, ties: list[Column] | None = None) -> DataFrame:
    """Newest row of every facility; equal months fall to the larger bed counts."""
    order = ties or [F.desc_nulls_last("leitos_geral"), F.desc_nulls_last("leitos_sus")]
    return latest_rows(leitos, "cnes", MONTH, order)


def _state_key(column: str) -> Column:
    return F.upper(text.strip_space(F.col(column))).alias(column)


def beds_by_state(snapshot: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """All metrics per state in one aggregate, as (state, metric, value), zeros left out."""
    wanted = metrics or BED_METRICS
    wide = snapshot.groupBy(_state_key("uf_hospital")).agg(*[F.sum(F.col(m).try_cast("bigint")).alias(m) for m in wanted])
    return wide.unpivot(["uf_hospital"], wanted, "metric", "valor").where(F.col("valor") > 0)


def beds_by_city(snapshot: DataFrame, known_cities: DataFrame, city_key: str = "name_key",
                 metrics: list[str] | None = None) -> DataFrame:
    """All metrics per city whose corrected, accent-free name is a known city."""
    wanted = metrics or BED_METRICS
    name = text.null_words(text.strip_space(F.col("municipio_hospital")), ["", "nan", "None"])
    rows = snapshot.withColumn("municipio_hospital", name).where(F.col("municipio_hospital").isNotNull())
    # names repeat, so sum per name first and clean each name once
    sums = rows.groupBy("municipio_hospital").agg(
        *[F.coalesce(F.sum(F.col(m).try_cast("bigint")), F.lit(0)).alias(m) for m in wanted])
    keyed = sums.withColumn("mun_key", text.substitute(text.accent_key(F.col("municipio_hospital")), CITY_SPELLINGS))
    return members(keyed, known_cities, {"mun_key": city_key}).unpivot(
        ["mun_key", "municipio_hospital"], wanted, "metric", "valor")


def monthly_by_category(leitos: DataFrame, category: str, metrics: list[str] | None = None) -> DataFrame:
    """Month, category, metric and total, all metrics in one aggregate."""
    return month_totals(leitos, MONTH, category, metrics or BED_METRICS)


def national_months(leitos: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """National totals per month; duplicate rows of a facility and month count once."""
    known = leitos.where(F.col(MONTH).isNotNull())
    return max_then_sum(known, ["cnes"], MONTH, metrics or MAIN_METRICS).orderBy(MONTH)


def capacity_check(rows: DataFrame, month: str = MONTH, facility: str = "cnes", group: str = "source_file") -> DataFrame:
    """Per file of text rows: months that read and that do not, the period, and rows that share a facility and month.

    The spelling of the months is elected per file; the flag alone that some month reads would let one odd cell decide.
    """
    _, elected = staged(elect(rows, [month], DATE_SPELLINGS, group), "elected")
    read = read_elected(rows.select(group, facility, month), elected, [month], DATE_SPELLINGS, group)
    # rows are counted per facility and month first, which is all that the rest needs
    counts = read.groupBy(group, facility, month).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(month).isNotNull()
    return counts.groupBy(group).agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("valid"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("invalid"),
        *period_bounds(F.col(month)), F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated"))


def per_capita(snapshot: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Beds per 1,000 inhabitants by state; ``people`` has uf, regiao and populacao."""
    reference = people if people is not None else states(snapshot.sparkSession)
    sums = snapshot.groupBy(_state_key("uf_hospital")).agg(*[F.sum(m).alias(m) for m in MAIN_METRICS])
    joined = sums.join(reference.select(F.col("uf").alias("uf_hospital"), "regiao", "populacao"), "uf_hospital")
    joined = joined.where(F.col("populacao").isNotNull())
    return joined.select("uf_hospital", "regiao", "populacao", *MAIN_METRICS, *[
        per_thousand(F.col(m), F.col("populacao")).alias(f"{m}_per_capita") for m in MAIN_METRICS])


def region_per_capita(by_state: DataFrame) -> DataFrame:
    """Mean and sample deviation of the state ratios per region."""
    return by_state.groupBy("regiao").agg(
        F.avg("leitos_geral_per_capita").alias("media"), F.stddev_samp("leitos_geral_per_capita").alias("desvio"),
        F.sum("leitos_geral").alias("total"))


def per_capita_summary(by_state: DataFrame) -> DataFrame:
    """National mean and median of the state ratios, which are one row per state."""
    ratio = "leitos_geral_per_capita"
    return by_state.agg(F.avg(ratio).alias("media"), F.median(ratio).alias("mediana"))


def state_extremes(by_state: DataFrame, k: int = 3) -> DataFrame:
    """The k best and k worst equipped states, ranked in one pass over the states."""
    ratio = "leitos_geral_per_capita"
    best, worst = (F.row_number().over(Window.orderBy(o, "uf_hospital")) for o in (F.desc(ratio), F.asc(ratio)))
    ranked = by_state.select("uf_hospital", ratio, best.alias("best"), worst.alias("worst"))
    groups = F.array_compact(F.array(F.when(F.col("best") <= k, "top"), F.when(F.col("worst") <= k, "bottom")))
    return ranked.select(F.explode(groups).alias("grupo"), "uf_hospital", ratio)


def _shares(sums: DataFrame) -> DataFrame:
    return (sums
            .withColumn("proporcao_sus_geral", percent_of(F.col("leitos_sus"), F.col("leitos_geral")))
            .withColumn("proporcao_sus_uti", percent_of(F.col("uti_sus_total"), F.col("uti_total")))
            .withColumn("leitos_privados", F.col("leitos_geral") - F.col("leitos_sus"))
            .withColumn("uti_privada", F.col("uti_total") - F.col("uti_sus_total")))


def public_share(snapshot: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """Public share of beds by state, with the private rest and the region."""
    reference = people if people is not None else states(snapshot.sparkSession)
    sums = snapshot.groupBy(_state_key("uf_hospital")).agg(*[F.sum(m).alias(m) for m in MAIN_METRICS])
    regions = reference.select(F.col("uf").alias("uf_hospital"), "regiao")
    return _shares(sums).join(regions, "uf_hospital", "left")


def national_share(snapshot: DataFrame) -> DataFrame:
    """Public share of beds over the whole country."""
    sums = snapshot.agg(*[F.sum(m).alias(m) for m in MAIN_METRICS])
    return _shares(sums)
