"""Stock reports over the flat stock table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farol.functions.numeric import per_thousand
from farol.operators.ranking import group_mode, value_counts
from farol.plans.reference import states


def records_by_region(bnafar: DataFrame, regions: DataFrame | None = None, state: str = "uf") -> DataFrame:
    """Stock lines per region: counted per state, then mapped; unknown states drop out."""
    reference = regions if regions is not None else states(bnafar.sparkSession)
    counts = value_counts(bnafar, state)
    mapped = counts.join(reference.select(F.col("uf").alias(state), "regiao"), state)
    return mapped.groupBy("regiao").agg(F.sum("records").alias("records"))


def records_per_thousand(bnafar: DataFrame, people: DataFrame | None = None, state: str = "uf") -> DataFrame:
    """Stock lines per 1,000 inhabitants by state."""
    reference = people if people is not None else states(bnafar.sparkSession)
    counts = value_counts(bnafar, state).withColumnRenamed("records", "total_registros")
    joined = counts.join(reference.select(F.col("uf").alias(state), "populacao"), state)
    return joined.withColumn("reg_por_hab", per_thousand(F.col("total_registros"), F.col("populacao"))).orderBy(
        F.desc("reg_por_hab"), state)


def stock_per_thousand(bnafar: DataFrame, people: DataFrame | None = None, state: str = "uf") -> DataFrame:
    """Stocked quantity per 1,000 inhabitants by state."""
    reference = people if people is not None else states(bnafar.sparkSession)
    sums = bnafar.groupBy(state).agg(F.sum("quantidade_estoque").alias("qt_estoque"))
    joined = sums.join(reference.select(F.col("uf").alias(state), "populacao"), state)
    return joined.withColumn("med_por_hab", per_thousand(F.col("qt_estoque"), F.col("populacao"))).orderBy(
        F.desc("med_por_hab"), state)


def common_program(bnafar: DataFrame, exclude: str | None = None, state: str = "uf",
                   program: str = "sigla_programa_saude") -> DataFrame:
    """Most frequent program per state, optionally without the one that dominates everywhere."""
    rows = bnafar if exclude is None else bnafar.where(F.col(program) != exclude)
    return group_mode(rows, [state], program)


def common_product(bnafar: DataFrame, by: str = "uf", product: str = "descricao_produto") -> DataFrame:
    """Most frequent product per state or per program."""
    return group_mode(bnafar, [by], product)
