"""Purchase reports over the flat purchase table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.functions.numeric import mean_of
from farol.operators.joins import complete_domain
from farol.operators.profile import center_statistics
from farol.operators.ranking import first_rows, top_k

QUANTITY, PRICE, TOTAL = "quantidade_itens_comprados", "preco_unitario", "preco_total"
STATE_METRICS = ["media_itens", "preco_medio", "preco_medio_unit"]


def by_state(bps: DataFrame, domain: DataFrame, state: str = "uf_instituicao") -> DataFrame:
    """Mean items, total and unit price per state, every state of the domain, 0 without data."""
    means = bps.groupBy(F.col(state).alias("uf")).agg(
        mean_of(F.col(QUANTITY)).alias("media_itens"), mean_of(F.col(TOTAL)).alias("preco_medio"),
        mean_of(F.col(PRICE)).alias("preco_medio_unit"))
    return complete_domain(domain, means, "uf")


def state_centers(completed: DataFrame) -> DataFrame:
    """National centre and half range of each state metric."""
    return center_statistics(completed, STATE_METRICS)


def ranking(bps: DataFrame, key: str, measure: Column, k: int | None = 10, ascending: bool = False) -> DataFrame:
    """Groups in order of an aggregate, ties by name; all of them when k is None."""
    totals = bps.groupBy(key).agg(measure.alias("valor"))
    order = [F.asc("valor") if ascending else F.desc("valor"), F.asc(key)]
    return totals.orderBy(*order) if k is None else top_k(totals, order, k)


def spend_by(bps: DataFrame, key: str, k: int | None = 10, ascending: bool = False) -> DataFrame:
    return ranking(bps, key, F.sum(TOTAL), k, ascending)


def items_by(bps: DataFrame, key: str, k: int | None = 10, ascending: bool = False) -> DataFrame:
    return ranking(bps, key, F.sum(QUANTITY), k, ascending)


def mean_spend_by(bps: DataFrame, key: str, k: int | None = 10, ascending: bool = False) -> DataFrame:
    return ranking(bps, key, mean_of(F.col(TOTAL)), k, ascending)


def by_modality(bps: DataFrame, column: str = "modalidade_compra") -> DataFrame:
    """Spend, items and mean unit price per purchase modality."""
    return bps.groupBy(column).agg(
        F.sum(TOTAL).alias("total_gasto"), F.sum(QUANTITY).alias("itens"),
        mean_of(F.col(PRICE)).alias("media_preco_unit")).orderBy(F.desc("total_gasto"), column)


def most_bought(bps: DataFrame, state: str = "uf_instituicao", product: str = "descricao_catmat") -> DataFrame:
    """Product with the largest quantity per state, ties by name."""
    sums = bps.groupBy(state, product).agg(F.sum(QUANTITY).alias("total_comprado"))
    return first_rows(sums, [state], [F.desc("total_comprado"), F.asc(product)])
