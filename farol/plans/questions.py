"""The twenty corpus questions as functions over the flat tables.

``leitos`` holds one row per facility and month, ``bps`` one per purchase, ``bnafar`` one per
stock line. Literals of a question are parameters; the report date is ``as_of``.
Where one question joins two facts only to filter or to count, the joined side is reduced to
its distinct keys (or counts per key) first, so no many-to-many product is built.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.functions.numeric import mean_of, percent_gap, ratio
from farol.operators.joins import members, where_latest
from farol.operators.ranking import first_rows, top_k
from farol.session import as_of_date

MONTH = "data_competencia_info"
POSITION = "data_posicao_estoque"
Day = dt.date | str | None


def in_year(date: str, year: Column | int) -> Column:
    """Dates of one year as a range, which the scan can use; ``year(date) = y`` it cannot."""
    first = F.make_date(F.lit(year) if isinstance(year, int) else year, F.lit(1), F.lit(1))
    return (F.col(date) >= first) & (F.col(date) < F.add_months(first, 12))


def _at_month(leitos: DataFrame, month: Day) -> DataFrame:
    """Rows of one month, the newest when none is given."""
    return where_latest(leitos, MONTH) if month is None else leitos.where(F.col(MONTH) == as_of_date(month))


def _at_position(bnafar: DataFrame, position: Day) -> DataFrame:
    """Rows of one position date, the newest when none is given."""
    return where_latest(bnafar, POSITION) if position is None else bnafar.where(F.col(POSITION) == as_of_date(position))


def facilities_with_beds(leitos: DataFrame, uf: str, column: str = "uti_sus_adulto", month: Day = None) -> DataFrame:
    """Q1: facilities of a state with beds of one kind at the newest month."""
    return _at_month(leitos, month).where((F.col("uf_hospital") == uf) & (F.col(column) > 0)).select(
        "nome_hospital", "cnes")


def bed_totals(leitos: DataFrame, uf: str | None = None, month: Day = None) -> DataFrame:
    """Q2: all and public beds at the newest month, in one state or everywhere."""
    rows = _at_month(leitos, month)
    if uf is not None:
        rows = rows.where(F.col("uf_hospital") == uf)
    return rows.agg(F.sum("leitos_geral").alias("total_leitos_existentes"),
                    F.sum("leitos_sus").alias("total_leitos_sus"))


def stock_by_program(bnafar: DataFrame, position: Day = None) -> DataFrame:
    """Q3: stock and reporting facilities per program at the newest position."""
    return _at_position(bnafar, position).groupBy("sigla_programa_saude").agg(
        F.sum("quantidade_estoque").alias("total_itens_em_estoque"),
        F.count_distinct("codigo_cnes").alias("numero_estabelecimentos"))


def dearest_products(bps: DataFrame, year: int, k: int = 10) -> DataFrame:
    """Q4: k products with the highest mean unit price and the most common supplier of each.

    Rows are counted once per (product, supplier). Mean and most common supplier of a product
    both come from those counts, so the purchases are read and shuffled a single time.
    """
    pairs = bps.where(in_year("data_compra", year)).groupBy("descricao_catmat", "fornecedor").agg(
        F.sum("preco_unitario").alias("soma"), F.count("preco_unitario").alias("precos"),
        F.count("*").alias("compras"))
    # the smallest (-count, name) is the highest count, first name among equals
    common = F.min(F.struct((-F.col("compras")).alias("menos"), "fornecedor"))
    products = pairs.groupBy("descricao_catmat").agg(
        ratio(F.sum("soma"), F.sum("precos")).alias("preco_medio"), common.alias("comum"))
    top = top_k(products, [F.desc("preco_medio"), F.asc("descricao_catmat")], k)
    return top.select("descricao_catmat", "preco_medio", F.col("comum.fornecedor").alias("fornecedor_mais_comum"))


def facilities_stocking(leitos: DataFrame, bnafar: DataFrame, pattern: str, min_beds: int = 50,
                        month: Day = None, position: Day = None) -> DataFrame:
    """Q5: facilities that stock a product and have many public beds, a row per stock line."""
    beds = _at_month(leitos, month).where(F.col("leitos_sus") > min_beds).select("nome_hospital", "cnes")
    lines = _at_position(bnafar, position).where(F.col("descricao_produto").ilike(pattern)).select("codigo_cnes")
    return beds.join(lines, F.col("cnes") == F.col("codigo_cnes")).select("nome_hospital", "cnes")


def above_state_mean(leitos: DataFrame, uf: str, column: str = "uti_sus_neonatal", year: int | None = None) -> DataFrame:
    """Q6: cities whose mean per facility and month is above the state's, newest or given year.

    Both means come from the sums per city and year.
    """
    rows = leitos.where(F.col("uf_hospital") == uf)
    if year is not None:
        rows = rows.where(in_year(MONTH, year))
    sums = rows.groupBy("municipio_hospital", F.year(MONTH).alias("ano")).agg(
        F.sum(column).alias("soma"), F.count(column).alias("n"))
    newest = top_k(sums.groupBy("ano").agg(ratio(F.sum("soma"), F.sum("n")).alias("limite")), [F.desc("ano")], 1)
    return sums.join(newest, "ano").select(
        "municipio_hospital", ratio(F.col("soma"), F.col("n")).alias("media_municipal"), "limite"
    ).where(F.col("media_municipal") > F.col("limite")).drop("limite")


def expired_stock(bnafar: DataFrame, as_of: Day = None, position: Day = None) -> DataFrame:
    """Q7: stock lines past their expiry that still hold a quantity, newest position."""
    return _at_position(bnafar, position).where(
        (F.col("data_validade") < as_of_date(as_of)) & (F.col("quantidade_estoque") > 0)
    ).select("descricao_produto", "numero_lote", "data_validade", "quantidade_estoque")


def public_gap_by_state(leitos: DataFrame, total: str = "uti_pediatrico", public: str = "uti_sus_pediatrico",
                        month: Day = None) -> DataFrame:
    """Q8: beds, public beds and the percent between them per state, facilities with beds only."""
    rows = _at_month(leitos, month).where(F.col(total) > 0)
    sums = rows.groupBy("uf_hospital").agg(F.sum(total).alias("total_existentes"), F.sum(public).alias("total_sus"))
    return sums.withColumn("diferenca_percentual", percent_gap(F.col("total_existentes"), F.col("total_sus"))).orderBy(
        "uf_hospital")


def big_generic_buyers(bps: DataFrame, year: int, min_items: float = 1000, min_total: float = 50000) -> DataFrame:
    """Q9: institutions with a large generic purchase and a costly purchase in a year."""
    return bps.where(in_year("data_compra", year)).groupBy("nome_instituicao").agg(
        F.count_if((F.col("generico") == "S") & (F.col("quantidade_itens_comprados") > min_items)).alias("grandes"),
        F.count_if(F.col("preco_total") > min_total).alias("caras"),
    ).where((F.col("grandes") > 0) & (F.col("caras") > 0)).select("nome_instituicao")


def makers_by_buyers(bps: DataFrame, k: int = 5, as_of: Day = None, by_value: bool = False) -> DataFrame:
    """Q10: makers sold to most institutions in the year before ``as_of``, or with most sales."""
    rows = bps.where(in_year("data_compra", F.year(as_of_date(as_of)) - 1))
    # first per (maker, institution): a maker with a third of all sales is already small after that
    pairs = rows.groupBy("fabricante", "cnpj_instituicao").agg(F.sum("preco_total").alias("valor"))
    sums = pairs.groupBy("fabricante").agg(
        F.count("cnpj_instituicao").alias("num_instituicoes_compradoras"),
        F.sum("valor").alias("valor_total_vendas"))
    first = "valor_total_vendas" if by_value else "num_instituicoes_compradoras"
    return top_k(sums, [F.desc(first), F.asc("fabricante")], k)


def bed_means(leitos: DataFrame, group: str = "tipo_gestao_do_hospital", month: Day = None,
              total: str = "uti_total", public: str = "uti_sus_total", sums: bool = False) -> DataFrame:
    """Q11: mean (or sum) of total and public beds per management type."""
    rows = _at_month(leitos, month)
    if sums:
        return rows.groupBy(group).agg(F.sum(total).alias("total_existentes"), F.sum(public).alias("total_sus"))
    return rows.groupBy(group).agg(mean_of(F.col(total)).alias("media_existentes"),
                                   mean_of(F.col(public)).alias("media_sus"))


def expiring(as_of: Day, months: int = 0, days: int = 0, open_start: bool = False) -> Column:
    """Expiry within a span after the report date; ``open_start`` includes what is already past."""
    today = as_of_date(as_of)
    end = F.date_add(F.add_months(today, months), days)
    upto = F.col("data_validade") <= end
    return upto if open_start else upto & (F.col("data_validade") >= today)


def facilities_with_expiring_dear_stock(leitos: DataFrame, bnafar: DataFrame, bps: DataFrame, min_mean: float = 100,
                                        column: str = "uti_sus_coronariana", as_of: Day = None, month: Day = None,
                                        open_start: bool = False, position: Day = None) -> DataFrame:
    """Q12: facilities with beds of a kind and stock near expiry of products with a high mean price."""
    dear = bps.where(in_year("data_compra", F.year(as_of_date(as_of)) - 1)).groupBy("codigo_br").agg(
        mean_of(F.col("preco_unitario")).alias("media")).where(F.col("media") > min_mean)
    lines = _at_position(bnafar, position).where(expiring(as_of, months=3, open_start=open_start)).select(
        "codigo_cnes", "co_catmat")
    lines = members(lines, dear, {"co_catmat": "codigo_br"})
    beds = _at_month(leitos, month).where(F.col(column) > 0).select("cnes", "nome_hospital")
    return beds.join(lines, F.col("cnes") == F.col("codigo_cnes")).select("cnes", "nome_hospital")


def widespread_products(bnafar: DataFrame, min_states: int = 5, min_cities: int = 10, position: Day = None) -> DataFrame:
    """Q13: products stocked in more than so many states and cities at the newest position."""
    return _at_position(bnafar, position).groupBy("descricao_produto").agg(
        F.count_distinct("uf").alias("num_ufs"), F.count_distinct("codigo_ibge").alias("num_municipios"),
    ).where((F.col("num_ufs") > min_states) & (F.col("num_municipios") > min_cities))


def facilities_with_email(leitos: DataFrame, nature: str = "HOSPITAL GERAL") -> DataFrame:
    """Q14: facilities of one legal nature that give an e-mail address."""
    return leitos.where(
        (F.col("descricao_da_natureza_juridica_do_hospital") == nature) & F.col("email").isNotNull()
    ).select("nome_hospital", "cnes", "email")


def dear_in_equipped_cities(bps: DataFrame, leitos: DataFrame, year: int, min_beds: int = 200) -> DataFrame:
    """Q15: products bought above their national mean price by institutions in cities with many beds.

    A product qualifies when its highest price in such a city does, so purchases shrink to one
    row per product and city, which serve the national mean as well.
    """
    cities = leitos.where(in_year(MONTH, year)).groupBy(
        F.col("municipio_hospital").alias("municipio"), F.col("uf_hospital").alias("uf_instituicao")).agg(
        F.sum("leitos_geral").alias("leitos")).where(F.col("leitos") > min_beds)
    bought = bps.where(in_year("data_compra", year)).groupBy("descricao_catmat", "municipio", "uf_instituicao").agg(
        F.sum("preco_unitario").alias("soma"), F.count("preco_unitario").alias("n"),
        F.max("preco_unitario").alias("maior"))
    marked = bought.join(cities, ["municipio", "uf_instituicao"], "left")
    products = marked.groupBy("descricao_catmat").agg(
        ratio(F.sum("soma"), F.sum("n")).alias("media_nacional"),
        F.max(F.when(F.col("leitos").isNotNull(), F.col("maior"))).alias("maior"))
    return products.where(F.col("maior").cast("double") > F.col("media_nacional")).select("descricao_catmat")


def recent_prices(bps: DataFrame, pattern: str, months: int = 6, as_of: Day = None) -> DataFrame:
    """Q16: mean unit price per state and supplier of a product in the last months."""
    since = F.add_months(as_of_date(as_of), -months)
    return bps.where(F.col("descricao_catmat").ilike(pattern) & (F.col("data_compra") >= since)).groupBy(
        F.col("uf_instituicao").alias("uf"), "fornecedor").agg(
        mean_of(F.col("preco_unitario")).alias("preco_medio")).orderBy("uf", "fornecedor")


def exhausted_facilities(leitos: DataFrame, limit: float = 0.5, total: str = "uti_total",
                         public: str = "uti_sus_total", month: Day = None) -> DataFrame:
    """Q17: facilities whose share of non-public beds is above a limit."""
    index = ratio(F.col(total) - F.col(public), F.col(total))
    return _at_month(leitos, month).where(F.col(total) > 0).select(
        "cnes", "nome_hospital", index.alias("indice_esgotamento")).where(F.col("indice_esgotamento") > limit)


def facilities_in_program(leitos: DataFrame, bnafar: DataFrame, pattern: str, column: str = "uti_sus_pediatrico",
                          month: Day = None) -> DataFrame:
    """Q18: facilities with stock of a program and beds of a kind, each once."""
    stocked = bnafar.where(F.col("sigla_programa_saude").like(pattern)).select("codigo_cnes").distinct()
    beds = _at_month(leitos, month).where(F.col(column) > 0).select("cnes", "nome_hospital").distinct()
    return members(beds, stocked, {"cnes": "codigo_cnes"})


def makers_of_expiring_stock(bnafar: DataFrame, bps: DataFrame, days: int = 60, min_quantity: float = 100,
                             as_of: Day = None, open_start: bool = False, position: Day = None) -> DataFrame:
    """Q19: makers of products whose stock is near expiry; both sides distinct before the join."""
    lines = _at_position(bnafar, position).where(
        expiring(as_of, days=days, open_start=open_start) & (F.col("quantidade_estoque") > min_quantity)
    ).select("co_catmat", "descricao_produto").distinct()
    makers = bps.select("codigo_br", "fabricante").distinct()
    return lines.join(makers, F.col("co_catmat") == F.col("codigo_br")).select(
        "fabricante", "descricao_produto").distinct()


def price_gap_by_facility(bps: DataFrame, bnafar: DataFrame, months: int = 12, as_of: Day = None) -> DataFrame:
    """Q20: per facility, the stocked product with the largest gap of mean and lowest price.

    Purchases shrink to one row per product code and description, stock lines to one count per
    facility and code. Every purchase would have been repeated once per stock line, hence the
    weighted mean.
    """
    since = F.add_months(as_of_date(as_of), -months)
    prices = bps.where(F.col("data_compra") >= since).groupBy("codigo_br", "descricao_catmat").agg(
        F.sum("preco_unitario").alias("soma"), F.count("preco_unitario").alias("n"),
        F.min("preco_unitario").alias("menor"))
    stock = bnafar.groupBy("codigo_cnes", "co_catmat").agg(F.count("*").alias("linhas"))
    joined = stock.join(prices, F.col("co_catmat") == F.col("codigo_br"))
    weight = F.col("linhas").cast("decimal(12,0)")
    gaps = joined.groupBy("codigo_cnes", "descricao_catmat").agg(
        (ratio(F.sum(F.col("soma") * weight), F.sum(F.col("n") * F.col("linhas")))
         - F.min("menor").cast("double")).alias("disparidade"))
    return first_rows(gaps, ["codigo_cnes"], [F.desc("disparidade"), F.asc("descricao_catmat")])
