"""Bed, purchase and stock reports over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from farol.catalog import BNAFAR, BPS, LATEST, LEITOS, PEOPLE, query, table, using
from farol.functions.text import accent_key
from farol.operators import shaping
from farol.plans import beds, purchases, stock
from farol.plans import order_views as views

METRICS = beds.BED_METRICS


def _sum(column: str, name: str | None = None) -> str:
    return f"CAST(SUM({column}) AS BIGINT) AS {name or column}"


def _union(template: str, names: list[str]) -> str:
    return "\nUNION ALL ".join(template.format(m=m) for m in names)


@query("beds_by_state", using(LEITOS, LATEST) + _union(
    "SELECT uf_hospital, '{m}' AS metric, CAST(SUM({m}) AS BIGINT) AS valor FROM snapshot GROUP BY 1 HAVING SUM({m}) > 0",
    METRICS))
def beds_by_state(spark, folder):
    return beds.beds_by_state(beds.latest_snapshot(views.leitos(spark, folder)))


@query("beds_by_city", using(LEITOS, LATEST) + """, known AS (
  SELECT DISTINCT upper(n_name || '-' || CAST(CAST(floor(c_acctbal / 2500) AS INTEGER) AS VARCHAR)) AS k
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
""" + _union("SELECT upper(municipio_hospital) AS mun_key, municipio_hospital, '{m}' AS metric, "
             "CAST(SUM({m}) AS BIGINT) AS valor FROM snapshot "
             "WHERE upper(municipio_hospital) IN (SELECT k FROM known) GROUP BY 1, 2", METRICS))
def beds_by_city(spark, folder):
    cities = views.tables(spark, folder)("customer_place").select(accent_key(F.col("municipio")).alias("name_key")).distinct()
    return beds.beds_by_city(beds.latest_snapshot(views.leitos(spark, folder)), cities)


def _monthly(category: str) -> str:
    return using(LEITOS) + _union(
        f"SELECT strftime(data_competencia_info, '%Y-%m-%d') AS data_competencia_info, {category}, "
        "'{m}' AS metric, CAST(SUM({m}) AS BIGINT) AS total FROM leitos "
        f"WHERE {category} IS NOT NULL GROUP BY 1, 2", METRICS)


@query("monthly_by_category", _monthly("tipo_gestao_do_hospital"))
def monthly_by_management(spark, folder):
    return beds.monthly_by_category(views.leitos(spark, folder), "tipo_gestao_do_hospital")


@query("monthly_by_region", _monthly("regiao_brasil_hospital"))
def monthly_by_region(spark, folder):
    return beds.monthly_by_category(views.leitos(spark, folder), "regiao_brasil_hospital")


@query("monthly_by_nature", _monthly("descricao_da_natureza_juridica_do_hospital"))
def monthly_by_nature(spark, folder):
    return beds.monthly_by_category(views.leitos(spark, folder), "descricao_da_natureza_juridica_do_hospital")


@query("monthly_pivot", using(LEITOS) + """SELECT strftime(data_competencia_info, '%Y-%m-%d') AS data_competencia_info,
CAST(SUM(CASE WHEN tipo_gestao_do_hospital = 'D' THEN leitos_geral END) AS BIGINT) AS "D",
CAST(SUM(CASE WHEN tipo_gestao_do_hospital = 'E' THEN leitos_geral END) AS BIGINT) AS "E",
CAST(SUM(CASE WHEN tipo_gestao_do_hospital = 'M' THEN leitos_geral END) AS BIGINT) AS "M"
FROM leitos GROUP BY 1""")
def monthly_pivot(spark, folder):
    return shaping.month_matrix(
        views.leitos(spark, folder), beds.MONTH, "tipo_gestao_do_hospital", "leitos_geral", ["D", "E", "M"])


@query("national_months", using(LEITOS) + f"""SELECT strftime(data_competencia_info, '%Y-%m-%d') AS data_competencia_info,
{", ".join(_sum(m) for m in beds.MAIN_METRICS)} FROM leitos GROUP BY 1""")
def national_months(spark, folder):
    return beds.national_months(views.leitos(spark, folder))


_SUMS = ", ".join(_sum(m) for m in beds.MAIN_METRICS)
_CAPITA = using(LEITOS, LATEST, PEOPLE) + f""", sums AS (SELECT uf_hospital, {_SUMS} FROM snapshot GROUP BY 1),
ratios AS (SELECT uf_hospital, regiao, populacao, {", ".join(beds.MAIN_METRICS)},
  {", ".join(f"CAST({m} AS DOUBLE) / populacao * 1000.0 AS {m}_per_capita" for m in beds.MAIN_METRICS)}
  FROM sums JOIN people ON uf = uf_hospital)
"""


def _by_state(spark, folder):
    return beds.per_capita(beds.latest_snapshot(views.leitos(spark, folder)), views.people(spark, folder))


@query("per_capita", _CAPITA + "SELECT * FROM ratios")
def per_capita(spark, folder):
    return _by_state(spark, folder)


@query("region_mean_std", _CAPITA + """SELECT regiao, round(AVG(leitos_geral_per_capita), 6) AS media,
round(stddev_samp(leitos_geral_per_capita), 6) AS desvio, CAST(SUM(leitos_geral) AS BIGINT) AS total
FROM ratios GROUP BY 1""")
def region_mean_std(spark, folder):
    out = beds.region_per_capita(_by_state(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("media", "desvio")})


@query("per_capita_summary", _CAPITA + """SELECT round(AVG(leitos_geral_per_capita), 6) AS media,
round(quantile_cont(leitos_geral_per_capita, 0.5), 6) AS mediana FROM ratios""")
def per_capita_summary(spark, folder):
    out = beds.per_capita_summary(_by_state(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("media", "mediana")})


@query("state_extremes", _CAPITA + """SELECT 'top' AS grupo, uf_hospital, leitos_geral_per_capita FROM (
  SELECT * FROM ratios ORDER BY leitos_geral_per_capita DESC, uf_hospital LIMIT 3)
UNION ALL SELECT 'bottom' AS grupo, uf_hospital, leitos_geral_per_capita FROM (
  SELECT * FROM ratios ORDER BY leitos_geral_per_capita, uf_hospital LIMIT 3)""")
def state_extremes(spark, folder):
    return beds.state_extremes(_by_state(spark, folder))


_SHARES = """CAST(leitos_sus AS DOUBLE) / NULLIF(leitos_geral, 0) * 100.0 AS proporcao_sus_geral,
CAST(uti_sus_total AS DOUBLE) / NULLIF(uti_total, 0) * 100.0 AS proporcao_sus_uti,
leitos_geral - leitos_sus AS leitos_privados, uti_total - uti_sus_total AS uti_privada"""


@query("public_share", using(LEITOS, LATEST, PEOPLE) + f""", sums AS (
SELECT uf_hospital, {_SUMS} FROM snapshot GROUP BY 1)
SELECT uf_hospital, {", ".join(beds.MAIN_METRICS)}, {_SHARES}, regiao FROM sums LEFT JOIN people ON uf = uf_hospital""")
def public_share(spark, folder):
    return beds.public_share(beds.latest_snapshot(views.leitos(spark, folder)), views.people(spark, folder))


@query("national_share", using(LEITOS, LATEST) + f""", sums AS (SELECT {_SUMS} FROM snapshot)
SELECT {", ".join(beds.MAIN_METRICS)}, {_SHARES} FROM sums""")
def national_share(spark, folder):
    return beds.national_share(beds.latest_snapshot(views.leitos(spark, folder)))


def _mean(column: str, name: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE) / COUNT({column}) AS {name}"


_COMPLETE = using(BPS) + f""", medias AS (SELECT uf_instituicao, {_mean('quantidade_itens_comprados', 'media_itens')},
  {_mean('preco_total', 'preco_medio')}, {_mean('preco_unitario', 'preco_medio_unit')}
  FROM bps GROUP BY 1),
dominio AS (SELECT n_name FROM nation UNION ALL SELECT n_name || ' NOVO' FROM nation WHERE n_regionkey = 2),
completo AS (SELECT n_name AS uf, COALESCE(media_itens, 0) AS media_itens, COALESCE(preco_medio, 0) AS preco_medio,
  COALESCE(preco_medio_unit, 0) AS preco_medio_unit FROM dominio LEFT JOIN medias ON n_name = uf_instituicao)
"""


def _completed(spark, folder):
    """Means of all purchases; the domain has names that no purchase has."""
    rows = views.bps(spark, folder, "uf_instituicao", "quantidade_itens_comprados", "preco_total", "preco_unitario")
    names = table(spark, folder, "nation")
    domain = names.select(F.col("n_name").alias("uf")).unionByName(
        names.where("n_regionkey = 2").select(F.concat("n_name", F.lit(" NOVO")).alias("uf")))
    return purchases.by_state(rows, domain)


@query("complete_domain", _COMPLETE + "SELECT * FROM completo")
def complete_domain(spark, folder):
    return _completed(spark, folder)


@query("state_centers", _COMPLETE + _union("""SELECT '{m}' AS "column", round(AVG({m}), 6) AS mean,
round(MIN({m}), 6) AS min, round(MAX({m}), 6) AS max,
round(greatest(abs(MIN({m}) - AVG({m})), abs(MAX({m}) - AVG({m}))), 6) AS half_range FROM completo""",
    purchases.STATE_METRICS))
def state_centers(spark, folder):
    out = purchases.state_centers(_completed(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "min", "max", "half_range")})


def _ranked(key: str, measure: str, k: int | None, ascending: bool = False) -> str:
    direction = "ASC" if ascending else "DESC"
    tail = "" if k is None else f" ORDER BY valor {direction}, {key} LIMIT {k}"
    return using(BPS) + f"SELECT {key}, {measure} AS valor FROM bps GROUP BY 1{tail}"


_TOTAL = "CAST(SUM(preco_total) AS DOUBLE)"
_ITEMS = "CAST(SUM(quantidade_itens_comprados) AS DOUBLE)"
_MEAN_TOTAL = "CAST(SUM(preco_total) AS DOUBLE) / COUNT(preco_total)"


@query("spend_by_state", _ranked("uf_instituicao", _TOTAL, 10))
def spend_by_state(spark, folder):
    return purchases.spend_by(views.bps(spark, folder, "uf_instituicao", "preco_total"), "uf_instituicao")


@query("spend_by_state_all", _ranked("uf_instituicao", _TOTAL, None))
def spend_by_state_all(spark, folder):
    return purchases.spend_by(views.bps(spark, folder, "uf_instituicao", "preco_total"), "uf_instituicao", None)


@query("rankings_desc", _ranked("fornecedor", _TOTAL, 10))
def spend_by_supplier(spark, folder):
    return purchases.spend_by(views.bps(spark, folder, "fornecedor", "preco_total"), "fornecedor")


@query("rankings_asc", _ranked("fornecedor", _ITEMS, 10, True))
def items_by_supplier(spark, folder):
    rows = views.bps(spark, folder, "fornecedor", "quantidade_itens_comprados")
    return purchases.items_by(rows, "fornecedor", ascending=True)


@query("spend_by_product", _ranked("descricao_catmat", _TOTAL, 10))
def spend_by_product(spark, folder):
    return purchases.spend_by(views.bps(spark, folder, "descricao_catmat", "preco_total"), "descricao_catmat")


@query("items_by_product", _ranked("descricao_catmat", _ITEMS, 10))
def items_by_product(spark, folder):
    return purchases.items_by(views.bps(spark, folder, "descricao_catmat", "quantidade_itens_comprados"), "descricao_catmat")


@query("items_by_state", _ranked("uf_instituicao", _ITEMS, None))
def items_by_state(spark, folder):
    return purchases.items_by(views.bps(spark, folder, "uf_instituicao", "quantidade_itens_comprados"), "uf_instituicao", None)


@query("mean_spend_lowest", _ranked("nome_instituicao", _MEAN_TOTAL, 10, True))
def mean_spend_lowest(spark, folder):
    return purchases.mean_spend_by(views.bps(spark, folder, "nome_instituicao", "preco_total"), "nome_instituicao", ascending=True)


@query("mean_spend_highest", _ranked("nome_instituicao", _MEAN_TOTAL, 10))
def mean_spend_highest(spark, folder):
    return purchases.mean_spend_by(views.bps(spark, folder, "nome_instituicao", "preco_total"), "nome_instituicao")


@query("by_modality", using(BPS) + f"""SELECT modalidade_compra, {_TOTAL} AS total_gasto, {_ITEMS} AS itens,
{_mean('preco_unitario', 'media_preco_unit')} FROM bps GROUP BY 1""")
def by_modality(spark, folder):
    return purchases.by_modality(views.bps(
        spark, folder, "modalidade_compra", "preco_total", "quantidade_itens_comprados", "preco_unitario"))


@query("first_per_group", using(BPS) + """SELECT uf_instituicao, descricao_catmat, CAST(t AS DOUBLE) AS total_comprado FROM (
  SELECT uf_instituicao, descricao_catmat, SUM(quantidade_itens_comprados) AS t, row_number() OVER (
    PARTITION BY uf_instituicao ORDER BY SUM(quantidade_itens_comprados) DESC, descricao_catmat) AS rn
  FROM bps GROUP BY 1, 2) WHERE rn = 1""")
def first_per_group(spark, folder):
    return purchases.most_bought(views.bps(spark, folder, "uf_instituicao", "descricao_catmat", "quantidade_itens_comprados"))


@query("records_by_region", using(BNAFAR) + "SELECT regiao, COUNT(*) AS records FROM bnafar GROUP BY 1")
def records_by_region(spark, folder):
    return stock.records_by_region(views.bnafar(spark, folder, "uf"), views.people(spark, folder))


@query("records_per_thousand", using(BNAFAR, PEOPLE) + """SELECT b.uf, total_registros, populacao,
CAST(total_registros AS DOUBLE) / populacao * 1000.0 AS reg_por_hab
FROM (SELECT uf, COUNT(*) AS total_registros FROM bnafar GROUP BY 1) b JOIN people p ON b.uf = p.uf""")
def records_per_thousand(spark, folder):
    return stock.records_per_thousand(views.bnafar(spark, folder, "uf"), views.people(spark, folder))


@query("stock_per_thousand", using(BNAFAR, PEOPLE) + """SELECT b.uf, CAST(q AS DOUBLE) AS qt_estoque, populacao,
CAST(q AS DOUBLE) / populacao * 1000.0 AS med_por_hab
FROM (SELECT uf, SUM(quantidade_estoque) AS q FROM bnafar GROUP BY 1) b JOIN people p ON b.uf = p.uf""")
def stock_per_thousand(spark, folder):
    return stock.stock_per_thousand(views.bnafar(spark, folder, "uf", "quantidade_estoque"), views.people(spark, folder))


def _mode(source: str, key: str, column: str, where: str = "") -> str:
    return source + f"""SELECT {key}, {column}, records FROM (SELECT {key}, {column}, COUNT(*) AS records,
row_number() OVER (PARTITION BY {key} ORDER BY COUNT(*) DESC, {column}) AS rn FROM bnafar {where} GROUP BY 1, 2) WHERE rn = 1"""


@query("mode_per_group", _mode(using(BNAFAR), "uf", "descricao_produto"))
def mode_per_state(spark, folder):
    return stock.common_product(views.bnafar(spark, folder, "uf", "descricao_produto"))


@query("mode_per_program", _mode(using(BNAFAR), "sigla_programa_saude", "descricao_produto"))
def mode_per_program(spark, folder):
    return stock.common_product(views.bnafar(spark, folder, "sigla_programa_saude", "descricao_produto"), "sigla_programa_saude")


@query("mode_excluding_value", _mode(using(BNAFAR), "uf", "sigla_programa_saude", "WHERE sigla_programa_saude <> 'ECONOMY'"))
def mode_excluding(spark, folder):
    return stock.common_program(views.bnafar(spark, folder, "uf", "sigla_programa_saude"), "ECONOMY")
