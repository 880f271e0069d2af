"""The twenty corpus questions over the order tables."""

from __future__ import annotations

from farol.catalog import BNAFAR, BPS, LEITOS, query, using
from farol.plans import order_views as views
from farol.plans import questions as q

MONTH = "2001-06-01"
LAST_POSITION = "data_posicao_estoque = (SELECT MAX(data_posicao_estoque) FROM bnafar)"


@query("q01_latest_filter", using(LEITOS) + f"""SELECT nome_hospital, cnes FROM leitos
WHERE uf_hospital = 'NATION_7' AND uti_sus_adulto > 0 AND data_competencia_info = DATE '{MONTH}'""")
def q01(spark, folder):
    return q.facilities_with_beds(views.leitos(spark, folder), "NATION_7", month=MONTH)


@query("q02_latest_totals", using(LEITOS) + """SELECT CAST(SUM(leitos_geral) AS BIGINT) AS total_leitos_existentes,
CAST(SUM(leitos_sus) AS BIGINT) AS total_leitos_sus FROM leitos
WHERE data_competencia_info = (SELECT MAX(data_competencia_info) FROM leitos)""")
def q02(spark, folder):
    return q.bed_totals(views.leitos(spark, folder))


@query("q03_program_stock", using(BNAFAR) + f"""SELECT sigla_programa_saude,
CAST(SUM(quantidade_estoque) AS DOUBLE) AS total_itens_em_estoque, COUNT(DISTINCT codigo_cnes) AS numero_estabelecimentos
FROM bnafar WHERE {LAST_POSITION} GROUP BY 1""")
def q03(spark, folder):
    return q.stock_by_program(views.bnafar(
        spark, folder, "sigla_programa_saude", "quantidade_estoque", "codigo_cnes", "data_posicao_estoque"))


@query("q04_top_products_common_supplier", using(BPS) + """, medias AS (
  SELECT descricao_catmat, CAST(SUM(preco_unitario) AS DOUBLE) / COUNT(preco_unitario) AS preco_medio
  FROM bps WHERE ano_compra = 2000 GROUP BY 1 ORDER BY preco_medio DESC, descricao_catmat LIMIT 10),
comum AS (
  SELECT descricao_catmat, fornecedor,
    row_number() OVER (PARTITION BY descricao_catmat ORDER BY COUNT(*) DESC, fornecedor) AS rn
  FROM bps WHERE ano_compra = 2000 AND descricao_catmat IN (SELECT descricao_catmat FROM medias) GROUP BY 1, 2)
SELECT m.descricao_catmat, m.preco_medio, c.fornecedor AS fornecedor_mais_comum
FROM medias m JOIN comum c ON m.descricao_catmat = c.descricao_catmat WHERE c.rn = 1""")
def q04(spark, folder):
    return q.dearest_products(views.bps(
        spark, folder, "descricao_catmat", "fornecedor", "preco_unitario", "data_compra"), 2000)


@query("q05_stock_and_beds_join", using(LEITOS, BNAFAR) + f"""SELECT l.nome_hospital, l.cnes FROM leitos l
JOIN bnafar b ON l.cnes = b.codigo_cnes WHERE b.descricao_produto ILIKE '%WIDGET%' AND l.leitos_sus > 20
AND l.data_competencia_info = DATE '{MONTH}' AND b.{LAST_POSITION}""")
def q05(spark, folder):
    stock = views.bnafar(spark, folder, "codigo_cnes", "descricao_produto", "data_posicao_estoque")
    return q.facilities_stocking(views.leitos(spark, folder), stock, "%WIDGET%", 20, MONTH)


@query("q06_above_average", using(LEITOS) + """, s AS (
  SELECT * FROM leitos WHERE uf_hospital = 'NATION_16' AND year(data_competencia_info) =
    (SELECT MAX(year(data_competencia_info)) FROM leitos WHERE uf_hospital = 'NATION_16'))
SELECT municipio_hospital, CAST(SUM(uti_sus_neonatal) AS DOUBLE) / COUNT(uti_sus_neonatal) AS media_municipal
FROM s GROUP BY 1 HAVING CAST(SUM(uti_sus_neonatal) AS DOUBLE) / COUNT(uti_sus_neonatal) >
  (SELECT CAST(SUM(uti_sus_neonatal) AS DOUBLE) / COUNT(uti_sus_neonatal) FROM s)""")
def q06(spark, folder):
    return q.above_state_mean(views.leitos(spark, folder), "NATION_16")


@query("q07_expired_stock", using(BNAFAR) + f"""SELECT descricao_produto, numero_lote,
strftime(data_validade, '%Y-%m-%d') AS data_validade, CAST(quantidade_estoque AS DOUBLE) AS quantidade_estoque
FROM bnafar WHERE data_validade < DATE '2001-03-01' AND quantidade_estoque > 0 AND {LAST_POSITION}""")
def q07(spark, folder):
    return q.expired_stock(views.bnafar(
        spark, folder, "descricao_produto", "numero_lote", "data_validade", "quantidade_estoque",
        "data_posicao_estoque"), "2001-03-01")


@query("q08_percent_difference", using(LEITOS) + f"""SELECT uf_hospital,
CAST(SUM(uti_pediatrico) AS BIGINT) AS total_existentes, CAST(SUM(uti_sus_pediatrico) AS BIGINT) AS total_sus,
CAST(SUM(uti_pediatrico) - SUM(uti_sus_pediatrico) AS DOUBLE) * 100.0 / NULLIF(SUM(uti_pediatrico), 0)
  AS diferenca_percentual
FROM leitos WHERE data_competencia_info = DATE '{MONTH}' AND uti_pediatrico > 0 GROUP BY 1 ORDER BY 1""")
def q08(spark, folder):
    return q.public_gap_by_state(views.leitos(spark, folder), month=MONTH)


@query("q09_conditional_having", using(BPS) + """SELECT nome_instituicao FROM bps WHERE ano_compra = 2000
GROUP BY 1 HAVING SUM(CASE WHEN generico = 'S' AND quantidade_itens_comprados > 40 THEN 1 ELSE 0 END) > 0
AND SUM(CASE WHEN preco_total > 50000 THEN 1 ELSE 0 END) > 0""")
def q09(spark, folder):
    return q.big_generic_buyers(views.bps(
        spark, folder, "nome_instituicao", "generico", "quantidade_itens_comprados", "preco_total", "data_compra"),
        2000, 40, 50000)


_MAKERS = """SELECT fabricante, COUNT(DISTINCT cnpj_instituicao) AS num_instituicoes_compradoras,
CAST(SUM(preco_total) AS DOUBLE) AS valor_total_vendas FROM bps WHERE ano_compra = 2000 GROUP BY 1"""


@query("q10_makers_by_buyers", using(BPS) + _MAKERS + " ORDER BY num_instituicoes_compradoras DESC, fabricante LIMIT 5")
def q10(spark, folder):
    return q.makers_by_buyers(views.bps(
        spark, folder, "fabricante", "cnpj_instituicao", "preco_total", "data_compra"), 5, "2001-08-01")


@query("q10_makers_by_value", using(BPS) + _MAKERS + " ORDER BY SUM(preco_total) DESC, fabricante LIMIT 3")
def q10_value(spark, folder):
    return q.makers_by_buyers(views.bps(
        spark, folder, "fabricante", "cnpj_instituicao", "preco_total", "data_compra"), 3, "2001-08-01", by_value=True)


@query("q11_group_means", using(LEITOS) + """SELECT tipo_gestao_do_hospital,
CAST(SUM(uti_total) AS DOUBLE) / COUNT(uti_total) AS media_existentes,
CAST(SUM(uti_sus_total) AS DOUBLE) / COUNT(uti_sus_total) AS media_sus
FROM leitos WHERE data_competencia_info = (SELECT MAX(data_competencia_info) FROM leitos) GROUP BY 1""")
def q11(spark, folder):
    return q.bed_means(views.leitos(spark, folder))


@query("q11_group_sums", using(LEITOS) + f"""SELECT tipo_gestao_do_hospital,
CAST(SUM(uti_total) AS BIGINT) AS total_existentes, CAST(SUM(uti_sus_total) AS BIGINT) AS total_sus
FROM leitos WHERE data_competencia_info = DATE '{MONTH}' GROUP BY 1""")
def q11_sums(spark, folder):
    return q.bed_means(views.leitos(spark, folder), month=MONTH, sums=True)


def _three_way(start: str) -> str:
    return using(LEITOS, BNAFAR, BPS) + f"""SELECT l.cnes, l.nome_hospital FROM leitos l
JOIN bnafar pe ON l.cnes = pe.codigo_cnes
WHERE l.uti_sus_coronariana > 0 AND l.data_competencia_info = DATE '{MONTH}'
AND {start} pe.data_validade <= DATE '2001-06-01' + INTERVAL 3 MONTH AND pe.{LAST_POSITION}
AND pe.co_catmat IN (SELECT codigo_br FROM bps WHERE ano_compra = 2000 GROUP BY 1
  HAVING CAST(SUM(preco_unitario) AS DOUBLE) / COUNT(preco_unitario) > 1000)"""


def _three_way_job(spark, folder, open_start):
    stock = views.bnafar(spark, folder, "codigo_cnes", "co_catmat", "data_validade", "data_posicao_estoque")
    bought = views.bps(spark, folder, "codigo_br", "preco_unitario", "data_compra")
    return q.facilities_with_expiring_dear_stock(
        views.leitos(spark, folder), stock, bought, 1000, as_of="2001-06-01", month=MONTH, open_start=open_start)


@query("q12_three_way", _three_way("pe.data_validade >= DATE '2001-06-01' AND"))
def q12(spark, folder):
    return _three_way_job(spark, folder, False)


@query("q12_three_way_open_start", _three_way(""))
def q12_open(spark, folder):
    return _three_way_job(spark, folder, True)


@query("q13_spread", using(BNAFAR) + f"""SELECT descricao_produto, COUNT(DISTINCT uf) AS num_ufs,
COUNT(DISTINCT codigo_ibge) AS num_municipios FROM bnafar WHERE {LAST_POSITION}
GROUP BY 1 HAVING COUNT(DISTINCT uf) > 5 AND COUNT(DISTINCT codigo_ibge) > 10""")
def q13(spark, folder):
    return q.widespread_products(views.bnafar(
        spark, folder, "descricao_produto", "uf", "codigo_ibge", "data_posicao_estoque"))


@query("q14_not_null", using(LEITOS) + """SELECT nome_hospital, cnes, email FROM leitos
WHERE descricao_da_natureza_juridica_do_hospital = 'HOSPITAL GERAL' AND email IS NOT NULL""")
def q14(spark, folder):
    return q.facilities_with_email(views.leitos(spark, folder))


@query("q15_tuple_semi", using(BPS, LEITOS) + """, media AS (
  SELECT descricao_catmat, CAST(SUM(preco_unitario) AS DOUBLE) / COUNT(preco_unitario) AS media_nacional
  FROM bps WHERE ano_compra = 2000 GROUP BY 1),
cidades AS (
  SELECT municipio_hospital, uf_hospital FROM leitos WHERE year(data_competencia_info) = 2000
  GROUP BY 1, 2 HAVING SUM(leitos_geral) > 5000)
SELECT DISTINCT b.descricao_catmat FROM bps b JOIN media m ON b.descricao_catmat = m.descricao_catmat
WHERE b.ano_compra = 2000 AND (b.municipio, b.uf_instituicao) IN (SELECT municipio_hospital, uf_hospital FROM cidades)
AND CAST(b.preco_unitario AS DOUBLE) > m.media_nacional""")
def q15(spark, folder):
    bought = views.bps(spark, folder, "descricao_catmat", "preco_unitario", "municipio", "uf_instituicao", "data_compra")
    return q.dear_in_equipped_cities(bought, views.leitos(spark, folder), 2000, 5000)


@query("q16_recent_prices", using(BPS) + """SELECT uf_instituicao AS uf, fornecedor,
CAST(SUM(preco_unitario) AS DOUBLE) / COUNT(preco_unitario) AS preco_medio FROM bps
WHERE descricao_catmat ILIKE '%RING%' AND data_compra >= DATE '2001-08-01' - INTERVAL 6 MONTH
GROUP BY 1, 2 ORDER BY 1, 2""")
def q16(spark, folder):
    return q.recent_prices(views.bps(
        spark, folder, "uf_instituicao", "fornecedor", "preco_unitario", "descricao_catmat", "data_compra"),
        "%RING%", 6, "2001-08-01")


@query("q17_index", using(LEITOS) + f"""SELECT cnes, nome_hospital,
CAST(uti_total - uti_sus_total AS DOUBLE) / uti_total AS indice_esgotamento FROM leitos
WHERE data_competencia_info = DATE '{MONTH}' AND uti_total > 0
AND CAST(uti_total - uti_sus_total AS DOUBLE) / uti_total > 0.5""")
def q17(spark, folder):
    return q.exhausted_facilities(views.leitos(spark, folder), month=MONTH)


@query("q18_distinct_join", using(LEITOS, BNAFAR) + f"""SELECT DISTINCT l.cnes, l.nome_hospital FROM leitos l
JOIN bnafar b ON l.cnes = b.codigo_cnes WHERE b.sigla_programa_saude LIKE '%ECONOMY%' AND l.uti_sus_pediatrico > 0
AND l.data_competencia_info = DATE '{MONTH}'""")
def q18(spark, folder):
    stock = views.bnafar(spark, folder, "codigo_cnes", "sigla_programa_saude")
    return q.facilities_in_program(views.leitos(spark, folder), stock, "%ECONOMY%", month=MONTH)


@query("q19_expiring_makers", using(BNAFAR, BPS) + f"""SELECT DISTINCT bp.fabricante, bn.descricao_produto FROM bnafar bn
JOIN bps bp ON bp.codigo_br = bn.co_catmat
WHERE bn.data_validade BETWEEN DATE '2001-06-01' AND DATE '2001-06-01' + INTERVAL 60 DAY
AND bn.quantidade_estoque > 30 AND bn.{LAST_POSITION}""")
def q19(spark, folder):
    stock = views.bnafar(spark, folder, "co_catmat", "descricao_produto", "data_validade", "quantidade_estoque",
                         "data_posicao_estoque")
    return q.makers_of_expiring_stock(stock, views.bps(spark, folder, "codigo_br", "fabricante"), 60, 30, "2001-06-01")


@query("q20_price_disparity", using(BPS, BNAFAR) + """, gaps AS (
  SELECT bn.codigo_cnes, bp.descricao_catmat,
    CAST(SUM(bp.preco_unitario) AS DOUBLE) / COUNT(bp.preco_unitario) - CAST(MIN(bp.preco_unitario) AS DOUBLE) AS d
  FROM bps bp JOIN bnafar bn ON bp.codigo_br = bn.co_catmat
  WHERE bp.data_compra >= DATE '2001-08-01' - INTERVAL 12 MONTH GROUP BY 1, 2)
SELECT codigo_cnes, descricao_catmat, d AS disparidade FROM (
  SELECT *, row_number() OVER (PARTITION BY codigo_cnes ORDER BY d DESC, descricao_catmat) AS rn FROM gaps) WHERE rn = 1""")
def q20(spark, folder):
    bought = views.bps(spark, folder, "codigo_br", "descricao_catmat", "preco_unitario", "data_compra")
    stock = views.bnafar(spark, folder, "codigo_cnes", "co_catmat")
    return q.price_gap_by_facility(bought, stock, 12, "2001-08-01")
