from __future__ import annotations

import re

import duckdb
import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from farol.catalog import ORACLES, QUERIES
from farol.operators.ranking import first_rows
from farol.plans import beds, order_views, purchases, questions, reference, stock
from farol.session import as_of_date

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
WRITES_FILES = ("star_", "incremental_", "flat_", "csv_export", "snapshot_", "load_report", "zip_stock", "date_election", "capacity_check", "geojson_names")
# compared row by row here; tools/compare.py does it for all
COMPARED = ["q04_top_products_common_supplier", "q06_above_average", "q12_three_way", "q15_tuple_semi", "q20_price_disparity",
            "describe_exact", "value_shares", "mode_per_group", "per_capita", "keep_first_dedup", "pair_bleu", "clean_text", "sample_stable"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["descricao_catmat", "preco_medio", "fornecedor_mais_comum"] and got.count() == 10


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.select(*columns)) == sorted(cursor.fetchall(), key=repr)


def test_no_query_pairs_everything_or_sorts_in_one_task(spark):
    for name, job in QUERIES.items():
        if name.startswith(WRITES_FILES):
            continue
        text = plan(job(spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "BatchEvalPython" not in text, name
        assert "ArrowEvalPython" not in text, name


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["q09_conditional_having"](spark, SMALL))
    orders = next(line for line in text.splitlines() if "orders.parquet" in line)
    assert "o_totalprice" not in orders and "o_orderdate" in orders
    frame = order_views.bps(spark, SMALL, "preco_total", "data_compra").where(questions.in_year("data_compra", 2000))
    full = frame._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", full)


def test_top_one_is_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3)
    assert plan(first_rows(df, ["k"], ["id"])).count("WindowGroupLimit") == 2


def test_price_gap_equals_the_plain_join(spark):
    """The pre-aggregated form against the many-to-many join it replaces."""
    bought = order_views.bps(spark, SMALL, "codigo_br", "descricao_catmat", "preco_unitario", "data_compra")
    stocked = order_views.bnafar(spark, SMALL, "codigo_cnes", "co_catmat")
    since = F.add_months(as_of_date("2001-08-01"), -24)
    joined = bought.where(F.col("data_compra") >= since).join(stocked, F.col("codigo_br") == F.col("co_catmat"))
    gaps = joined.groupBy("codigo_cnes", "descricao_catmat").agg(
        (F.sum("preco_unitario").cast("double") / F.count("preco_unitario") - F.min("preco_unitario").cast("double")).alias("d"))
    want = first_rows(gaps, ["codigo_cnes"], [F.desc("d"), F.asc("descricao_catmat")])
    assert rows(questions.price_gap_by_facility(bought, stocked, 24, "2001-08-01")) == rows(want)


def test_reports_with_the_fixed_states(spark):
    month = "date'2025-01-01'"
    frame = spark.sql(f"""SELECT * FROM VALUES ('1', {month}, ' sp', 'São Luís do Paraitinga', 100, 40, 10, 5),
        ('1', date'2024-12-01', 'SP', 'x', 900, 900, 900, 900), ('2', {month}, 'AC', ' Parati ', 10, 0, 0, 0), ('3', {month}, 'XX', 'Nowhere', 7, 7, 7, 7),
        ('4', {month}, 'AC', NULL, 1, 1, 1, 1)
        AS t(cnes, data_competencia_info, uf_hospital, municipio_hospital, leitos_geral, leitos_sus, uti_total, uti_sus_total)""")
    snapshot = beds.latest_snapshot(frame)
    assert snapshot.count() == 4
    ratios = {r["uf_hospital"]: r for r in beds.per_capita(snapshot).collect()}
    assert set(ratios) == {"SP", "AC"}
    assert ratios["SP"]["leitos_geral_per_capita"] == pytest.approx(100 / 44411238 * 1000) and ratios["AC"]["regiao"] == "Norte"
    share = {r["uf_hospital"]: r for r in beds.public_share(snapshot).collect()}
    assert share["SP"]["proporcao_sus_geral"] == 40.0 and share["SP"]["leitos_privados"] == 60 and share["XX"]["regiao"] is None
    cities = spark.createDataFrame([("SAO LUIZ DO PARAITINGA",), ("PARATY",)], "name_key string")
    got = beds.beds_by_city(snapshot, cities, metrics=["leitos_geral"])
    assert rows(got) == [("PARATY", "Parati", "leitos_geral", 10), ("SAO LUIZ DO PARAITINGA", "São Luís do Paraitinga", "leitos_geral", 100)]
    assert rows(beds.beds_by_state(snapshot, ["uti_total"])) == [("AC", "uti_total", 1), ("SP", "uti_total", 10), ("XX", "uti_total", 7)]
    domain = reference.states(spark).select("uf")
    bought = spark.createDataFrame([("SP", 2, 3.0, 6.0), ("SP", None, 5.0, 2.0)],
                                   "uf_instituicao string, quantidade_itens_comprados int, preco_unitario double, preco_total double")
    means = {r["uf"]: tuple(r)[1:] for r in purchases.by_state(bought, domain).collect()}
    assert len(means) == 27 and means["SP"] == (2.0, 4.0, 4.0) and means["AC"] == (0.0, 0.0, 0.0)
    lines = spark.createDataFrame([("SP", "A"), ("SP", "B"), ("SP", "B"), ("AC", "C"), ("ZZ", "C")], "uf string, sigla_programa_saude string")
    assert rows(stock.records_by_region(lines)) == [("Norte", 1), ("Sudeste", 3)]
    assert rows(stock.common_program(lines, exclude="B")) == [("AC", "C", 1), ("SP", "A", 1), ("ZZ", "C", 1)]
    assert [r["uf"] for r in stock.records_per_thousand(lines).collect()] == ["AC", "SP"]
