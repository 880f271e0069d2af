"""Registered queries over the order tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farol.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Result columns as text, bigint, double or boolean, whatever type the job computes in."""
    def column(f: T.StructField):
        kind = f.dataType
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        if isinstance(kind, T.DateType):
            return F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss").alias(f.name)
        return F.col(f.name)

    return df.select(*[column(f) for f in df.schema])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its counterpart."""
    def register(job: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(job(prepare(spark), folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The flat tables in SQL, for the counterparts.
BPS = """bps AS (
  SELECT CAST(l_partkey AS VARCHAR) AS codigo_br, CASE WHEN l_returnflag = 'N' THEN 'S' ELSE 'N' END AS generico,
    CAST(l_quantity AS DECIMAL(20,4)) AS quantidade_itens_comprados,
    CAST(CAST((CAST(round(l_extendedprice * 100) AS BIGINT) * 100) // CAST(l_quantity AS BIGINT) AS DECIMAL(18,0))
      * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(20,4)) AS preco_unitario,
    CAST(l_extendedprice AS DECIMAL(20,4)) AS preco_total,
    CAST(o_orderdate AS DATE) AS data_compra, year(o_orderdate) AS ano_compra, o_orderpriority AS modalidade_compra,
    p_name AS descricao_catmat, p_brand AS fabricante, s_name AS fornecedor,
    CAST(c_custkey AS VARCHAR) AS cnpj_instituicao, c_name AS nome_instituicao,
    n_name || '-' || CAST(CAST(floor(c_acctbal / 2500) AS INTEGER) AS VARCHAR) AS municipio,
    n_name AS uf_instituicao, r_name AS regiao
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

BNAFAR = """bnafar AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS codigo_cnes, CAST(l_partkey AS VARCHAR) AS co_catmat,
    CAST(l_linenumber AS VARCHAR) AS numero_lote, CAST(l_shipdate AS DATE) AS data_validade,
    CAST(date_trunc('year', l_shipdate) AS DATE) AS data_posicao_estoque,
    CAST(l_quantity AS DECIMAL(20,4)) AS quantidade_estoque, p_name AS descricao_produto,
    p_type AS sigla_programa_saude, n_name AS uf, r_name AS regiao,
    n_name || '-' || CAST(CAST(floor(s_acctbal / 2500) AS INTEGER) AS VARCHAR) AS codigo_ibge
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

_KINDS = {"uti_total": "l_linenumber <= 5", "uti_adulto": "l_linenumber = 1", "uti_pediatrico": "l_linenumber = 2",
          "uti_neonatal": "l_linenumber = 3", "uti_queimado": "l_linenumber = 4", "uti_coronariana": "l_linenumber = 5"}


def _bed_sum(condition: str, name: str) -> str:
    return f"CAST(SUM(CASE WHEN {condition} THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS {name}"


_BEDS = ", ".join(
    [_bed_sum("true", "leitos_geral"), _bed_sum("l_returnflag = 'N'", "leitos_sus")]
    + [_bed_sum(c, n) for n, c in _KINDS.items()]
    + [_bed_sum(f"{c} AND l_returnflag = 'N'", n.replace("uti_", "uti_sus_")) for n, c in _KINDS.items()])

LEITOS = f"""capacity AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS data_competencia_info, {_BEDS}
  FROM lineitem GROUP BY 1, 2),
leitos AS (
  SELECT capacity.*, CAST(l_suppkey AS VARCHAR) AS cnes, s_name AS nome_hospital, n_name AS uf_hospital,
    n_name || '-' || CAST(CAST(floor(s_acctbal / 2500) AS INTEGER) AS VARCHAR) AS municipio_hospital,
    r_name AS regiao_brasil_hospital,
    CASE WHEN s_acctbal < 3000 THEN 'M' WHEN s_acctbal < 6500 THEN 'E' ELSE 'D' END AS tipo_gestao_do_hospital,
    CASE WHEN s_acctbal < 5000 THEN 'HOSPITAL GERAL' ELSE 'CLINICA' END AS descricao_da_natureza_juridica_do_hospital,
    CASE WHEN s_acctbal >= 2000 THEN lower(s_name) || '@saude' END AS email
  FROM capacity LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

PEOPLE = """people AS (
  SELECT n_name AS uf, r_name AS regiao, populacao FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN (SELECT c_nationkey, COUNT(*) * 1000 AS populacao FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""

LATEST = """snapshot AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cnes
    ORDER BY data_competencia_info DESC, leitos_geral DESC, leitos_sus DESC) AS rn FROM leitos) WHERE rn = 1)"""


def using(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def load_all() -> None:
    """Import the modules that register queries."""
    from farol import (  # noqa: F401
        catalog_cleaning,
        catalog_loads,
        catalog_operators,
        catalog_questions,
        catalog_reports,
    )
