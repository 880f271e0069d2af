"""The flat tables ``bps``, ``leitos`` and ``bnafar`` over order/lineitem tables.

The order tables carry the same shape of data: a line item is a purchase of a product by a
customer, a stock line of a product at a supplier, and, summed per supplier and month, a
capacity row. The reports run on these views exactly as on the star views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farol.plans.beds import MONTH
from farol.plans.views import FlatView, Step

# Whole 1/10000 units, so that the price is the same number in every engine.
_UNIT = "(cast(round(l_extendedprice * 100) as bigint) * 100) div cast(l_quantity as bigint)"


def _city(balance: str) -> str:
    return f"concat(n_name, '-', cast(cast(floor({balance} / 2500) as int) as string))"




BPS = FlatView(
    "lineitem",
    {"_order": "l_orderkey", "_part": "l_partkey", "_supp": "l_suppkey",
     "codigo_br": "cast(l_partkey as string)", "generico": "if(l_returnflag = 'N', 'S', 'N')",
     "quantidade_itens_comprados": "cast(l_quantity as decimal(20,4))",
     "preco_unitario": f"cast(cast({_UNIT} as decimal(18,0)) * 0.0001BD as decimal(20,4))",
     "preco_total": "cast(l_extendedprice as decimal(20,4))"},
    [Step("orders", {"_order": "o_orderkey"},
          {"_cust": "o_custkey", "data_compra": "cast(o_orderdate as date)", "ano_compra": "year(o_orderdate)",
           "modalidade_compra": "o_orderpriority"}),
     Step("part", {"_part": "p_partkey"}, {"descricao_catmat": "p_name", "fabricante": "p_brand"}),
     Step("supplier", {"_supp": "s_suppkey"}, {"fornecedor": "s_name"}),
     Step("customer_place", {"_cust": "c_custkey"},
          {"cnpj_instituicao": "cast(c_custkey as string)", "nome_instituicao": "c_name",
           "municipio": "municipio", "uf_instituicao": "n_name", "regiao": "r_name"})],
)

BNAFAR = FlatView(
    "lineitem",
    {"_part": "l_partkey", "_supp": "l_suppkey", "codigo_cnes": "cast(l_suppkey as string)",
     "co_catmat": "cast(l_partkey as string)", "numero_lote": "cast(l_linenumber as string)",
     "data_validade": "cast(l_shipdate as date)",
     "data_posicao_estoque": "trunc(cast(l_shipdate as date), 'year')",
     "quantidade_estoque": "cast(l_quantity as decimal(20,4))"},
    [Step("part", {"_part": "p_partkey"}, {"descricao_produto": "p_name", "sigla_programa_saude": "p_type"}),
     Step("supplier_place", {"_supp": "s_suppkey"}, {"uf": "n_name", "codigo_ibge": "municipio", "regiao": "r_name"})],
)

# Bed kinds by line number; the public count takes the returnflag N lines.
_KINDS = {"adulto": 1, "pediatrico": 2, "neonatal": 3, "queimado": 4, "coronariana": 5}


def tables(spark: SparkSession, folder: str, part: tuple[int, int] | None = None):
    """Loader of the order tables, plus each party joined to its nation and region.

    With ``part`` (number, of how many), the orders and line items whose order key falls into that part.
    """
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}

    def load(name: str) -> DataFrame:
        if name in ("customer_place", "supplier_place"):
            party, p = (load("customer"), "c") if name[0] == "c" else (load("supplier"), "s")
            # 25 nations and 5 regions by definition of the schema
            nations = F.broadcast(load("nation").join(
                F.broadcast(load("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left"))
            joined = party.join(nations, F.col(f"{p}_nationkey") == F.col("n_nationkey"), "left")
            return joined.withColumn("municipio", F.expr(_city(f"{p}_acctbal")))
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        if part is None or name not in keys:
            return rows
        return rows.where(F.pmod(F.xxhash64(F.col(keys[name]).cast("bigint")), F.lit(part[1])) == part[0])

    return load


def bps(spark: SparkSession, folder: str, *columns: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Purchases: one row per line item."""
    return BPS.build(tables(spark, folder, part), list(columns))


def bnafar(spark: SparkSession, folder: str, *columns: str, part: tuple[int, int] | None = None) -> DataFrame:
    """Stock lines: one row per line item."""
    return BNAFAR.build(tables(spark, folder, part), list(columns))


def in_parts(spark: SparkSession, folder: str, view, limit: int) -> list[DataFrame]:
    """``bps`` or ``bnafar`` in parts by order key of about ``limit`` line items, whose joins can run one after the other."""
    parts = -(-tables(spark, folder)("lineitem").count() // limit)
    return [view(spark, folder, part=(k, parts)) for k in range(parts)] if parts > 1 else [view(spark, folder)]


def leitos(spark: SparkSession, folder: str) -> DataFrame:
    """Capacity: one row per supplier and shipping month."""
    load = tables(spark, folder)
    beds = F.col("l_quantity").cast("bigint")
    public = F.col("l_returnflag") == "N"
    kinds = {"uti_total": (F.col("l_linenumber") <= 5)}
    kinds |= {f"uti_{name}": F.col("l_linenumber") == n for name, n in _KINDS.items()}

    def count(flag: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, beds)), F.lit(0))

    sums = [F.sum(beds).alias("leitos_geral"), count(public).alias("leitos_sus")]
    for name, flag in kinds.items():
        sums += [count(flag).alias(name), count(flag & public).alias(name.replace("uti_", "uti_sus_"))]
    rows = load("lineitem").groupBy(
        "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias(MONTH)).agg(*sums)
    places = load("supplier_place").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("nome_hospital"),
        F.col("n_name").alias("uf_hospital"), F.col("municipio").alias("municipio_hospital"),
        F.col("r_name").alias("regiao_brasil_hospital"),
        F.expr("case when s_acctbal < 3000 then 'M' when s_acctbal < 6500 then 'E' else 'D' end")
        .alias("tipo_gestao_do_hospital"),
        F.expr("if(s_acctbal < 5000, 'HOSPITAL GERAL', 'CLINICA')").alias("descricao_da_natureza_juridica_do_hospital"),
        F.expr("if(s_acctbal >= 2000, concat(lower(s_name), '@saude'), null)").alias("email"))
    return rows.join(places, "l_suppkey", "left").withColumn("cnes", F.col("l_suppkey").cast("string")).drop("l_suppkey")


def people(spark: SparkSession, folder: str) -> DataFrame:
    """Reference table of states: region and 1,000 inhabitants per customer."""
    load = tables(spark, folder)
    counts = load("customer").groupBy("c_nationkey").agg((F.count("*") * 1000).alias("populacao"))
    places = load("nation").join(F.broadcast(load("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return places.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.col("n_name").alias("uf"), F.col("r_name").alias("regiao"), "populacao")
