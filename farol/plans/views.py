"""Flat views: a fact joined to the dimensions that the asked columns need.

Dimension keys are unique, so leaving out an unused left join cannot change the rows. Catalyst
has no foreign keys to see that by itself; asking for columns by name keeps the joins away.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farol.sources.tables import MONTH


@dataclass(frozen=True)
class Step:
    """Left join to a table with unique ``on`` keys; ``gives`` maps output names to SQL."""

    table: str
    on: dict[str, str]
    gives: dict[str, str]


@dataclass(frozen=True)
class FlatView:
    fact: str
    own: dict[str, str]
    steps: list[Step] = field(default_factory=list)

    def columns(self) -> list[str]:
        """Visible columns; names starting with ``_`` only serve later joins."""
        names = [*self.own, *[c for s in self.steps for c in s.gives]]
        return [c for c in names if not c.startswith("_")]

    def build(self, table: Callable[[str], DataFrame], columns: list[str] | None = None) -> DataFrame:
        wanted = list(columns) if columns else self.columns()
        unknown = set(wanted) - set(self.columns())
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        needed, taken = set(wanted), []
        for step in reversed(self.steps):
            if needed & set(step.gives):
                needed |= set(step.on)
                taken.insert(0, step)
        out = table(self.fact).select(*[F.expr(e).alias(c) for c, e in self.own.items() if c in needed])
        for step in taken:
            keys = [F.expr(d).alias(f"__k{i}") for i, d in enumerate(step.on.values())]
            side = table(step.table).select(*keys, *[F.expr(e).alias(c) for c, e in step.gives.items() if c in needed])
            cond = [out[s] == side[f"__k{i}"] for i, s in enumerate(step.on)]
            out = out.join(side, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])
        return out.select(*wanted)


_PLACE = {"_endereco_id": "endereco_id"}

# Capacity rows under the names the corpus uses.
V_LEITOS = FlatView(
    "leitos",
    {"_instituicao_id": "instituicao_id", "data_competencia_info": "data_de_competencia",
     "leitos_geral": "quantidade_leitos_gerais", "leitos_sus": "quantidade_leitos_sus",
     "uti_total": "quantidade_leitos_uti", "uti_sus_total": "quantidade_leitos_uti_sus",
     **{f"uti_{kind}": f"quantidade_leitos_uti_{kind}"
        for kind in ("adulto", "pediatrico", "neonatal", "queimado", "coronariana")},
     **{f"uti_sus_{kind}": f"quantidade_leitos_uti_sus_{kind}"
        for kind in ("adulto", "pediatrico", "neonatal", "queimado", "coronariana")}},
    [Step("instituicao", {"_instituicao_id": "instituicao_id"},
          {**_PLACE, "cnes": "codigo_cnes", "nome_hospital": "nome_instituicao",
           "nome_razao_social_hospital": "razao_social", "tipo_gestao_do_hospital": "tipo_de_gestao",
           "codigo_tipo_da_unidade": "codigo_do_tipo_da_unidade",
           "descricao_do_tipo_da_unidade": "descricao_do_tipo_da_unidade",
           "natureza_juridica_do_hospital": "codigo_da_natureza_juridica",
           "descricao_da_natureza_juridica_do_hospital": "descricao_da_natureza_juridica",
           "motivo_desabilitacao_hospital": "motivo_da_desabilitacao",
           # the star keeps missing text as '', the questions test for null
           "email": "nullif(email, '')", "telefone": "nullif(telefone, '')"}),
     Step("endereco", {"_endereco_id": "endereco_id"},
          {"regiao_brasil_hospital": "regiao_do_brasil", "uf_hospital": "unidade_federativa",
           "codigo_ibge": "codigo_do_ibge", "municipio_hospital": "municipio", "endereco_hospital": "logradouro",
           "numero_endereco_hospital": "numero_do_logradouro", "complemento_endereco_hospital": "complemento",
           "bairro_hospital": "bairro", "cep_hospital": "cep"})],
)

# Purchases. Buyers are known by CNPJ only; a facility known by CNES is another institution row.
V_BPS = FlatView(
    "instituicao_compra_produto",
    {"_instituicao_id": "instituicao_id", "_fornecedor_id": "fornecedor_id", "_fabricante_id": "fabricante_id",
     "_produto_id": "produto_id", "data_compra": "data_de_compra", "ano_compra": "year(data_de_compra)",
     "data_insercao": "data_de_insercao", "modalidade_compra": "modalidade_de_compra",
     "tipo_compra": "tipo_da_compra", "unidade_medida": "unidade_de_medida", "capacidade": "capacidade",
     "quantidade_itens_comprados": "quantidade_de_itens", "preco_unitario": "preco_unitario",
     "preco_total": "preco_total"},
    [Step("produto", {"_produto_id": "produto_id"},
          {"codigo_br": "codigo_catmat", "descricao_catmat": "descricao_catmat", "anvisa": "anvisa",
           "generico": "generico"}),
     Step("fornecedor", {"_fornecedor_id": "fornecedor_id"},
          {"cnpj_fornecedor": "cnpj_fornecedor", "fornecedor": "nome_fornecedor"}),
     Step("fabricante", {"_fabricante_id": "fabricante_id"},
          {"cnpj_fabricante": "cnpj_fabricante", "fabricante": "nome_fabricante"}),
     Step("instituicao", {"_instituicao_id": "instituicao_id"},
          {**_PLACE, "cnpj_instituicao": "cnpj_instituicao", "nome_instituicao": "nome_instituicao"}),
     Step("endereco", {"_endereco_id": "endereco_id"},
          {"municipio": "municipio", "uf_instituicao": "unidade_federativa"})],
)

# Stock lines. The product rows of stock carry 'N/A' as registration, those of purchases do not,
# so joins between the two use the catalogue code alone.
V_BNAFAR = FlatView(
    "instituicao_estoca_produto",
    {"_instituicao_id": "instituicao_id", "_produto_id": "produto_id",
     "data_posicao_estoque": "data_de_posicao_no_estoque", "quantidade_estoque": "quantidade_do_item_em_estoque",
     "numero_lote": "numero_do_lote", "data_validade": "data_de_validade", "tipo_produto": "tipo_do_produto",
     "sigla_programa_saude": "sigla_do_programa_de_saude",
     "descricao_programa_saude": "descricao_do_programa_de_saude", "sigla_origem": "sigla_do_sistema_de_origem"},
    [Step("produto", {"_produto_id": "produto_id"},
          {"co_catmat": "codigo_catmat", "descricao_produto": "descricao_catmat"}),
     Step("instituicao", {"_instituicao_id": "instituicao_id"},
          {**_PLACE, "codigo_cnes": "codigo_cnes", "nome_fantasia": "nome_instituicao",
           "razao_social": "razao_social"}),
     Step("endereco", {"_endereco_id": "endereco_id"},
          {"uf": "unidade_federativa", "municipio": "municipio", "codigo_ibge": "codigo_do_ibge",
           "latitude": "latitude", "longitude": "longitude"})],
)

LAKE_VIEWS = {"leitos": V_LEITOS, "bps": V_BPS, "bnafar": V_BNAFAR}


def lake_view(spark: SparkSession, name: str, database: str = "default", columns: list[str] | None = None,
              months: list[str] | None = None) -> DataFrame:
    """A flat view over the star tables of a database, of all months or of some partitions of the fact only."""
    view = LAKE_VIEWS[name]

    def table(t: str) -> DataFrame:
        rows = spark.table(f"{database}.{t}")
        return rows if months is None or t != view.fact else rows.where(F.col(MONTH).isin(months))

    return view.build(table, columns)


def month_slices(spark: SparkSession, name: str, database: str, limit: int, whole_years: bool = False) -> list[tuple[list[str], int]]:
    """All months of a view's fact and their rows, consecutive ones together up to ``limit`` rows, a month (or year) at least."""
    months = spark.table(f"{database}.{LAKE_VIEWS[name].fact}").groupBy(MONTH).agg(F.count(F.lit(1)).alias("rows")).orderBy(MONTH).collect()
    units: dict[str, tuple[list[str], int]] = {}
    for r in months:
        names, held = units.get(unit := r[MONTH][:4] if whole_years else r[MONTH], ([], 0))
        units[unit] = (names + [r[MONTH]], held + r["rows"])
    slices: list[tuple[list[str], int]] = []
    for names, n in units.values():
        if slices and slices[-1][1] + n <= limit:
            slices[-1] = (slices[-1][0] + names, slices[-1][1] + n)
        else:
            slices.append((names, n))
    return slices


def register_lake_views(spark: SparkSession, database: str = "default", prefix: str = "v_") -> list[str]:
    """Temporary views over the star for SQL text, for example ``v_leitos``.

    Each has all columns of the corpus tables; a question's SQL runs on them unchanged once the
    prefix is empty and the star lives in another database.
    """
    for name in LAKE_VIEWS:
        lake_view(spark, name, database).createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in LAKE_VIEWS]
