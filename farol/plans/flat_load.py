"""Full reload of the flat capacity table from files with varying headers.

The text is parsed once and staged; the table, the month flags, the rejected rows and the file report are made of that.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farol.functions import dates, numeric, text
from farol.operators.shaping import resolve_aliases
from farol.session import discard, staged
from farol.sources.delimited import REJECTED, parse_once, read_delimited
from farol.sources.tables import SOURCE, replace_table


@dataclass(frozen=True)
class FlatColumn:
    """Target column, type (``text(n)``, ``int``, ``decimal``, ``month``) and accepted headers."""

    target: str
    kind: str
    headers: list[str]


# Target, type, header spellings.
CAPACITY_TABLE = "hospitais_leitos"
CAPACITY_COLUMNS = [
    FlatColumn("regiao_brasil_hospital", "text(12)", ["regiao"]),
    FlatColumn("uf_hospital", "text(2)", ["uf"]),
    FlatColumn("codigo_ibge", "text(7)", ["co_ibge"]),
    FlatColumn("municipio_hospital", "text(60)", ["municipio"]),
    FlatColumn("cnes", "text(7)", ["cnes"]),
    FlatColumn("endereco_hospital", "text(60)", ["no_logradouro"]),
    FlatColumn("numero_endereco_hospital", "text(10)", ["nu_endereco"]),
    FlatColumn("complemento_endereco_hospital", "text(20)", ["no_complemento"]),
    FlatColumn("bairro_hospital", "text(60)", ["no_bairro"]),
    FlatColumn("cep_hospital", "text(8)", ["co_cep"]),
    FlatColumn("nome_hospital", "text(200)", ["nome_estabelecimento"]),
    FlatColumn("nome_razao_social_hospital", "text(60)", ["razao_social"]),
    FlatColumn("tipo_gestao_do_hospital", "text(1)", ["tp_gestao"]),
    FlatColumn("codigo_tipo_da_unidade", "text(2)", ["co_tipo_unidade"]),
    FlatColumn("descricao_do_tipo_da_unidade", "text(60)", ["ds_tipo_unidade"]),
    FlatColumn("natureza_juridica_do_hospital", "text(4)", ["natureza_juridica"]),
    FlatColumn("descricao_da_natureza_juridica_do_hospital", "text(60)", ["desc_natureza_juridica"]),
    FlatColumn("motivo_desabilitacao_hospital", "text(60)", ["motivo_desabilitacao"]),
    FlatColumn("email", "text(60)", ["no_email"]),
    FlatColumn("telefone", "text(40)", ["nu_telefone"]),
    FlatColumn("leitos_sus", "int", ["leitos_sus"]),
    FlatColumn("leitos_geral", "int", ["leitos_existentes", "leitos_existente"]),
    FlatColumn("uti_total", "int", ["uti_total_existente", "uti_total_exist"]),
    FlatColumn("uti_sus_total", "int", ["uti_total_sus"]),
    FlatColumn("uti_adulto", "int", ["uti_adulto_existente", "uti_adulto_exist"]),
    FlatColumn("uti_sus_adulto", "int", ["uti_adulto_sus"]),
    FlatColumn("uti_pediatrico", "int", ["uti_pediatrico_existente", "uti_pediatrico_exist"]),
    FlatColumn("uti_sus_pediatrico", "int", ["uti_pediatrico_sus"]),
    FlatColumn("uti_neonatal", "int", ["uti_neonatal_existente", "uti_neonatal_exist"]),
    FlatColumn("uti_sus_neonatal", "int", ["uti_neonatal_sus"]),
    FlatColumn("uti_queimado", "int", ["uti_queimado_existente", "uti_queimado_exist"]),
    FlatColumn("uti_sus_queimado", "int", ["uti_queimado_sus"]),
    FlatColumn("uti_coronariana", "int", ["uti_coronariana_existente", "uti_coronariana_exist"]),
    FlatColumn("uti_sus_coronariana", "int", ["uti_coronariana_sus"]),
    FlatColumn("data_competencia_info", "month", ["comp"]),
]


def select_flat(rows: DataFrame, columns: list[FlatColumn]) -> DataFrame:
    """Final names for the columns one header offers; unknown columns fall away."""
    kept = [c for c in (SOURCE, "row_order", REJECTED) if c in rows.columns]
    chosen = resolve_aliases(
        [c for c in rows.columns if c not in kept], {c.target: c.headers for c in columns})
    return rows.select(*kept, *[F.col(source).alias(target) for target, source in chosen.items()])


def month_fits(rows: DataFrame, column: str) -> DataFrame:
    """Per file, whether any value reads as ``yyyyMM``; if none does, other spellings are tried."""
    return rows.groupBy(SOURCE).agg(F.bool_or(dates.month_of(F.col(column)).isNotNull()).alias("__fits"))


def flat_value(c: Column, kind: str) -> Column:
    """One typed cell; over-long text is cut, numbers and dates that do not parse are null."""
    cell = text.null_words(c, text.FLAT_NULL_WORDS)
    if kind.startswith("text("):
        return text.cut(cell, int(kind[5:-1]))
    if kind == "int":
        return numeric.comma_int(cell)
    if kind == "decimal":
        return numeric.comma_decimal(cell)
    if kind == "month":
        return dates.month_or_date(cell, F.col("__fits"))
    raise ValueError(f"unknown column type {kind}")


def typed_rows(rows: DataFrame, columns: list[FlatColumn], fits: DataFrame | None = None) -> DataFrame:
    """Every column of the schema, absent ones null. ``fits`` are the files' month flags when they are known."""
    kinds = {c.target: c.kind for c in columns}
    empty = {"int": "int", "decimal": "decimal(20,4)", "month": "date"}
    months = [c.target for c in columns if c.kind == "month" and c.target in rows.columns]
    for column in months:
        flags = month_fits(rows, column) if fits is None else fits
        rows = rows.join(flags, SOURCE, "left").withColumn("__fits", F.coalesce("__fits", F.lit(False)))
    cells = [
        (flat_value(F.col(t), k) if t in rows.columns else F.lit(None).cast(empty.get(k, "string"))).alias(t)
        for t, k in kinds.items()]
    return rows.select(SOURCE, *cells)


def _loses(rows: DataFrame, columns: list[FlatColumn]) -> dict[str, Column]:
    """Per integer column that is there, whether a cell's fraction is cut."""
    ints = [c.target for c in columns if c.kind == "int" and c.target in rows.columns]
    return {c: numeric.loses_fraction(text.null_words(F.col(c), text.FLAT_NULL_WORDS)) for c in ints}


def lossy_counts(rows: DataFrame, columns: list[FlatColumn]) -> DataFrame:
    """Values per integer column whose fraction is cut."""
    lossy = _loses(rows, columns)
    return rows.agg(*[F.count_if(flag).alias(c) for c, flag in lossy.items()]).unpivot([], list(lossy), "column", "lossy")


def read_flat(spark: SparkSession, paths: list[str], columns: list[FlatColumn] | None = None) -> DataFrame:
    """Text rows under the final names, one select per distinct header."""
    wanted = columns or CAPACITY_COLUMNS
    return read_delimited(spark, paths, by_frequency=True, each=lambda part: select_flat(part, wanted))


@dataclass
class FlatLoad:
    """The table that a reload made, its rejected rows and the report of its files, as tables beside it."""

    table: DataFrame
    rejects: DataFrame
    report: DataFrame


def load_flat(spark: SparkSession, paths: list[str], table: str = CAPACITY_TABLE, columns: list[FlatColumn] | None = None) -> FlatLoad:
    """Replace the flat table by the rows of all files.

    ``<table>__rejects`` gets the rows with more fields than their header, ``<table>__files`` a row per file: lines, rows,
    long rows and integers whose fraction is cut.
    """
    wanted = columns or CAPACITY_COLUMNS
    parsed, folders = parse_once(spark, paths, by_frequency=True, each=lambda part: select_flat(part, wanted)), []
    try:
        rows, fits = parsed.rows(), None
        months = [c.target for c in wanted if c.kind == "month" and c.target in rows.columns]
        if months:
            # a written row per file: the join knows its size beforehand and does not shuffle the rows
            folder, fits = staged(month_fits(rows, months[0]), "month-fits")
            folders.append(folder)
        replace_table(spark, table, typed_rows(rows, wanted, fits).drop(SOURCE))
        replace_table(spark, f"{table}__rejects", parsed.rejects())
        lossy = [F.when(flag, 1).otherwise(0) for flag in _loses(rows, wanted).values()]
        replace_table(spark, f"{table}__files", parsed.report(lossy=reduce(lambda a, b: a + b, lossy, F.lit(0))))
    finally:
        discard(spark, *folders)
        parsed.discard()
    return FlatLoad(spark.table(table), spark.table(f"{table}__rejects"), spark.table(f"{table}__files"))


def reload_flat(spark: SparkSession, paths: list[str], table: str = CAPACITY_TABLE,
                columns: list[FlatColumn] | None = None) -> DataFrame:
    """Replace the flat table by the rows of all files; returns the table."""
    return load_flat(spark, paths, table, columns).table
