from __future__ import annotations

import datetime as dt
import os
import time
import uuid
import zipfile
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from farol.plans import beds, datasets, flat_load, questions, snapshots, star_load
from farol.plans.views import LAKE_VIEWS, lake_view, month_slices, register_lake_views
from farol.session import scratch_dir
from farol.sources.delimited import read_delimited
from farol.sources.tables import ensure_table, read_merged, reserve_ids
from farol.streaming.ingest import ingest_folder

PURCHASE_HEADER = ("Código BR;Descrição CATMAT;ANVISA;Genérico;Compra;Inserção;Modalidade da Compra;Tipo Compra;Capacidade;"
                   "Unidade Medida;Qtd Itens Comprados;Preço Unitário;Preço Total;Fornecedor;CNPJ Fornecedor;Fabricante;"
                   "CNPJ Fabricante;Nome Instituição;CNPJ Instituição;Município Instituição;UF\n")


def purchase(code="10", name="Seringa", day="2023/05/01", qty="2,0", price="1.000,50", total="2.001,00", supplier="Forn A",
             supplier_id="11.111/0001-11", maker="Fab", maker_id="22", buyer="Hosp", buyer_id="33", city="Natal", uf="rn"):
    return f"{code};{name};;S;{day};01/06/2023;Pregão;A;1;UN;{qty};{price};{total};{supplier};{supplier_id};{maker};{maker_id};{buyer};{buyer_id};{city};{uf}\n"


def write(folder, name, text, encoding="latin-1"):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_purchases_load_twice(spark, database, tmp_path):
    old = write(tmp_path / "in", "bps_2022.csv", PURCHASE_HEADER + purchase(total="") + purchase(code="20", name="Gaze", supplier="nan"))
    # later file: other spelling of the supplier, swapped maker columns, a total of 0
    new = write(tmp_path / "in", "bps_2023.csv", PURCHASE_HEADER
                + purchase(supplier="Forn B", maker="22", maker_id="FAB", total="0", qty="-1,5", price="12.50")
                + purchase(code="30", name="Luva", buyer_id="44", buyer="Clínica", city="N/A", maker="22", maker_id="FAB"))
    report = star_load.load_star(spark, read_delimited(spark, [old, new]), datasets.PURCHASES, database)
    assert report.added == {"endereco": 2, "fornecedor": 1, "fabricante": 1, "produto": 3, "instituicao": 2,
                            "instituicao_compra_produto": 4}
    assert rows(report.frame(spark))[0] == ("endereco", 2)
    view = lake_view(spark, "bps", database)
    got = rows(view.select("codigo_br", "fornecedor", "cnpj_fornecedor", "fabricante", "cnpj_fabricante", "nome_instituicao",
                           "municipio", "uf_instituicao", "ano_compra", "quantidade_itens_comprados", "preco_unitario", "preco_total"))
    one = ("FORN A", "11111000111", "FAB", "22", "HOSP", "NATAL", "RN", 2023)
    price = Decimal("1000.5000")
    assert got == sorted([
        ("10", *one, Decimal("2.0000"), price, Decimal("2001.0000")), ("20", *one, Decimal("2.0000"), price, Decimal("2001.0000")),
        ("10", *one, Decimal("-1.5000"), Decimal("12.5000"), Decimal("-18.7500")),
        ("30", "FORN A", "11111000111", "FAB", "22", "CLÍNICA", "", "RN", 2023, Decimal("2.0000"), price, Decimal("2001.0000"))], key=repr)
    ids = [r[0] for r in spark.table(f"{database}.instituicao_compra_produto").select("instituicao_compra_produto_id").collect()]
    assert sorted(ids) == [1, 2, 3, 4]
    # the same files again: no new keys, the facts are replaced
    again = star_load.load_star(spark, read_delimited(spark, [old, new]), datasets.PURCHASES, database)
    assert again.added == {"endereco": 0, "fornecedor": 0, "fabricante": 0, "produto": 0, "instituicao": 0,
                           "instituicao_compra_produto": 4}
    assert rows(lake_view(spark, "bps", database, ["codigo_br", "preco_total"])) == rows(view.select("codigo_br", "preco_total"))


STOCK_HEADER = ("sg_uf;co_municipio_ibge;no_municipio;co_cnes;no_razao_social;no_fantasia;co_cep;no_logradouro;nu_endereco;no_bairro;"
                "no_email;nu_telefone;nu_latitude;nu_longitude;dt_posicao_estoque;co_catmat;ds_produto;qt_estoque;nu_lote;dt_validade;"
                "tp_produto;sg_programa_saude;ds_programa_saude;sg_origem\n")


def stock(cnes="7", product="10", qty="3,0", lot="L1", expiry="2025-06-30 00:00:00-03", city="Natal", day="2025/05/06"):
    return (f"RN;2408102;{city};{cnes};Razão;Posto {cnes};59000000.0;Rua;1;Centro;a@b;1;-5,79448;-35,211;{day};{product};Seringa;{qty};"
            f"{lot};{expiry};B;HIV;Programa HIV;HORUS\n")


CAPACITY_HEADER = ("COMP;REGIAO;UF;MUNICIPIO;CNES;NOME ESTABELECIMENTO;NO_LOGRADOURO;NU_ENDERECO;CO_CEP;NO_BAIRRO;CO_IBGE;NO_EMAIL;"
                   "LEITOS_EXISTENTES;LEITOS_SUS;UTI_TOTAL - EXIST;UTI_TOTAL - SUS\n")


def capacity(month="202505", cnes="7", beds="100", public="60", icu="3,7", name="Hospital"):
    return f"{month};Nordeste;RN;Natal;{cnes};{name};Rua;1;59000-000;Centro;2408102;;{beds};{public};{icu};1\n"


def test_three_datasets_and_questions(spark, database, tmp_path):
    folder = tmp_path / "in"
    load = star_load.load_star
    load(spark, read_delimited(spark, [write(folder, "c.csv", CAPACITY_HEADER + capacity() + capacity(cnes="8", public="x"))]),
         datasets.CAPACITY, database)
    load(spark, read_delimited(spark, [write(folder, "s.csv", STOCK_HEADER + stock() + stock(lot="L2", qty="4,0") + stock(cnes="99"))]),
         datasets.STOCK, database)
    load(spark, read_delimited(spark, [write(folder, "p.csv", PURCHASE_HEADER + purchase(day="2024/05/01") + purchase(price="5,0"))]),
         datasets.PURCHASES, database)
    # the address is known from the capacity file, CNES 7 and 8 too; stock adds 99
    assert spark.table(f"{database}.endereco").count() == 2
    assert rows(spark.table(f"{database}.instituicao").select("codigo_cnes", "cnpj_instituicao")) == [
        ("7", None), ("8", None), ("99", None), (None, "33")]
    # purchases and stock keep separate product rows
    assert rows(spark.table(f"{database}.produto").select("codigo_catmat", "anvisa")) == [("10", ""), ("10", "N/A")]
    beds = lake_view(spark, "leitos", database)
    first = beds.where("cnes = '7'").first()
    assert (first["leitos_geral"], first["uti_total"], first["email"], first["data_competencia_info"]) == (100, 0, None, dt.date(2025, 5, 1))
    assert rows(beds.select("cnes", "leitos_sus", "cep_hospital")) == [("7", 60, "59000000"), ("8", 0, "59000000")]
    stocked = lake_view(spark, "bnafar", database)
    assert rows(stocked.select("latitude", "codigo_ibge").distinct()) == [(None, "2408102")]  # the first file of an address wins
    assert rows(stocked.select(F.date_format("data_validade", "yyyy-MM-dd HH:mm")).distinct()) == [("2025-06-30 03:00",)]
    assert rows(questions.facilities_stocking(beds, stocked, "%SERINGA%")) == [("HOSPITAL", "7"), ("HOSPITAL", "7")]
    bought = lake_view(spark, "bps", database)
    gaps = rows(questions.price_gap_by_facility(bought, stocked, 36, "2025-06-01"))
    assert gaps == [("7", "SERINGA", 497.75), ("99", "SERINGA", 497.75)]


def test_corpus_sql_runs_on_the_views(spark, database, tmp_path):
    path = write(tmp_path / "in", "c.csv", CAPACITY_HEADER + capacity() + capacity(month="202504", beds="5"))
    star_load.load_star(spark, read_delimited(spark, [path]), datasets.CAPACITY, database)
    stock_path = write(tmp_path / "in", "s.csv", STOCK_HEADER + stock())
    star_load.load_star(spark, read_delimited(spark, [stock_path]), datasets.STOCK, database)
    for table, dataset in (("instituicao_compra_produto", datasets.PURCHASES),):
        for dim in dataset.dimensions:
            ensure_table(spark, f"{database}.{dim.table}", star_load.dimension_schema(dim))
        ensure_table(spark, f"{database}.{table}", star_load.fact_schema(dataset.fact), "source_file", "mes")
    assert register_lake_views(spark, database, "") == list(LAKE_VIEWS)
    got = spark.sql("""SELECT SUM(leitos_geral) AS n FROM leitos WHERE uf_hospital = 'RN' AND
        data_competencia_info = (SELECT MAX(data_competencia_info) FROM leitos)""").first()["n"]
    assert got == 100
    got = spark.sql("""SELECT l.nome_hospital FROM leitos l JOIN bnafar b ON l.cnes = b.codigo_cnes
        WHERE b.descricao_produto ILIKE '%seringa%' AND b.data_validade BETWEEN DATE '2025-06-01' AND (DATE '2025-06-01' + INTERVAL '3' MONTH)
        AND (l.uti_total - l.uti_sus_total) * 100.0 / NULLIF(l.uti_total, 0) IS NULL""")
    assert got.count() == 2
    assert spark.sql("SELECT COUNT(DISTINCT cnpj_instituicao) c FROM bps WHERE ano_compra = EXTRACT(YEAR FROM CURRENT_DATE) - 1").first()["c"] == 0
    for name in LAKE_VIEWS:
        spark.catalog.dropTempView(name)


def test_views_join_only_what_is_asked(spark, database, tmp_path):
    path = write(tmp_path / "in", "p.csv", PURCHASE_HEADER + purchase())
    star_load.load_star(spark, read_delimited(spark, [path]), datasets.PURCHASES, database)
    few = lake_view(spark, "bps", database, ["preco_total", "fornecedor"])
    assert "Join" in few._jdf.queryExecution().optimizedPlan().toString()
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert lake_view(spark, "bps", database, ["preco_total"])._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert lake_view(spark, "bps", database, ["uf_instituicao"])._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    with pytest.raises(ValueError, match="no such columns"):
        lake_view(spark, "bps", database, ["absent"])


def test_sync_keys_only(spark, database):
    table = f"{database}.k"
    ensure_table(spark, table, spark.createDataFrame([], "id bigint, a string").schema)
    data = spark.createDataFrame([(1,), (1,), (None,), (2,)], "a int")
    assert star_load.sync_keys(spark, database, "k", ["a"], "id", data) == 2
    assert star_load.sync_keys(spark, database, "k", ["a"], "id", spark.createDataFrame([(2,), (3,)], "a int")) == 1
    got = spark.table(table).collect()
    assert sorted(r["a"] for r in got) == ["1", "2", "3"] and sorted(r["id"] for r in got) == [1, 2, 3]


def test_a_second_load_reads_no_fact(spark, database, tmp_path):
    folder = tmp_path / "in"

    def load(path):
        return star_load.load_star(spark, read_delimited(spark, [path]), datasets.PURCHASES, database).added

    first = write(folder, "bps_2022.csv", PURCHASE_HEADER + purchase() + purchase(code="20", name="Gaze"))
    load(first)
    fact = f"{database}.instituicao_compra_produto"
    for file in spark.table(fact).inputFiles():
        path = file.removeprefix("file://").replace("%253A", "%3A").replace("%252F", "%2F")
        with open(path, "wb") as out:
            out.write(b"not parquet")
    second = write(folder, "bps_2023.csv", PURCHASE_HEADER + purchase(name="Outro", supplier="Outro") + purchase(code="30", name="Luva", buyer_id="44"))
    assert load(second) == {"endereco": 0, "fornecedor": 0, "fabricante": 0, "produto": 1, "instituicao": 1, "instituicao_compra_produto": 2}
    new = spark.table(fact).where(F.col("source_file").endswith("2023.csv"))
    assert rows(new.select("instituicao_compra_produto_id")) == [(3,), (4,)]
    # the first row of a key has won, and ids go on after those reserved before
    assert rows(spark.table(f"{database}.produto").select("produto_id", "descricao_catmat").where("produto_id = 3")) == [(3, "LUVA")]
    assert rows(spark.table(f"{database}.fornecedor").select("nome_fornecedor")) == [("FORN A",)]
    assert rows(spark.table(f"{database}.id_ranges").where("table_name = 'produto'").select("last_id")) == [(3,)]


def test_a_table_without_reserved_ids_goes_on_after_its_highest(spark, database):
    ensure_table(spark, f"{database}.t", spark.createDataFrame([], "id bigint, a string").schema)
    spark.createDataFrame([(41, "x")], "id bigint, a string").write.insertInto(f"{database}.t")
    assert reserve_ids(spark, database, "t", "id", 0) == 41
    assert reserve_ids(spark, database, "t", "id", 5) == 41 and reserve_ids(spark, database, "t", "id", 2) == 46


def test_a_failed_load_leaves_no_staged_rows(spark, database, tmp_path):
    from farol.session import scratch_root

    path = write(tmp_path / "in", "p.csv", PURCHASE_HEADER + purchase())
    before = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    spark.sql(f"CREATE TABLE {database}.instituicao_compra_produto (id bigint, source_file string) USING csv PARTITIONED BY (source_file)")
    spark.sql(f"CREATE VIEW {database}.fornecedor AS SELECT 1 AS x")
    with pytest.raises(Exception):  # noqa: B017
        star_load.load_star(spark, read_delimited(spark, [path]), datasets.PURCHASES, database)
    left = set(os.listdir(scratch_root(spark).removeprefix("file:"))) - before
    assert not [f for f in left if f.startswith("bps-")]


def test_newest_snapshot_prunes_partitions_and_reads_once(spark, database, tmp_path):
    folder = tmp_path / "in"

    def load(name, text):
        star_load.load_star(spark, read_delimited(spark, [write(folder, name, text)]), datasets.CAPACITY, database)

    load("a.csv", CAPACITY_HEADER + "".join(capacity(month=m, beds=b) for m, b in (("202403", "5"), ("202405", "7"))))
    load("b.csv", CAPACITY_HEADER + capacity(month="202404", beds="9") + capacity(month="x", beds="1"))
    assert snapshots.newest_date(spark, "leitos", database) == dt.date(2024, 5, 1)
    view = snapshots.latest_view(spark, "leitos", database, ["cnes", "leitos_geral", "data_competencia_info"])
    totals = questions.bed_totals(snapshots.latest_view(spark, "leitos", database, ["leitos_geral", "leitos_sus", "data_competencia_info"]),
                                  month=snapshots.newest_date(spark, "leitos", database))
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PartitionFilters: [isnotnull(mes" in plan and "(mes" in plan and "= 2024-05)" in plan
    assert rows(view) == [("7", 7, dt.date(2024, 5, 1))] and rows(totals) == [(7, 60)]
    # the file is loaded again without its newest month: that month goes, and the date with it
    load("a.csv", CAPACITY_HEADER + capacity(month="202403", beds="6"))
    assert snapshots.newest_date(spark, "leitos", database) == dt.date(2024, 4, 1)
    assert rows(spark.table(f"{database}.leitos").select("quantidade_leitos_gerais", "mes")) == [(1, "none"), (6, "2024-03"), (9, "2024-04")]
    assert rows(snapshots.latest_view(spark, "leitos", database, ["leitos_geral"])) == [(9,)]
    assert rows(snapshots.latest_view(spark, "leitos", database, ["leitos_geral"], dt.date(2024, 3, 1))) == [(6,)]


def test_files_of_different_ages_are_one_table(spark, database):
    folder = scratch_dir(spark, "ages")
    spark.createDataFrame([(1, "a")], "id int, a string").write.parquet(f"{folder}/v=1")
    spark.createDataFrame([(2, "b", 5)], "id int, a string, n int").write.parquet(f"{folder}/v=2")
    assert rows(read_merged(spark, [f"{folder}/v=1", f"{folder}/v=2"]).select("id", "a", "n")) == [(1, "a", None), (2, "b", 5)]
    wanted = spark.createDataFrame([], "n bigint, id bigint, z string").schema
    assert rows(read_merged(spark, [f"{folder}/v=1"], wanted)) == [(None, 1, None)]


def test_reset_only_on_call(spark, database, tmp_path):
    path = write(tmp_path / "in", "p.csv", PURCHASE_HEADER + purchase())
    star_load.load_star(spark, read_delimited(spark, [path]), datasets.PURCHASES, database)
    star_load.reset_star(spark, database)
    assert not spark.catalog.tableExists(f"{database}.produto")


FLAT = 'comp;"uf";"municipio";"cnes";"leitos_existente";"UTI_TOTAL - EXIST";"leitos_sus"\n'


def test_flat_reload(spark, database, tmp_path):
    folder = tmp_path / "flat"
    files = [
        write(folder, "a.csv", FLAT + '202301;"SP ";"São João";"123456789";"10";"3,7";"NULL"\n202302;"RJ";"";"2";"x";"4";"1"\n'),
        write(folder, "b.csv", "comp,uf,cnes,leitos_existentes,leitos_existente,outro\n2023-03-01,AC,3,7,8,z\n", "utf-8"),
    ]
    table = f"{database}.hospitais_leitos"
    got = flat_load.reload_flat(spark, files, table)
    assert len(got.columns) == 35
    view = got.select("uf_hospital", "municipio_hospital", "cnes", "leitos_geral", "uti_total", "leitos_sus",
                      F.col("data_competencia_info").cast("string"))
    assert rows(view) == [("AC", None, "3", 7, None, None, "2023-03-01"), ("RJ", None, "2", None, 4, 1, "2023-02-01"),
                          ("SP", "São João", "1234567", 10, 3, None, "2023-01-01")]
    lossy = flat_load.lossy_counts(flat_load.read_flat(spark, files), flat_load.CAPACITY_COLUMNS)
    assert rows(lossy.where("lossy > 0")) == [("uti_total", 1)]
    # a reload replaces the table
    assert flat_load.reload_flat(spark, files[1:], table).count() == 1


def test_flat_load_keeps_rejects_and_a_report(spark, database, tmp_path):
    folder = tmp_path / "flat"
    files = [write(folder, "a.csv", FLAT + '202301;"SP";"x";"1";"10";"3,7";"1"\n202302;"RJ";"y";"2";"2,5";"4";"1";"mais"\n202303;"RJ";"y";"3";"2,5";"4,5";"1"\n'),
             write(folder, "b.csv", "comp,uf,cnes\n2023-03-01,AC,3\n", "utf-8")]
    loaded = flat_load.load_flat(spark, files, f"{database}.hospitais_leitos")
    assert rows(loaded.table.select("cnes", "leitos_geral")) == [("1", 10), ("3", 2), ("3", None)]
    assert [r["fields"][-1] for r in loaded.rejects.collect()] == ["mais"]
    assert rows(loaded.report.select(F.regexp_extract("source_file", "[^/]*$", 0), "lines", "rows", "long_rows", "lossy")) == [("a.csv", 4, 2, 1, 3), ("b.csv", 2, 1, 0, 0)]


def test_capacity_check_counts_repeated_rows(spark):
    data = [("f", "1", "202301"), ("f", "1", "202301"), ("f", "2", "202302"), ("f", "2", "x"), ("f", "2", None), ("g", "1", "2023-01-01")]
    got = beds.capacity_check(spark.createDataFrame(data, "source_file string, cnes string, data_competencia_info string"))
    assert rows(got.select("source_file", "valid", "invalid", "first_day", "last_day", "repeated")) == [
        ("f", 3, 2, "2023-01-01", "2023-02-01", 2), ("g", 1, 0, "2023-01-01", "2023-01-01", 0)]


def test_incremental_ingest(spark, database, tmp_path):
    folder, checkpoint = tmp_path / "landing", scratch_dir(spark, "cp")
    write(folder, "stock 2025 50%.csv", STOCK_HEADER + stock() + stock(lot="L2"))
    write(folder, "broken.csv", "nothing here\n")

    def run():
        report = star_load.LoadReport()
        ingest_folder(spark, str(folder), datasets.STOCK, checkpoint, database, report=report).awaitTermination()
        return report.added

    fact = f"{database}.instituicao_estoca_produto"
    # the unreadable file does not keep the other one out
    assert run()["instituicao_estoca_produto"] == 2
    assert run() == {}
    with zipfile.ZipFile(folder / "stock_2026.zip", "w") as archive:
        archive.writestr("stock.csv", (STOCK_HEADER + stock(lot="L3") + stock(cnes="8")).encode("latin-1"))
    assert run()["instituicao"] == 1
    assert spark.table(fact).count() == 4
    done = rows(spark.table(f"{database}.processed_files").select(F.regexp_extract("path", "[^/]*$", 0)))
    assert done == [("stock 2025 50%.csv",), ("stock_2026.zip",)]
    # a new checkpoint hands over all files again, the ledger keeps the loaded ones out
    ingest_folder(spark, str(folder), datasets.STOCK, scratch_dir(spark, "cp"), database).awaitTermination()
    assert spark.table(fact).count() == 4


def test_failed_files_are_tried_again(spark, database, tmp_path, monkeypatch):
    from farol.streaming import ingest

    folder, checkpoint, real, lost = tmp_path / "landing", scratch_dir(spark, "cp"), ingest.load_star, []
    write(folder, "stock_2021.csv", STOCK_HEADER + stock())

    def once_lost(*args, **kwargs):
        if not lost:
            lost.append(1)
            raise RuntimeError("an executor is gone")
        return real(*args, **kwargs)

    monkeypatch.setattr(ingest, "load_star", once_lost)

    def run():
        ingest_folder(spark, str(folder), datasets.STOCK, checkpoint, database).awaitTermination()

    with pytest.raises(Exception, match="tries them again"):
        run()
    run()
    assert spark.table(f"{database}.instituicao_estoca_produto").count() == 1
    assert spark.table(f"{database}.processed_files").count() == 1


def test_the_oldest_year_comes_first(spark, tmp_path):
    def names(max_files):
        database = f"db_{uuid.uuid4().hex}"
        spark.sql(f"CREATE DATABASE {database} LOCATION '{scratch_dir(spark, database)}'")
        ingest_folder(spark, str(folder), datasets.STOCK, scratch_dir(spark, "cp"), database, max_files=max_files).awaitTermination()
        return rows(spark.table(f"{database}.instituicao").drop("instituicao_id", "endereco_id"))

    folder = tmp_path / "landing"
    write(folder, "stock_2021.csv", STOCK_HEADER + stock().replace("Posto 7", "Posto novo"))
    write(folder, "stock_2020.csv", STOCK_HEADER + stock())
    os.utime(folder / "stock_2021.csv", (1, 1))
    assert names(1) == names(1000) and "POSTO 7" in str(names(1))


def test_rows_are_numbered_without_a_shuffle(spark):
    from farol.operators.keys import file_offsets, number_rows
    from farol.session import staged

    folder, _ = staged(spark.range(0, 100, 1, 3), "numbered")
    _, offsets = staged(file_offsets(spark, folder), "offsets")
    numbered = number_rows(spark, folder, "n", offsets=offsets)
    assert rows(numbered.select("n")) == [(i,) for i in sorted(range(1, 101), key=lambda i: repr((i,)))]
    assert "Exchange hashpartitioning" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_copies_of_dimension_rows_are_combined_before_they_are_sorted(spark):
    dim = datasets.Dimension("d", "d_id", ["k"], [datasets.Rule("a", "k"), datasets.Rule("b", "name")])
    order = F.struct(F.lit(2020).alias("year"), F.lit("f").alias("path"), F.lit(0).cast("bigint").alias("block"), F.col("id").alias("pos"))
    raw = spark.range(1000).select((F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") < 900, (F.col("id") % 2).cast("string")).alias("b"), order.alias("row_order"))
    got = star_load.dimension_rows(raw, dim)
    assert rows(got.select("k", "name")) == [("0", "0"), ("1", "1"), ("2", "0")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("HashAggregate")


def test_a_load_in_slices_equals_one_in_whole(spark, database, tmp_path, monkeypatch):
    # products and suppliers come again in later files under other names; the first one stays
    files = [write(tmp_path / "in", f"bps_{2018 + i}.csv", PURCHASE_HEADER + "".join(
        purchase(code=str((i + k) % 4), name=f"N{i}{k}", day=f"{2018 + i}/0{1 + k}/01", qty=f"{i}{k},0", supplier=f"S{i}", supplier_id=str(k % 2)) for k in range(3)))
        for i in range(5)]
    wide = [c for c in LAKE_VIEWS["bps"].columns()]
    whole = star_load.load_star(spark, read_delimited(spark, files), datasets.PURCHASES, database)
    want = rows(lake_view(spark, "bps", database, wide))
    other, written, replace = f"{database}_s", [], star_load.replace_files
    spark.sql(f"CREATE DATABASE {other} LOCATION '{scratch_dir(spark, other)}'")
    monkeypatch.setattr(star_load, "SLICE_ROWS", 7)
    monkeypatch.setattr(star_load, "replace_files", lambda s, table, df: written.append(table) or replace(s, table, df))
    sliced = star_load.load_star(spark, read_delimited(spark, files), datasets.PURCHASES, other)
    # three rows a file, two files a slice
    assert len(written) == 3 and sliced.added == whole.added
    assert rows(lake_view(spark, "bps", other, wide)) == want
    ids = [r[0] for r in spark.table(f"{other}.instituicao_compra_produto").select("instituicao_compra_produto_id").collect()]
    assert sorted(ids) == list(range(1, 16))
    months = month_slices(spark, "bps", other, 4)
    assert sum(n for _, n in months) == 15 and all(n <= 4 for _, n in months)
    assert rows(spark.createDataFrame([tuple(r) for m, _ in months for r in lake_view(spark, "bps", other, wide, m).collect()], lake_view(spark, "bps", other, wide).schema)) == want
    assert [n for _, n in month_slices(spark, "bps", other, 4, whole_years=True)] == [3] * 5


def test_files_with_interleaving_rows_share_a_slice(spark):
    raw = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), ("c", 5), ("c", None)], "source_file string, row_order int")
    assert [set(s) for s in star_load.file_slices(raw, 1)] == [{"a", "b"}, {None}, {"c"}]
    assert star_load.file_slices(raw.limit(0), 1) == []


def test_parts_of_line_items_are_all_of_them(spark, tmp_path):
    from farol.plans import order_views

    keys = [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    spark.createDataFrame([(k,) for k in keys], "l_orderkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k,) for k in keys], "o_orderkey int").write.parquet(str(tmp_path / "orders.parquet"))
    parts = [order_views.tables(spark, str(tmp_path), (k, 3)) for k in range(3)]
    found = [rows(load("lineitem")) for load in parts]
    assert sorted((r for f in found for r in f), key=repr) == sorted(((k,) for k in keys), key=repr) and sum(map(bool, found)) > 1
    assert [rows(load("orders")) for load in parts] == found


def test_writes_leave_no_shuffle_files(spark):
    from farol.session import prepare, staged

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in str(files.mkString("\n")).split("\n") if "shuffle_" in f}

    prepare(spark)
    before = shuffled()
    _, table = staged(spark.range(1000).groupBy(F.col("id") % 100).count(), "shuffled")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before and table.count() == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
