from __future__ import annotations

import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farol.plans import reference
from farol.sources import delimited, jdbc, listing, tables
from farol.sources.archives import archive_lines
from farol.sources.geojson import feature_names


def write(path, text, encoding="utf-8"):
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


def data(df):
    return rows(df.drop("source_file", "row_order"))


def test_formats_and_headers(spark, tmp_path):
    files = [
        write(tmp_path / "a_2021.csv", "Código BR;Preço;UF\n1;2,5;SP\n2;;São\n", "latin-1"),
        write(tmp_path / "b_2022.csv", "﻿Código BR,Preço,UF\n3,\"4,5\",AÇ\n"),
        write(tmp_path / "c_2020.csv", "uf;codigo_br\nRJ;9\n"),
    ]
    got = delimited.read_delimited(spark, files)
    assert got.columns[:3] == ["codigo_br", "preco", "uf"]
    assert rows(got.select("codigo_br", "preco", "uf")) == [
        ("1", "2,5", "SP"), ("2", None, "São"), ("3", "4,5", "AÇ"), ("9", None, "RJ")]
    order = [r["codigo_br"] for r in got.orderBy("row_order").select("codigo_br").collect()]
    assert order == ["9", "1", "2", "3"]


def test_first_match_order(spark, tmp_path):
    lines = delimited.raw_lines(spark, [
        write(tmp_path / "a.csv", "a,b;c\n1,2;3\n"), write(tmp_path / "b.csv", "a,b\n1;1;1,2\n"),
        write(tmp_path / "c.csv", "one\n1;1\n"), write(tmp_path / "d.csv", "a;b\n\xe7;1\n", "latin-1")])
    judged = delimited.judge_files(lines).select(F.regexp_extract("path", "([a-z]).csv$", 1), "separator", "encoding")
    assert rows(judged) == [("a", ";", "UTF-8"), ("b", ",", "UTF-8"), ("c", None, "UTF-8"), ("d", ";", "ISO-8859-1")]
    frequent = delimited.judge_files(lines, by_frequency=True).select(F.regexp_extract("path", "([a-z]).csv$", 1), "separator")
    # by frequency at least three columns are needed
    assert rows(frequent) == [("a", None), ("b", None), ("c", None), ("d", None)]


def test_late_bad_byte_changes_the_encoding(spark, tmp_path):
    body = "a;b\n" + "x;1\n" * 5000 + "\xe9;2\n"
    judged = delimited.judge_files(delimited.raw_lines(spark, [write(tmp_path / "a.csv", body, "latin-1")]))
    assert judged.first()["encoding"] == "ISO-8859-1"


def test_bad_and_short_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a;b;c\n1;2;3\n1;2;3;4\n5;6\n"x;y";"q ""r""";NA\n\n')
    got = delimited.read_delimited(spark, [path])
    assert data(got) == [("1", "2", "3"), ("5", "6", None), ("x;y", 'q "r"', None)]
    counts = delimited.ignored_lines(spark, [path], got).first()
    assert (counts["lines"], counts["parsed"], counts["ignored"]) == (6, 3, 3)


def test_unreadable_files(spark, tmp_path):
    with pytest.raises(ValueError, match="separator"):
        delimited.read_delimited(spark, [write(tmp_path / "a.csv", "one\n1\n")])


def test_quote_repair_and_nul(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'comp;"uf";"nome"\n202301;"SP";"Casa; Nova"\n202302;"R\x00J";"B"\n"202303";"AC";"C"\n')
    got = delimited.read_delimited(spark, [path], by_frequency=True)
    assert data(got) == [("202301", "SP", "Casa; Nova"), ("202302", "RJ", "B"), ("202303", "AC", "C")]


def test_multi_line_fields(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a;b\n1;"two\nlines"\n')
    assert data(delimited.read_delimited(spark, [path], multi_line=True)) == [("1", "two\nlines")]


def test_repeated_header_names(spark, tmp_path):
    got = delimited.read_delimited(spark, [write(tmp_path / "a.csv", "a;a;b\n1;2;3\n")])
    assert got.columns[:3] == ["a", "a_1", "b"]


def test_fixed_columns(spark, tmp_path):
    path = write(tmp_path / "a.csv", "x;y\né;1\n2\n", "latin-1")
    assert rows(delimited.read_fixed(spark, [path], ["x", "y"], encoding="ISO-8859-1")) == [("2", None), ("é", "1")]


def test_archives(spark, tmp_path):
    one, two, none = (str(tmp_path / n) for n in ("a_2020.zip", "b_2021.zip", "c.zip"))
    with zipfile.ZipFile(one, "w") as z:
        z.writestr("readme.txt", "no")
        z.writestr("DATA.CSV", "id;nome\r\n1;Belém\r\n2;x\r\n".encode("latin-1"))
        z.writestr("later.csv", "id;nome\n9;9\n")
    with zipfile.ZipFile(two, "w") as z:
        z.writestr("d.csv", "nome,id\n" + "é,5\n" * 3)
    with zipfile.ZipFile(none, "w") as z:
        z.writestr("readme.txt", "no")
    lines = archive_lines(spark, [one, two, none], spread=3)
    got = delimited.rows_from_lines(lines).select("id", "nome")
    assert rows(got) == [("1", "Belém"), ("2", "x"), ("5", "é"), ("5", "é"), ("5", "é")]
    # archives above a size are streamed by name, with the same lines
    streamed = archive_lines(spark, [one, two, none], largest=150)
    assert rows(streamed) == rows(lines) and streamed.count() == 7


def test_archive_lines_are_numbered_over_batches(spark, tmp_path, monkeypatch):
    from farol.sources import archives

    path = str(tmp_path / "long.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d.csv", "".join(f"{i};x\n" for i in range(2 * archives.LINES_PER_BATCH + 5)))
    lines = archive_lines(spark, [path])
    assert lines.where(F.concat(F.col("pos").cast("string"), F.lit(";x")) == F.col("line")).count() == 2 * archives.LINES_PER_BATCH + 5


def test_parse_once_keeps_rejects_and_counts_per_file(spark, tmp_path):
    good = write(tmp_path / "good.csv", "a;b\n1;2\n3;4;\n5;6;7;8\n")
    bad = write(tmp_path / "bad.csv", "nothing here\n")
    other = write(tmp_path / "other.csv", "b,c,d\n9,8,7\n1,2,3,4\n\n")
    parsed = delimited.parse_once(spark, [good, bad, other])
    assert rows(parsed.rows().select("a", "b", "c", "d")) == [("1", "2", None, None), ("3", "4", None, None), (None, "9", "8", "7")]
    assert sorted(r["fields"] for r in parsed.rejects().collect()) == [["1", "2", "3", "4"], ["5", "6", "7"]]
    report = parsed.report(nines=F.when(F.col("b") == "9", 1).otherwise(0))
    assert rows(report.select(F.regexp_extract("source_file", "[^/]*$", 0), "lines", "rows", "long_rows", "nines", "readable")) == [
        ("bad.csv", 1, 0, 0, 0, False), ("good.csv", 4, 2, 1, 0, True), ("other.csv", 4, 1, 1, 1, True)]
    assert parsed.totals == {"rows": 3, "long_rows": 2}
    assert rows(parsed.rows().select("a", "b")) == rows(delimited.read_delimited(spark, [good, bad, other]).select("a", "b"))
    parsed.discard()


def test_a_large_feature_collection_is_cut_into_tasks(spark, tmp_path):
    features = ", ".join(f'{{"type": "Feature", "properties": {{"name": "Ponto {{{i}}}", "n": {i}}}, "geometry": {{"coordinates": [[{i}, 2], [3, {i}]]}}}}' for i in range(30_000))
    path = write(tmp_path / "big.json", f'{{"type": "FeatureCollection", "features": [{features}]}}')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 << 10))
    try:
        names = feature_names(spark, [path])
        per_task = names.groupBy(F.spark_partition_id()).count()
        assert names.distinct().count() == 30_000 and per_task.count() >= 8 and per_task.agg(F.max("count")).first()[0] < 8_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_features_with_the_mark_inside_are_read_whole(spark, tmp_path):
    nested = write(tmp_path / "n.json", '{"features": [{"properties": {"name": "A", "more": {"properties": {"name": "B"}}}}, {"properties": {"name": "C"}}]}')
    plain = write(tmp_path / "p.json", '{"features": [{"properties" : {"name": "D"}}, {"geometry": null, "properties": {}}]}')
    assert rows(feature_names(spark, [nested, plain]).select("name")) == [("",), ("A",), ("C",), ("D",)]


def test_geojson_and_population(spark, tmp_path):
    path = write(tmp_path / "g.json", '{"type": "FeatureCollection", "features": ['
                 '{"type": "Feature", "properties": {"name": "São Paulo ", "id": 1}, "geometry": {"type": "Point", "coordinates": [1, 2]}},'
                 '\n{"properties": {"id": 2}}]}')
    assert rows(feature_names(spark, [path])) == [("", ""), ("São Paulo ", "SAO PAULO")]
    areas = spark.createDataFrame([("São Paulo", 5), ("São Paulo", 2), ("Acre", 1), ("Brasil", 99)], "area string, n bigint")
    assert rows(reference.population_by_state(areas, "area", "n")) == [("AC", 1), ("SP", 7)]
    assert len(reference.STATES) == 27 and len(reference.CITY_SPELLINGS) == 18


LISTING = """<ul>
<li class="resource-item"><a class="heading" href="/h">t</a><a href="/f/leitos_2023.csv" class="resource-url-analytics">d</a></li>
<li class="resource-item x"><a class="resource-url-analytics" href="https://h.org/Leitos_2021.CSV?x=1">d</a>
  <a class="resource-url-analytics" href="second.csv">d</a></li>
<li class='resource-item'><a class='resource-url-analytics' href='pack-2022.zip'>d</a></li>
<li class="resource-item"><a class="resource-url-analytics" href="json_2020.zip">d</a></li>
<li class="resource-item"><a class="resource-url-analytics" href="doc.pdf">d</a></li>
<li class="resource-item"><a class="resource-url-analytics" href="/page/7">d</a></li>
<li class="other"><a class="resource-url-analytics" href="no.csv">d</a></li></ul>"""


def test_file_links(spark):
    pages = spark.createDataFrame([("http://s.org/data/set", LISTING)], "url string, html string")
    got = [(r["year"], r["link"]) for r in listing.file_links(pages).collect()]
    assert got == [(2021, "https://h.org/Leitos_2021.CSV?x=1"), (2022, "http://s.org/data/pack-2022.zip"),
                   (2023, "http://s.org/f/leitos_2023.csv")]


def test_second_hop(spark):
    pages = spark.createDataFrame([
        ("http://s.org/data/set", LISTING), ("http://s.org/page/7", '<body><a class="btn btn-primary" href="../x.csv">go</a>')],
        "url string, html string")
    found = listing.direct_or_second_hop(pages.where("url like '%set'"), pages).select("link")
    assert ("http://s.org/x.csv",) in rows(found)
    assert ("http://s.org/data/json_2020.zip",) in rows(found)
    assert not [r for r in rows(found) if r[0].endswith(".pdf")]


def test_addresses_and_class_words(spark):
    base = "http://s.org/a/b/page.html?q"
    for href, want in {"../x.csv": "http://s.org/a/x.csv", "./y.csv": "http://s.org/a/b/y.csv", "../../../z": "http://s.org/z", "/c/./d/../e?f=../g": "http://s.org/c/e?f=../g",
                       "x?a=1&amp;b=2": "http://s.org/a/b/x?a=1&b=2", "http://o.org/..": "http://o.org/", "..": "http://s.org/a/", "?n": "http://s.org/a/b/page.html?n"}.items():
        assert spark.range(1).select(listing.absolute_url(F.lit(base), F.lit(href))).first()[0] == want
    html = """<li class="resource-item-old"><a href="a">a</a></li><li class='x resource-item'><a class="big" href="b">b</a></li>"""
    pages = spark.createDataFrame([(base, html)], "url string, html string")
    assert [r["href"] for r in listing.page_links(pages, "resource-item").collect()] == ["b"]
    assert [r["href"] for r in listing.page_links(pages, css="big").collect()] == ["b"]


def test_line_breaks_in_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n;t;m\n1;"two\nlines";3\n4;five;6\n')
    got = delimited.read_delimited(spark, [str(tmp_path / "a.csv")])
    assert rows(got.select("n", "t", "m")) == [("1", "two\nlines", "3"), ("4", "five", "6")]


def test_late_lost_quotes_count(spark, tmp_path):
    lines = ['"a";"b";"c"'] + ['"1";"2";"3"'] * 30 + ['x;"y";"z"']
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = delimited.read_delimited(spark, [str(tmp_path / "a.csv")], by_frequency=True)
    assert ("x", "y", "z") in rows(got.select("a", "b", "c")) and got.count() == 31


def test_page_body(spark):
    html = ["<html><BODY class='x'>a\n<b>b</b></body ></html>", "none"]
    df = spark.createDataFrame([(h,) for h in html], "html string")
    assert [r[0] for r in df.select(listing.page_body(F.col("html"))).collect()] == ["a\n<b>b</b>", ""]


def test_jdbc_options():
    plain = jdbc.read_options("jdbc:x", "SELECT 1 LIMIT 5;\n", user="u")
    assert plain["query"] == "SELECT 1 LIMIT 5" and plain["user"] == "u" and plain["connectTimeout"] == "10"
    split = jdbc.read_options("jdbc:x", "SELECT * FROM t", jdbc.Split("id", "0", "100", 4))
    assert split["dbtable"] == "(SELECT * FROM t) q" and split["numPartitions"] == "4" and "query" not in split


def test_tables(spark, database):
    name = f"{database}.t"
    first = T.StructType().add("id", "long").add("a", "string")
    assert tables.ensure_table(spark, name, first) == ["id", "a"]
    tables.append(spark, name, spark.createDataFrame([("x", 1)], "a string, id int"))
    assert tables.ensure_table(spark, name, T.StructType(first.fields).add("b", "integer")) == ["b"]
    tables.append(spark, name, spark.createDataFrame([(2, 5)], "id int, b int"))
    assert rows(tables.read_columns(spark, name, ["id", "a", "b"])) == [(1, "x", None), (2, None, 5)]
    assert rows(tables.describe_table(spark, name)) == [("a", "string"), ("b", "int"), ("id", "bigint")]
    tables.replace_table(spark, name, spark.createDataFrame([(7,)], "z int"))
    assert rows(spark.table(name)) == [(7,)]
    tables.drop_tables(spark, [name, f"{database}.absent"])
    assert not spark.catalog.tableExists(name)


def test_replacing_one_file(spark, database):
    name = f"{database}.f"
    schema = T.StructType().add("n", "integer").add("source_file", "string")
    tables.ensure_table(spark, name, schema, "source_file")
    tables.replace_files(spark, name, spark.createDataFrame([(1, "file:/a=1.csv"), (2, "b")], schema))
    tables.replace_files(spark, name, spark.createDataFrame([(3, "b"), (4, "b")], schema))
    assert rows(spark.table(name)) == [(1, "file:/a=1.csv"), (3, "b"), (4, "b")]


def test_ledger(spark, database):
    ledger = tables.Ledger(spark, f"{database}.done")
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    ledger.enter(files.where("path = 'a'"), "x")
    assert rows(ledger.pending(files, "x")) == [("b",)]
    assert rows(ledger.pending(files, "y")) == [("a",), ("b",)]
    assert rows(tables.Ledger(spark, f"{database}.done").pending(files, "x")) == [("b",)]


def test_export(spark, tmp_path):
    out = str(tmp_path / "out")
    tables.export_csv(spark.createDataFrame([(1, "a;b"), (2, None)], "n int, t string"), out)
    assert rows(spark.read.option("header", True).csv(out)) == [("1", "a;b"), ("2", None)]


def test_archives_reach_python_in_pieces(spark, tmp_path, monkeypatch):
    from farol.sources import archives

    paths = []
    for name, n in (("a", 40), ("b", 1), ("c", 900)):
        paths.append(str(tmp_path / f"{name}.zip"))
        with zipfile.ZipFile(paths[-1], "w") as z:
            z.writestr("d.csv", "".join(f"{name}{i}\n" for i in range(n)))
    monkeypatch.setattr(archives, "PIECE", 100)
    lines = archive_lines(spark, paths)
    got = [(r["line"], r["pos"]) for r in lines.collect()]
    assert sorted(got) == sorted((f"{name}{i}", i) for name, n in (("a", 40), ("b", 1), ("c", 900)) for i in range(n))
    assert "UDTF" not in lines._jdf.queryExecution().executedPlan().toString()
    # a store that pyarrow does not know is read in pieces whatever the size
    monkeypatch.setattr(archives, "_opens", lambda path: False)
    assert archive_lines(spark, paths, largest=1).count() == 941
