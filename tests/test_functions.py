from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farol.functions import dates, numeric, text
from farol.functions.scores import bleu, cosine
from farol.session import as_of_date


def values(spark, expression, items, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, c {kind}")
    return [r[0] for r in df.select(expression(F.col("c")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_clean_text(spark):
    got = values(spark, text.clean_text, [" são paulo\t", "nan", " None ", "", "n/a", None, " x"])
    assert got == ["SÃO PAULO", None, None, None, None, None, "X"]


def test_digits_and_padding(spark):
    assert values(spark, text.digits_only, ["12.345/0001-9", "76954000.0", None, "abc", "12.00", "7.6954E7"]) == [
        "1234500019", "76954000", "", "", "12", "76954000"]
    assert values(spark, lambda c: text.padded_code(c, 8), ["1310000.0", "76954-000", ""]) == ["01310000", "76954000", ""]


def test_cut_keeps_null(spark):
    assert values(spark, lambda c: text.cut(c, 3), ["abcdef", "ab", None]) == ["abc", "ab", None]


def test_accents(spark):
    names = ["São João d'Aliança", "Açaí", "Groß", "nº 1ª", "Łódź", "é", "ÆØ", None]
    assert values(spark, text.fold_accents, names) == ["Sao Joao d'Alianca", "Acai", "Gross", "no 1a", "Lodz", "e", "AEO", None]
    assert values(spark, text.accent_key, [" belém "]) == ["BELEM"]


def test_invalid_city(spark):
    cities = ["", " NaN", "123", "--", "(1) 2", "Belém", "Ilha 3", None, "s/n", "ão"]
    assert values(spark, text.invalid_city, cities) == [True, True, True, True, True, False, False, True, True, False]


def test_substitute_and_map(spark):
    assert values(spark, lambda c: text.substitute(c, {"PARATI": "PARATY"}), ["PARATI", "RIO", None]) == ["PARATY", "RIO", None]
    assert values(spark, lambda c: text.map_lookup(c, {"SP": "Sudeste"}), ["SP", "XX", None]) == ["Sudeste", None, None]


def test_column_name():
    assert text.column_name("Código BR") == "codigo_br"
    assert text.column_name(" UTI_TOTAL - EXIST ") == "uti_total_exist"
    assert text.column_name("Município/Instituição (nº)") == "municipio_instituicao_no"


def test_squeeze_space(spark):
    assert values(spark, text.squeeze_space, ["\nSELECT a\n  FROM t ;\n", "x"]) == ["SELECT a FROM t", "x"]


def test_integers(spark):
    raw = ["12", " 3.7 ", "-3.7", "abc", None, "1e2", "12d", "99999999999", "0x1p3", "NaN", "inf", "5.", "", "1/2"]
    assert values(spark, numeric.int_or_zero, raw) == [12, 3, -3, 0, 0, 100, 0, 0, 0, 0, 0, 5, 0, 0]
    assert values(spark, numeric.comma_int, ["3,7", "5", "x", None]) == [3, 5, None, None]
    assert values(spark, numeric.loses_fraction, ["3,7", "5,0", "x", None]) == [True, False, False, False]


def test_brazilian_decimal(spark):
    raw = ["1.234,56", "12.50", "-3,5", "R$ 10", "1.234", "1.234.567,8", "", "abc", None, "-1.234"]
    want = ["1234.5600", "12.5000", "-3.5000", "10.0000", "1234.0000", "1234567.8000", None, None, None, "-1234.0000"]
    assert values(spark, numeric.br_decimal, raw) == [None if w is None else Decimal(w) for w in want]
    pointed = values(spark, lambda c: numeric.br_decimal(c, point_style=True), ["1.234", "5"])
    assert pointed == [Decimal("1.2340"), Decimal("5.0000")]


def test_point_style_hint(spark):
    df = spark.createDataFrame([("1.5", "1.234,5", "1.234"), ("2", "7", None)], "a string, b string, c string")
    row = df.agg(*[numeric.point_style_hint(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row) == (True, False, False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(min_value=-10**9, max_value=10**9, places=4), min_size=1, max_size=30))
def test_brazilian_round_trip(spark, numbers):
    spelled = [f"{n:,.4f}".translate(str.maketrans(",.", ".,")) for n in numbers]
    assert values(spark, numeric.br_decimal, spelled) == numbers


def test_ratios_are_null_on_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    got = df.select(numeric.ratio(a, b), numeric.percent_of(a, b), numeric.percent_gap(b, a), numeric.per_thousand(a, b)).collect()
    assert [tuple(r) for r in got] == [(None, None, None, None), (0.25, 25.0, 75.0, 250.0)]


def test_filled_total(spark):
    df = spark.createDataFrame(
        [(None, "2", "3"), ("0", "2", "3"), ("5", "2", "3"), (None, None, "3")], "t string, q string, p string")
    cells = [F.col(c).cast("decimal(20,4)") for c in "tqp"]
    assert [r[0] for r in df.select(numeric.filled_total(*cells)).collect()] == [6, 6, 5, 0]


def test_dates(spark):
    day = dt.date(2023, 2, 1)
    assert values(spark, dates.date_of, ["2023-02-01", "2023/02/01", "01/02/2023", "x", None]) == [day, day, day, None, None]
    assert values(spark, dates.date_of, ["2023-01-31 22:00:00-03", "2023-02-01T00:00:00", "2023-02-01T01:00:00+01", "2023-02-01 00:00:00.000Z"]) == [day] * 4
    assert values(spark, dates.month_of, ["202302", "202313", "2023"]) == [day, None, None]
    assert values(spark, dates.first_year, ["bps_2023.csv", "x", "a/19990/2001"]) == [2023, 0, 1999]
    got = values(spark, lambda c: F.date_format(dates.utc_timestamp(c), "yyyy-MM-dd HH:mm"),
                 ["2025-06-30 21:00:00-03", "2025-06-30 21:00:00 -03", "2025/06/30", "x"])
    assert got == ["2025-07-01 00:00", "2025-07-01 00:00", "2025-06-30 00:00", None]


def test_as_of(spark):
    one = spark.range(1)
    assert one.select(as_of_date("2024-05-01")).first()[0] == dt.date(2024, 5, 1)
    assert one.select(as_of_date() == F.current_date()).first()[0]


def test_bleu_by_hand(spark):
    def sentence_bleu(reference, candidate):
        df = spark.createDataFrame([(1, reference, candidate)], "id int, o string, p string")
        return bleu(df, ["id"], "o", "p").first()["score"]

    same = "a b c d e"
    assert sentence_bleu(same, same) == pytest.approx(1.0)
    assert sentence_bleu(same, "x y z") == 0.0
    assert sentence_bleu(same, "") == 0.0
    assert sentence_bleu(same, None) is None and sentence_bleu(None, same) is None
    # 3 of 4 words, 2 of 3 pairs, 1 of 2 triples, no quadruple of 1; equal lengths
    smooth = 1 / (2 * 5 / math.log(4))
    want = math.exp(0.25 * (math.log(3 / 4) + math.log(2 / 3) + math.log(1 / 2) + math.log(smooth)))
    assert sentence_bleu("a b c d", "a b c x") == pytest.approx(want)
    # clipping: the reference has one 'a'; brevity: 2 words against 4
    got = sentence_bleu("a b c d", "a a")
    parts = [1 / 2, 1 / (2 * 5 / math.log(2)), 1 / (4 * 5 / math.log(2)), 1 / (8 * 5 / math.log(2))]
    assert got == pytest.approx(math.exp(1 - 4 / 2) * math.exp(sum(0.25 * math.log(p) for p in parts)))


def test_scores_on_rows(spark):
    df = spark.createDataFrame([("a b c d", "a b c d", [1.0, 0.0], [1.0, 1.0]), ("a", "b", [0.0, 0.0], [1.0, 0.0])],
                               "o string, p string, x array<float>, y array<float>")
    got = df.select(cosine(F.col("x"), F.col("y"))).collect()
    assert got[0][0] == pytest.approx(1 / math.sqrt(2)) and got[1][0] is None
    scores = {r["o"]: r["score"] for r in bleu(df, ["o"], "o", "p").collect()}
    assert scores["a b c d"] == pytest.approx(1.0) and scores["a"] == 0.0


def test_dates_are_parsed_only_where_their_separators_stand(spark):
    cells = ["2023-02-01", "2023/02/01", "01/02/2023", "+12023-02-01", "2023-02-01 03:04:05", "2023/02/01 03:04:05", "2023-02-01t03:04:05",
             "2023-2-1", "2023-02/01", "2023-02-30", "1/2/2023", "12:34:56", " 2023-02-01", "202302", "", "-", None]
    plain = [F.try_to_date("c", f) for f in [*dates.DATE_FORMATS, dates.ISO_FORMAT]]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for got, want in df.select(dates.date_of(F.col("c")).cast("string"), F.coalesce(*plain).cast("string")).collect():
        assert got == want
    # a failed parse raises inside, so each is guarded
    assert str(dates.date_of(F.col("c"))).count("CASE WHEN") >= len(plain)


def test_methods_that_hotspot_does_not_compile_are_not_used(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_whole_numbers_are_not_parsed_for_a_fraction(spark):
    cells = ["3", " 3 ", "3,7", "3.0", "-2", "+2,5", "1e1", "15e-1", "1E-1", "x", "", "1d", "NaN", "9" * 18, "9" * 19, "9" * 40, "0x1", "1,2,3", None]
    number = numeric.comma_number(F.col("c"))
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    for got, want in df.select(numeric.loses_fraction(F.col("c")), F.coalesce(number != F.floor(number), F.lit(False))).collect():
        assert got is want
    assert "CASE WHEN" in str(numeric.loses_fraction(F.col("c")))
