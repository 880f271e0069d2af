from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from farol.operators import elections, joins, keys, pairs, profile, quantiles, ranking, shaping
from farol.plans import beds
from farol.session import discard, staged


def test_lookup_matches_null_keys(spark):
    fact = spark.createDataFrame([("a",), (None,), ("z",)], "k string")
    dim = spark.createDataFrame([("a", 1), (None, 2)], "key string, id int")
    assert rows(joins.lookup(fact, dim, {"k": "key"}, ["id"])) == [("a", 1), ("z", None), (None, 2)]


def test_salted_lookup_equals_plain(spark):
    rng = random.Random(7)
    # one key holds most rows, copies included; some keys are unknown
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", i) for i in range(2000)] + [(None, -1)] * 300
    fact = spark.createDataFrame(data, "k string, n int")
    dim = spark.createDataFrame([("hot", 1), (None, 2)] + [(f"k{i}", 10 + i) for i in range(30)], "key string, id int")
    salted = joins.salted_lookup(fact, dim, {"k": "key"}, ["id"], ["n"], salt=5, share=0.05)
    assert rows(salted) == rows(joins.lookup(fact, dim, {"k": "key"}, ["id"]))
    assert len(joins.hot_hashes(fact, {"k": ["k"], "n": ["n"]}, 0.05)["k"]) == 2


def test_salted_lookup_without_hot_keys(spark):
    fact = spark.range(100).withColumnRenamed("id", "k")
    dim = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    assert rows(joins.salted_lookup(fact, dim, {"k": "key"}, ["v"], ["k"], share=0.5)) == rows(
        joins.lookup(fact, dim, {"k": "key"}, ["v"]))


def test_new_rows_and_members(spark):
    incoming = spark.createDataFrame([("a", ""), ("b", ""), (None, "x")], "k string, l string")
    known = spark.createDataFrame([("a", ""), (None, "x")], "k string, l string")
    assert rows(joins.new_rows(incoming, known, ["k", "l"])) == [("b", "")]
    reference = spark.createDataFrame([("a", ""), ("a", "")], "x string, y string")
    assert rows(joins.members(incoming, reference, {"k": "x", "l": "y"})) == [("a", "")]


def test_complete_domain_and_latest(spark):
    domain = spark.createDataFrame([("AC",), ("SP",)], "uf string")
    data = spark.createDataFrame([("SP", 2.5)], "uf string, v double")
    assert rows(joins.complete_domain(domain, data, "uf")) == [("AC", 0.0), ("SP", 2.5)]
    dated = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "b")], "d int, k string")
    assert rows(joins.where_latest(dated, "d")) == [(3, "b")]
    assert rows(joins.where_latest(dated, "d", F.col("k") == "a")) == [(2, "a"), (2, "b")]


def test_reference_tables_have_any_size(spark):
    beds_now = spark.createDataFrame([(f"U{i:03}", i) for i in range(150)], "uf_hospital string, leitos_geral long")
    people = spark.createDataFrame([(f"U{i:03}", "r", 1000) for i in range(150)], "uf string, regiao string, populacao long")
    wide = beds_now.withColumns({m: F.col("leitos_geral") for m in beds.MAIN_METRICS})
    assert beds.per_capita(wide, people).count() == 150


def test_describe_keeps_small_and_large_means(spark):
    small = profile.describe(spark.createDataFrame([(1e-8,), (3e-8,)], "v double"), ["v"]).first()
    large = profile.describe(spark.createDataFrame([(1e20,), (1.0,)], "v double"), ["v"]).first()
    assert abs(small["mean"] - 2e-8) < 1e-15 and large["mean"] == 5e19 and large["count"] == 2


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), ("a", 2, "w")], "k string, d int, v string")
    assert rows(ranking.latest_rows(df, "k", "d", ["v"])) == [("a", 2, "w"), ("b", 1, "z")]
    assert rows(ranking.first_rows(df, ["k"], ["v"], 2)) == [("a", 1, "x"), ("a", 2, "w"), ("b", 1, "z")]
    assert rows(ranking.duplicate_total(df, ["k", "d"])) == [(2,)]
    assert rows(ranking.value_counts(df, "k")) == [("a", 3), ("b", 1)]


def test_mode_takes_smallest_tie(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b"), ("g", "a"), ("g", None), ("h", None)], "g string, v string")
    assert rows(ranking.group_mode(df, ["g"], "v")) == [("g", "a", 2)]


def test_sample_repeats(spark):
    df = spark.range(1000)
    one = rows(ranking.stable_sample(df, ["id"], 10))
    assert one == rows(ranking.stable_sample(df.repartition(7), ["id"], 10)) and len(one) == 10
    assert one != rows(ranking.stable_sample(df, ["id"], 10, seed=1))
    assert ranking.stable_sample(spark.range(3), ["id"], 10).count() == 3


def test_max_then_sum_counts_copies_once(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 1, 4), ("b", 1, 2)], "u string, m int, q int")
    assert rows(ranking.max_then_sum(df, ["u"], "m", ["q"])) == [(1, 7)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-50, 50), st.floats(-1e6, 1e6))),
                min_size=1, max_size=120),
       st.sampled_from([(1, 2), (3, 4), (1, 4096), (20_000, 4096)]))
def test_exact_quantiles_equal_numpy(spark, data, split):
    range_rows, quantiles.MOST_RANGES = split
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["k"]: [r[p] for p in points] for r in quantiles.exact_quantiles(df, ["k"], "v", points, range_rows=range_rows).collect()}
    frame = pd.DataFrame(data, columns=["k", "v"]).dropna()
    want = {k: np.quantile(g["v"].astype(float), list(points.values())) for k, g in frame.groupby("k")}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(list(want[k]), rel=1e-9, abs=1e-9)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), (None, 2.0, 2), (None, 4.0, 2)], "k string, v double, n int")
    got = quantiles.exact_quantiles(df, ["k"], "v", {"low": 0.5, "high": 0.9}, "n")
    want = {"a": np.quantile([1, 1, 1, 5], [0.5, 0.9]), None: np.quantile([2, 2, 4, 4], [0.5, 0.9])}
    assert {r["k"]: (r["low"], r["high"]) for r in got.collect()} == {k: pytest.approx(tuple(v)) for k, v in want.items()}


def test_no_range_holds_more_than_a_hundredth_of_ten_million_values(spark):
    n = 10_000_000
    values = spark.range(n).select((F.pow(F.col("id"), 2) * F.when(F.col("id") % 3 == 0, -1).otherwise(1)).alias("v"))
    folder, counts = staged(values.select(F.col("v").alias("__v"), F.lit(1).cast("bigint").alias("__c")), "many")
    quantiles.MOST_RANGES = 4096
    ranges = min(quantiles.MOST_RANGES, 1 << (n // quantiles.RANGE_ROWS).bit_length())
    largest = quantiles._ranged(counts, ranges).groupBy("__b").count().agg(F.max("count")).first()[0]
    assert largest <= n // 100
    median = quantiles.exact_quantiles(values, [], "v", {"m": 0.5}).first()["m"]
    numbers = np.arange(n, dtype=np.float64) ** 2
    numbers[::3] *= -1
    assert median == np.median(numbers)
    discard(spark, folder)


def test_wanted_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_RANGES", 8)
    values = spark.range(4000).select(F.expr("pmod(id * 7919, 4001) * 1.0").alias("v"))
    got = quantiles.exact_quantiles(values, [], "v", {"a": 0.1, "b": 0.9}, range_rows=10).first()
    want = values.agg(F.expr("percentile(v, array(0.1, 0.9))")).first()[0]
    assert [got["a"], got["b"]] == pytest.approx(want)


def test_global_median_with_a_heavy_value(spark):
    data = [(7.0,)] * 700 + [(float(i),) for i in range(300)]
    got = quantiles.exact_median(spark.createDataFrame(data, "v double"), [], "v").first()["median"]
    assert got == np.median([v for v, in data])


def test_table_profile_is_that_of_pandas(spark):
    data = [(i % 7 if i % 5 else None, float(i * i % 11), "abc"[i % 3] if i % 4 else None, None) for i in range(60)]
    df = spark.createDataFrame(data, "i int, d double, s string, z string")
    frame = pd.DataFrame(data, columns=["i", "d", "s", "z"])
    got = {r["column"]: r for r in profile.table_profile(df, 2).collect()}
    assert set(got) == set("idsz")
    for c in "idsz":
        assert got[c]["records"] == 60 and got[c]["missing"] == frame[c].isna().sum() and got[c]["distinct_values"] == frame[c].nunique()
        shares = sorted(((-n, v) for v, n in Counter(frame[c].dropna()).items()), key=lambda x: (x[0], str(x[1])))[:2]
        assert [t["share"] for t in got[c]["top"] or []] == pytest.approx([-n / frame[c].count() for n, _ in shares])
        assert [float(t["value"]) if c in "id" else t["value"] for t in got[c]["top"] or []] == [v for _, v in shares]
    for c in "id":
        want = frame[c].describe()
        assert [got[c][k] for k in ("mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(list(want[1:]))
    assert got["s"]["mean"] is None and got["s"]["q50"] is None
    empty = {r["column"]: r for r in profile.table_profile(df.limit(0)).collect()}
    assert empty["d"]["records"] == 0 and empty["d"]["q50"] is None


def test_correlations_with_missing_cells_and_without_spread(spark):
    rnd = np.random.default_rng(3)
    frame = pd.DataFrame(rnd.normal(size=(80, 4)) + 1e6, columns=list("abcd"))
    frame["e"] = 5.0
    frame.loc[::3, "b"] = np.nan
    frame.loc[::7, "c"] = np.nan
    df = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in frame.itertuples(index=False)], "a double, b double, c double, d double, e double")
    got = {(r[0], r[1]): r[2] for r in profile.correlations(df, list("abcde")).collect()}
    want = frame.corr()
    for a in "abcd":
        for b in "abcd":
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-7)
        assert got[a, "e"] is None
    assert got["e", "e"] is None and len(got) == 25
    none = {(r[0], r[1]): r[2] for r in profile.correlations(df.limit(0), ["a", "b"]).collect()}
    assert set(none.values()) == {None}


def test_election_takes_the_spelling_of_most_cells(spark):
    rows_ = [("f1", "2024-01-05", "202401")] * 6 + [("f1", "202402", "x")] * 3 + [("f2", "202403", None)] * 4 + [("f2", "2024-01-01", None)] + [("f3", "?", "?")]
    df = spark.createDataFrame(rows_, "f string, d string, m string")
    elected = elections.elect(df, ["d", "m"], elections.DATE_SPELLINGS, "f")
    got = {(r["f"], r["column"]): (r["spelling"], r["null_share"]) for r in elected.collect()}
    assert got == {("f1", "d"): ("dates", pytest.approx(1 / 3)), ("f1", "m"): ("months", pytest.approx(1 / 3)), ("f2", "d"): ("months", pytest.approx(0.2)),
                   ("f2", "m"): ("dates", None), ("f3", "d"): ("dates", 1.0), ("f3", "m"): ("dates", 1.0)}
    read = elections.read_elected(df, elected, ["d", "m"], elections.DATE_SPELLINGS, "f")
    assert read.columns == ["f", "d", "m"] and read.where("d is not null").count() == 10 and read.where("f = 'f2' and d = date'2024-03-01'").count() == 4
    assert elections.elect(df.limit(0), ["d"], elections.DATE_SPELLINGS, "f").count() == 0


def test_profile(spark):
    df = spark.createDataFrame(
        [("a", 1, None), ("a", 2, 2.0), (None, 3, 6.0), ("b", 4, 8.0)], "s string, i int, d double")
    frame = df.toPandas()
    assert rows(profile.missing_values(df, only_missing=True)) == [("d", 1, 25.0), ("s", 1, 25.0)]
    assert rows(profile.table_info(df)) == [("d", 3, "double"), ("i", 4, "int"), ("s", 3, "string")]
    assert rows(profile.value_shares(df, ["s"], 1)) == [("s", "a", 2, 2 / 3)]
    assert rows(profile.distinct_counts(df)) == [("d", 3), ("i", 4), ("s", 2)]
    stats = {r["column"]: r for r in profile.describe(df, ["i", "d"]).collect()}
    for c in ("i", "d"):
        want = frame[c].astype(float).describe()
        got = [stats[c][k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
        assert got == pytest.approx(list(want))
    corr = {(r[0], r[1]): r[2] for r in profile.correlations(df, ["i", "d"]).collect()}
    assert corr["i", "d"] == corr["d", "i"] == pytest.approx(frame[["i", "d"]].astype(float).corr().iloc[0, 1])
    assert corr["i", "i"] == 1.0
    center = profile.center_statistics(df, ["i"]).first()
    assert tuple(center) == ("i", 2.5, 1.0, 4.0, 1.5)
    assert profile.text_columns(df) == ["s"] and profile.number_columns(df) == ["i", "d"]


def test_ids_are_dense_and_repeatable(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(500)], "a string, b int")
    one = {r["a"]: r["id"] for r in keys.assign_ids(df, "id", ["a", "b"], after=10, buckets=7).collect()}
    two = {r["a"]: r["id"] for r in keys.assign_ids(df.repartition(9), "id", ["a", "b"], after=10, buckets=7).collect()}
    assert one == two and sorted(one.values()) == list(range(11, 511))


def test_number_rows(spark, tmp_path):
    folder = str(tmp_path / "rows")
    spark.range(1000).repartition(5).write.parquet(folder)
    got = keys.number_rows(spark, folder, "n", after=100)
    assert sorted(r["n"] for r in got.select("n").collect()) == list(range(101, 1101))
    assert got.columns == ["id", "n"]


def test_rules(spark):
    df = spark.createDataFrame([("5", "1,5", "-3,25", "202301", "x")], "a string, b string, c string, d string, e string")
    rule = shaping.Rule
    wanted = [rule("a", "n", "int"), rule("b", "q", "decimal"), rule("c", "lat", "latlong"), rule("d", "m", "date"), rule("missing", "t"),
              rule("missing_number", "k", "int"), rule("", "anvisa", literal="N/A"), rule("", "blank", literal="")]
    row = shaping.project(df, wanted, ["e"]).first().asDict()
    assert {k: str(v) for k, v in row.items()} == {
        "e": "x", "n": "5", "q": "1.5000", "lat": "-3.250000000", "m": "2023-01-01", "t": "", "k": "0", "anvisa": "N/A", "blank": ""}


def test_alias_first_column_wins():
    accepted = {"uti_total": ["uti_total_existente", "uti_total___exist"], "uf": ["uf"]}
    chosen = shaping.resolve_aliases(["UTI_TOTAL - EXIST", "uti_total_existente", "UF", "other"], accepted)
    assert chosen == {"uti_total": "UTI_TOTAL - EXIST", "uf": "UF"}


def test_swap_repair_takes_what_most_values_are(spark):
    good = [("f1", i, str(i), f"NAME {i}") for i in range(150)]
    bad = [("f2", i, f"NAME {i}", str(i)) for i in range(5)] + [("f2", 9, None, None)]
    # a late letter does not make a file swapped
    good[140] = ("f1", 140, "X", "NAME 140")
    df = spark.createDataFrame(good + bad, "f string, n int, ident string, name string")
    got = rows(shaping.repair_swaps(df, [("ident", "name"), ("absent", "too")], "f"))
    assert got == sorted(good + [("f2", i, str(i), f"NAME {i}") for i in range(5)] + [("f2", 9, None, None)], key=repr)


def test_month_shapes(spark):
    df = spark.createDataFrame([("2023-01", "M", 1, 2), ("2023-01", "M", 3, 4), ("2023-02", "E", 5, None), (None, "E", 1, 1)],
                               "m string, c string, a int, b int")
    assert rows(shaping.month_totals(df, "m", "c", ["a", "b"])) == [
        ("2023-01", "M", "a", 4), ("2023-01", "M", "b", 6), ("2023-02", "E", "a", 5), ("2023-02", "E", "b", None)]
    assert rows(shaping.month_matrix(df, "m", "c", "a", ["E", "M"])) == [("2023-01", None, 4), ("2023-02", 5, None)]


def test_pair_statistics(spark):
    data = [("q1", 0.1, 0.5), ("q1", 0.3, 0.6), ("q1", 0.9, 0.7), ("q2", 0.2, 0.2)]
    scored = spark.createDataFrame(data, "o string, bleu double, cos double")
    got = {r["o"]: r for r in pairs.stats_by_original(scored, "o", ["bleu", "cos"]).collect()}
    assert got["q1"]["pairs"] == 3 and got["q1"]["bleu_median"] == pytest.approx(0.3)
    assert got["q1"]["cos_mean"] == pytest.approx(0.6)
    overall = pairs.overall_stats(scored, "o", "bleu").first()
    numbers = [d[1] for d in data]
    assert (overall["originals"], overall["pairs"]) == (2, 4)
    assert overall["median"] == pytest.approx(np.median(numbers)) and overall["std"] == pytest.approx(np.std(numbers))


def test_catalogue(spark):
    records = spark.createDataFrame([
        ("o1", "p1", "SELECT 1\n FROM t;", "simple", "filter", ["leitos"], ("SELECT 1 FROM t",)),
        ("o1", "p2", "SELECT 2", "simple", "join", ["leitos", "bps"], ("SELECT 1",))], pairs.RECORD_SCHEMA)
    counts = Counter({(r["kind"], r["value"]): r["records"] for r in pairs.catalogue_counts(records).collect()})
    assert counts == {("complexity", "simple"): 2, ("query_type", "filter"): 1, ("query_type", "join"): 1,
                      ("table", "leitos"): 2, ("table", "bps"): 1}
    assert rows(pairs.paraphrase_counts(records)) == [("o1", 2, 1)]
