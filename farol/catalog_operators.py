"""Joins, rankings, profiles, keys and pair statistics over the order and text tables."""

from __future__ import annotations

from itertools import combinations


from pyspark.sql import functions as F

from farol.catalog import query, table
from farol.functions.scores import bleu, cosine
from farol.operators import joins, keys, pairs, profile, quantiles, ranking
from farol.operators.shaping import clean_names, resolve_aliases

_LATEST = ("SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice FROM "
           "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn "
           "FROM orders) WHERE rn = 1")


@query("latest_per_key", _LATEST)
def latest_per_key(spark, folder):
    rows = ranking.latest_rows(table(spark, folder, "orders"), "o_custkey", "o_orderdate", [F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
         "l_shipdate"]


@query("keep_first_dedup", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {", ".join(_REST)}) AS rn FROM lineitem) WHERE rn = 1""")
def keep_first_dedup(spark, folder):
    rows = ranking.keep_first(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], _REST)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("duplicate_rows", """SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows FROM (
SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)""")
def duplicate_rows(spark, folder):
    return ranking.duplicate_total(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dedup_then_total", """SELECT strftime(m, '%Y-%m-%d') AS month, SUM(q) AS quantity FROM (
SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, MAX(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def dedup_then_total(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.col("l_quantity").alias("quantity"))
    return ranking.max_then_sum(rows, ["l_suppkey"], "month", ["quantity"])


@query("value_counts", "SELECT o_orderpriority, COUNT(*) AS records FROM orders GROUP BY 1")
def value_counts(spark, folder):
    return ranking.value_counts(table(spark, folder, "orders"), "o_orderpriority").orderBy(F.desc("records"))


@query("value_counts_with_null", "SELECT NULLIF(o_orderpriority, '5-LOW') AS priority, COUNT(*) AS records FROM orders GROUP BY 1")
def value_counts_with_null(spark, folder):
    rows = table(spark, folder, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return ranking.value_counts(rows, "priority", dropna=False)


@query("top_values", "SELECT p_name, COUNT(*) AS records FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark, folder):
    return ranking.top_values(table(spark, folder, "part"), "p_name", 10)


def _profile_rows(spark, folder):
    """Orders with nulls, of which the tables have none."""
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))


_PROFILE = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, NULLIF(o_orderstatus, 'F') AS o_orderstatus,
NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS o_totalprice
FROM orders)
"""
_PROFILE_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _per_column(template: str, columns: list[str], tail: str = "") -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in columns) + tail


_MISSING = _PROFILE + "SELECT * FROM (" + _per_column(
    "SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS missing, (COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*) AS percent FROM o",
    _PROFILE_COLUMNS) + ")"


@query("missing_profile", _MISSING)
def missing_profile(spark, folder):
    return profile.missing_values(_profile_rows(spark, folder)).orderBy(F.desc("missing"))


@query("missing_only", _MISSING + " WHERE missing > 0")
def missing_only(spark, folder):
    return profile.missing_values(_profile_rows(spark, folder), only_missing=True)


@query("table_info", _PROFILE + "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT({c}) AS non_null, '{t}' AS type FROM o"
    for c, t in zip(_PROFILE_COLUMNS, ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"])) + ")")
def table_info(spark, folder):
    return profile.table_info(_profile_rows(spark, folder))


@query("value_shares", _PROFILE + "SELECT * FROM (" + _per_column(
    "(SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS records, "
    "CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT({c}) FROM o) AS share FROM o WHERE {c} IS NOT NULL "
    "GROUP BY 2 ORDER BY records DESC, value LIMIT 2)", ["o_orderstatus", "o_orderpriority"]) + ")")
def value_shares(spark, folder):
    rows = _profile_rows(spark, folder)
    return profile.value_shares(rows, profile.text_columns(rows), 2)


_LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("nunique_all", "SELECT * FROM (" + _per_column(
    "SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS distinct_values FROM lineitem", _LINE_COLUMNS) + ")")
def nunique_all(spark, folder):
    return profile.distinct_counts(table(spark, folder, "lineitem"))


_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_exact", "SELECT * FROM (" + _per_column(
    "SELECT '{c}' AS \"column\", COUNT({c}) AS count, round(avg({c}), 6) AS mean, "
    "round(stddev_samp({c}), 6) AS std, MIN({c}) AS min, MAX({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, "
    "round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem", _NUMBERS) + ")")
def describe_exact(spark, folder):
    out = profile.describe(table(spark, folder, "lineitem"), _NUMBERS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query("corr_matrix", "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
    for x, y in combinations(_NUMBERS, 2) for a, b in ((x, y), (y, x)))
    + "\nUNION ALL " + "\nUNION ALL ".join(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in _NUMBERS) + ")")
def corr_matrix(spark, folder):
    out = profile.correlations(table(spark, folder, "lineitem"), _NUMBERS)
    # + 0.0 turns a rounded -0.0 into 0.0
    return out.withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


@query("grouped_quantiles", """SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS p10,
round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.99), 6) AS p99 FROM orders GROUP BY 1""")
def grouped_quantiles(spark, folder):
    points = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    out = quantiles.exact_quantiles(table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice", points)
    return out.withColumns({p: F.round(p, 6) for p in points})


@query("sample_stable", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
ORDER BY md5('42-' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10""")
def sample_stable(spark, folder):
    """A sampling operator: the ten rows are its result."""
    return ranking.stable_sample(table(spark, folder, "orders"), ["o_orderkey"], 10)


@query("dim_sync_new_keys", """SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')""")
def dim_sync_new_keys(spark, folder):
    orders = table(spark, folder, "orders")
    start = F.lit("1998-01-01").cast("date")
    known = orders.where(F.col("o_orderdate") < start).select("o_custkey").distinct()
    incoming = orders.where(F.col("o_orderdate") >= start).select("o_custkey").distinct()
    return joins.new_rows(incoming, known, ["o_custkey"])


@query("surrogate_ids", """SELECT MIN(i) AS lowest, MAX(i) AS highest, COUNT(DISTINCT i) AS ids, COUNT(DISTINCT o_custkey) AS keys
FROM (SELECT o_custkey, 1000 + row_number() OVER (ORDER BY o_custkey) AS i FROM (SELECT DISTINCT o_custkey FROM orders))""")
def surrogate_ids(spark, folder):
    customers = table(spark, folder, "orders").select("o_custkey").distinct()
    numbered = keys.assign_ids(customers, "i", ["o_custkey"], after=1000)
    return numbered.agg(F.min("i").alias("lowest"), F.max("i").alias("highest"), F.count_distinct("i").alias("ids"),
                        F.count("o_custkey").alias("keys"))


_LOOKUP = """SELECT s_nationkey, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS quantity FROM lineitem
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey GROUP BY 1"""


def _nation_totals(df):
    return df.groupBy("s_nationkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("fact_lookup", _LOOKUP)
def fact_lookup(spark, folder):
    known = table(spark, folder, "supplier").where(F.col("s_acctbal") >= 0)
    return _nation_totals(joins.lookup(
        table(spark, folder, "lineitem"), known, {"l_suppkey": "s_suppkey"}, ["s_nationkey"]))


@query("fact_lookup_salted", _LOOKUP)
def fact_lookup_salted(spark, folder):
    """Every supplier above one percent of the lines counts as hot here."""
    known = table(spark, folder, "supplier").where(F.col("s_acctbal") >= 0)
    return _nation_totals(joins.salted_lookup(
        table(spark, folder, "lineitem"), known, {"l_suppkey": "s_suppkey"}, ["s_nationkey"],
        ["l_orderkey", "l_linenumber", "l_partkey"], salt=4, share=0.01))


@query("null_safe_lookup", """SELECT o_orderkey, k.n AS same_priority FROM (
SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders) o
LEFT JOIN (SELECT NULLIF(o_orderpriority, '5-LOW') AS p, COUNT(*) AS n FROM orders GROUP BY 1) k ON o.p IS NOT DISTINCT FROM k.p""")
def null_safe_lookup(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    counts = rows.groupBy("p").agg(F.count("*").alias("same_priority"))
    return joins.lookup(rows, counts, {"p": "p"}, ["same_priority"]).select("o_orderkey", "same_priority")


@query("tuple_members", """SELECT COUNT(*) AS lines FROM lineitem WHERE (l_partkey, l_suppkey) IN (
SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45)""")
def tuple_members(spark, folder):
    lines = table(spark, folder, "lineitem")
    large = lines.where(F.col("l_quantity") > 45)
    return joins.members(lines, large, {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"}).agg(F.count("*").alias("lines"))


@query("aliased_columns", "SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS total FROM orders")
def aliased_columns(spark, folder):
    raw = clean_names(table(spark, folder, "orders").withColumnsRenamed({
        "o_orderkey": "Código - PEDIDO", "o_custkey": "Cliente (nº)", "o_totalprice": "PREÇO TOTAL R$"}))
    chosen = resolve_aliases(raw.columns, {
        "id": ["codigo_pedido"], "customer": ["cliente", "CLIENTE__Nº"], "total": ["preco_total_r"]})
    return raw.select(*[F.col(source).alias(target) for target, source in chosen.items()])


def _cosines(spark, folder):
    vectors = table(spark, folder, "embeddings")
    nxt = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(nxt, "vec_id").select("vec_id", "label", cosine(F.col("embedding"), F.col("other")).alias("score"))


_COSINES = """WITH c AS (SELECT a.vec_id, a.label, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
"""


@query("pair_cosine", _COSINES + "SELECT vec_id, label, round(score, 6) + 0.0 AS score FROM c")
def pair_cosine(spark, folder):
    return _cosines(spark, folder).withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("pair_stats", _COSINES + """SELECT label, COUNT(*) AS pairs, round(AVG(score), 6) + 0.0 AS score_mean,
round(quantile_cont(score, 0.5), 6) + 0.0 AS score_median FROM c GROUP BY 1""")
def pair_stats(spark, folder):
    out = pairs.stats_by_original(_cosines(spark, folder), "label", ["score"])
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("score_mean", "score_median")})


@query("pair_overall", _COSINES + """SELECT COUNT(DISTINCT label) AS originals, COUNT(*) AS pairs, round(AVG(score), 6) + 0.0 AS mean,
round(stddev_pop(score), 6) AS std, round(quantile_cont(score, 0.5), 6) + 0.0 AS median FROM c""")
def pair_overall(spark, folder):
    out = pairs.overall_stats(_cosines(spark, folder), "label", "score")
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("mean", "std", "median")})


def _turns(spark, folder):
    """Each user turn with the assistant turn after it."""
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("original"))
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("paraphrase"))
    return asked.join(answered, ["conv_id", "turn"])


_WORDS = r"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"
_BLEU = f"""WITH p AS (SELECT a.conv_id, a.turn, {_WORDS.format(c='a.text')} AS r, {_WORDS.format(c='b.text')} AS h
  FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant'),
sizes AS (SELECT conv_id, turn, CAST(len(r) AS DOUBLE) AS lr, CAST(len(h) AS DOUBLE) AS lh, n, greatest(len(h) - n + 1, 1) AS size
  FROM p, (SELECT unnest([1, 2, 3, 4]) AS n)),
hg AS (SELECT conv_id, turn, n, g, COUNT(*) AS c FROM (SELECT conv_id, turn, n,
  unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], chr(1)))) AS g
  FROM p, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
rg AS (SELECT conv_id, turn, n, g, COUNT(*) AS c FROM (SELECT conv_id, turn, n,
  unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], chr(1)))) AS g
  FROM p, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
m AS (SELECT conv_id, turn, n, SUM(least(hg.c, rg.c)) AS hits FROM hg JOIN rg USING (conv_id, turn, n, g) GROUP BY ALL),
s AS (SELECT sizes.*, COALESCE(hits, 0) AS hits, SUM(CASE WHEN COALESCE(hits, 0) = 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY conv_id, turn ORDER BY n) AS zeros FROM sizes LEFT JOIN m USING (conv_id, turn, n)),
f AS (SELECT conv_id, turn, any_value(lr) AS lr, any_value(lh) AS lh, MAX(CASE WHEN n = 1 THEN hits END) AS first,
  MIN(CASE WHEN hits = 0 AND lh <= 1 THEN 0 ELSE 1 END) AS usable,
  SUM(0.25 * ln(CASE WHEN hits > 0 THEN CAST(hits AS DOUBLE) / size WHEN lh > 1 THEN ln(lh) / (pow(2, zeros) * 5) / size ELSE 1 END)) AS logs
  FROM s GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN first = 0 OR usable = 0 THEN 0 ELSE exp(logs) * CASE WHEN lh > lr THEN 1 ELSE exp(1 - lr / lh) END END, 6) AS score FROM f"""


@query("pair_bleu", _BLEU)
def pair_bleu(spark, folder):
    return bleu(_turns(spark, folder), ["conv_id", "turn"], "original", "paraphrase").withColumn("score", F.round("score", 6))


def _records(spark, folder, docs=None):
    """Question/SQL records with every field of the corpus, made of the documents; their SQL is ``sql`` or the text."""
    docs = table(spark, folder, "documents") if docs is None else docs
    return docs.select(
        F.col("lang").alias("original_nl_query"), F.col("text").alias("nl_query"), F.col("sql" if "sql" in docs.columns else "text").alias("sql_query"),
        F.col("source").alias("complexity"), F.col("lang").alias("query_type"),
        F.split("text", " ").alias("tables_involved"),
        F.struct(F.replace("text", F.lit(" "), F.lit("\n")).alias("original_sql")).alias("generation_metadata"))


@query("catalogue_counts", """SELECT 'complexity' AS kind, source AS value, COUNT(*) AS records FROM documents GROUP BY 2
UNION ALL SELECT 'query_type', lang, COUNT(*) FROM documents GROUP BY 2
UNION ALL SELECT 'table', t, COUNT(*) FROM (SELECT unnest(string_split(text, ' ')) AS t FROM documents) GROUP BY 2""")
def catalogue_counts(spark, folder):
    return pairs.catalogue_counts(_records(spark, folder))


@query("paraphrase_counts", """SELECT lang AS original_nl_query, COUNT(*) AS paraphrases,
COUNT(*) FILTER (doc_id % 3 <> 0) AS same_sql FROM documents GROUP BY 1""")
def paraphrase_counts(spark, folder):
    """A third of the records has another SQL than its original."""
    docs = table(spark, folder, "documents")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" LIMIT 1"))).otherwise(F.col("text"))
    return pairs.paraphrase_counts(_records(spark, folder, docs.withColumn("sql", changed)))


_PROFILED = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_quantity", "double"), ("l_discount", "double"), ("l_returnflag", "string"), ("l_linestatus", "string")]


@query("table_profile", "SELECT * FROM (" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS type, COUNT(*) AS records, COUNT(*) - COUNT({c}) AS missing, (COUNT(*) - COUNT({c})) * 100.0 / COUNT(*) AS percent,
COUNT(DISTINCT {c}) AS distinct_values, """ + (
        f"round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, CAST(min({c}) AS DOUBLE) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max, " if kind != "string" else
        "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max, ")
    + f"(SELECT round(n / SUM(n) OVER (), 6) FROM (SELECT {c}, COUNT(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC LIMIT 1) AS top_share FROM lineitem"
    for c, kind in _PROFILED) + ")")
def table_profile(spark, folder):
    out = profile.table_profile(table(spark, folder, "lineitem").select(*[c for c, _ in _PROFILED]))
    share = F.round(F.get("top", 0)["share"], 6).alias("top_share")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "std")}).select("*", share).drop("top")
