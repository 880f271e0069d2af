"""Text, number and date cleaning over the order, document and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from farol.catalog import query, table
from farol.functions import dates, numeric, text
from farol.operators import shaping
from farol.session import scratch_dir
from farol.sources import listing
from farol.sources.geojson import feature_names

# Line breaks and blanks that the counterpart's trim() has to be told about.
_WHITE = r"E' \t\n\r'"


_CLEAN = "NULLIF(NULLIF(NULLIF(NULLIF(upper(replace(trim({c}, " + _WHITE + "), 'ß', 'SS')), 'NAN'), 'NONE'), ''), 'N/A')"


@query("clean_text", f"""SELECT doc_id, md5({_CLEAN.format(c='text')}) AS cleaned,
{_CLEAN.format(c="CASE WHEN lang = 'fr' THEN ' n/a ' ELSE lang END")} AS language FROM documents""")
def clean_text(spark, folder):
    lang = F.when(F.col("lang") == "fr", " n/a ").otherwise(F.col("lang"))
    return table(spark, folder, "documents").select(
        "doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned"), text.clean_text(lang).alias("language"))


@query("digits_only", r"""SELECT doc_id, COALESCE(regexp_replace(regexp_replace(text, '\.0+\z', ''), '[^0-9]', '', 'g'), '')
AS digits FROM documents""")
def digits_only(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.digits_only(F.col("text")).alias("digits"))


@query("padded_code", """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS cep FROM customer""")
def padded_code(spark, folder):
    exported = F.col("c_custkey").cast("double").cast("decimal(18,1)").cast("string")
    return table(spark, folder, "customer").select("c_custkey", text.padded_code(exported, 8).alias("cep"))


@query("fold_accents", "SELECT doc_id, md5(replace(strip_accents(text), 'ß', 'ss')) AS folded FROM documents")
def fold_accents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("folded"))


@query("cut_width", "SELECT doc_id, substring(text, 1, 60) AS start FROM documents")
def cut_width(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.cut(F.col("text"), 60).alias("start"))


@query("squeeze_space", r"""SELECT doc_id,
md5(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), '\s*;\z', '')) AS squeezed FROM documents""")
def squeeze_space(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.md5(text.squeeze_space(F.col("text"))).alias("squeezed"))


@query("city_substitution", """SELECT p_partkey, CASE upper(p_name) WHEN 'RED WIDGET' THEN 'RUBY WIDGET'
WHEN 'HOT GEAR' THEN 'WARM GEAR' ELSE upper(p_name) END AS name FROM part""")
def substitution(spark, folder):
    mapping = {"RED WIDGET": "RUBY WIDGET", "HOT GEAR": "WARM GEAR"}
    return table(spark, folder, "part").select(
        "p_partkey", text.substitute(text.accent_key(F.col("p_name")), mapping).alias("name"))


@query("int_coerce", """SELECT l_returnflag, l_linestatus, COUNT(*) AS lines,
CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS zero_sum,
CAST(SUM(CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS null_sum,
CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS lossy FROM lineitem GROUP BY 1, 2""")
def int_coerce(spark, folder):
    number = F.col("l_quantity").cast("bigint").cast("string")
    point = (F.when(F.col("l_returnflag") == "A", F.concat(number, F.lit(".7")))
             .when(F.col("l_returnflag") == "R", "abc").otherwise(F.concat(F.lit(" "), number)))
    comma = F.replace(point, F.lit("."), F.lit(","))
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("lines"), F.sum(numeric.int_or_zero(point)).alias("zero_sum"),
        F.sum(numeric.comma_int(comma)).alias("null_sum"),
        F.count_if(numeric.loses_fraction(comma)).alias("lossy"))


@query("br_decimal", """SELECT l_returnflag,
CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE) AS brazilian,
CAST(SUM(CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE) AS pointed,
CAST(SUM(CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE) AS comma_only FROM lineitem GROUP BY 1""")
def br_decimal(spark, folder):
    price = F.col("l_extendedprice").cast("decimal(20,2)")
    brazilian = F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise("R$ "),
                         F.translate(F.format_number(price, 2), ",.", ".,"))
    pointed = price.cast("string")
    return table(spark, folder, "lineitem").groupBy("l_returnflag").agg(
        F.sum(numeric.br_decimal(brazilian)).alias("brazilian"), F.sum(numeric.br_decimal(pointed)).alias("pointed"),
        F.sum(numeric.comma_decimal(F.replace(pointed, F.lit("."), F.lit(",")))).alias("comma_only"))


@query("point_style", """SELECT 'l_extendedprice' AS field, true AS pointed, CAST(SUM(CAST(l_extendedprice AS DECIMAL(20,4))) AS DOUBLE) AS total
FROM lineitem UNION ALL SELECT 'l_quantity', false, CAST(SUM(CAST(l_quantity AS DECIMAL(20,4))) AS DOUBLE) FROM lineitem""")
def point_style(spark, folder):
    """Decimal style judged per column: prices with a point, quantities with thousands points."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").cast("decimal(20,2)").cast("string").alias("l_extendedprice"),
        F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(",00")).alias("l_quantity"))
    long = rows.unpivot([], ["l_extendedprice", "l_quantity"], "field", "value")
    styles = long.groupBy("field").agg(numeric.point_style_hint(F.col("value")).alias("pointed"))
    judged = long.join(F.broadcast(styles), "field")  # one row per column
    return judged.groupBy("field", "pointed").agg(
        F.sum(numeric.br_decimal(F.col("value"), point_style=F.col("pointed"))).alias("total"))


@query("date_parse", """SELECT o_orderpriority, strftime(MIN(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS first_day,
strftime(MAX(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS last_day,
CAST(SUM(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END) AS BIGINT) AS parsed
FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS o_orderdate FROM orders)
GROUP BY 1""")
def date_parse(spark, folder):
    day = F.col("o_orderdate")
    spelled = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(day, "yyyy-MM-dd"))
               .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "yyyy/MM/dd"))
               .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(day, "dd/MM/yyyy"))
               .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
               .otherwise("not a date"))
    parsed = dates.date_of(spelled)
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        *dates.period_bounds(parsed), F.count(parsed).alias("parsed"))


@query("month_parse", """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, COUNT(*) AS orders,
MIN(year(o_orderdate)) AS year FROM orders GROUP BY 1""")
def month_parse(spark, folder):
    spelled = F.date_format("o_orderdate", "yyyyMM")
    rows = table(spark, folder, "orders").select(
        dates.month_label(dates.month_of(spelled)).alias("month"),
        dates.first_year(F.concat(F.lit("stock_"), spelled, F.lit(".csv"))).alias("year"))
    return rows.groupBy("month").agg(F.count("*").alias("orders"), F.min("year").alias("year"))


@query("offset_timestamp", """SELECT event_id, strftime(date_trunc('second', ts) + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS utc
FROM events""")
def offset_timestamp(spark, folder):
    spelled = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("-03"))
    return table(spark, folder, "events").select("event_id", dates.utc_timestamp(spelled).alias("utc"))


@query("derived_total", """SELECT l_linestatus, CAST(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(20,4))
ELSE CAST(l_quantity AS DECIMAL(20,4)) * CAST(l_tax AS DECIMAL(20,4)) END) AS DOUBLE) AS total FROM lineitem GROUP BY 1""")
def derived_total(spark, folder):
    amount = F.col("l_extendedprice").cast("decimal(20,4)")
    given = F.when(F.col("l_returnflag") == "N", amount).when(F.col("l_returnflag") == "A", F.lit(0).cast("decimal(20,4)"))
    total = numeric.filled_total(given, F.col("l_quantity").cast("decimal(20,4)"), F.col("l_tax").cast("decimal(20,4)"))
    return table(spark, folder, "lineitem").groupBy("l_linestatus").agg(F.sum(total).alias("total"))


@query("safe_ratio", """SELECT l_returnflag, l_linestatus,
CAST(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE)
  / NULLIF(SUM(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 0) * 100.0 AS percent
FROM lineitem GROUP BY 1, 2""")
def safe_ratio(spark, folder):
    quantity = F.col("l_quantity").cast("bigint")
    part = F.sum(F.when(F.col("l_linestatus") == "F", quantity).otherwise(0))
    whole = F.sum(F.when(F.col("l_returnflag") == "N", quantity).otherwise(0))
    return table(spark, folder, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        numeric.percent_of(part, whole).alias("percent"))


_CITY = """CASE o_orderpriority WHEN '1-URGENT' THEN ' N/A ' WHEN '2-HIGH' THEN concat(o_custkey, '')
WHEN '3-MEDIUM' THEN concat('(', o_orderkey, ')-') WHEN '4-NOT SPECIFIED' THEN NULL ELSE concat('Belém ', o_orderkey) END"""


@query("invalid_tokens", f"""SELECT o_orderkey, c AS city FROM (SELECT o_orderkey, {_CITY} AS c FROM orders)
WHERE COALESCE(lower(trim(c)), '') IN ('', 'n/a') OR regexp_full_match(trim(c), '\\d+')
OR regexp_full_match(trim(c), '[^a-zA-ZÀ-ÿ]+')""")
def invalid_tokens(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.expr(_CITY).alias("city"))
    return rows.where(text.invalid_city(F.col("city")))


@query("swap_repair", """SELECT o_orderkey, o_orderpriority, CAST(o_custkey AS VARCHAR) AS ident, c_name AS name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def swap_repair(spark, folder):
    """Ids and names exchanged in the 'files' of two priorities, found and put back."""
    rows = table(spark, folder, "orders").join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    swapped = F.col("o_orderpriority").isin("1-URGENT", "5-LOW")
    ident, name = F.col("o_custkey").cast("string"), F.col("c_name")
    broken = rows.select("o_orderkey", "o_orderpriority", F.when(swapped, name).otherwise(ident).alias("ident"),
                         F.when(swapped, ident).otherwise(name).alias("name"))
    return shaping.repair_swaps(broken, [("ident", "name")], "o_orderpriority")


@query("display_labels", """SELECT p_partkey, array_to_string(list_transform(string_split(replace(lower(p_name), ' ', '_'), '_'),
lambda x: upper(substring(x, 1, 1)) || substring(x, 2)), ' ') AS label FROM part""")
def display_labels(spark, folder):
    name = F.replace(F.lower("p_name"), F.lit(" "), F.lit("_"))
    return table(spark, folder, "part").select("p_partkey", text.display_label(name).alias("label"))


@query("page_links", """SELECT url AS page, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href
FROM pages""")
def page_links(spark, folder):
    return listing.page_links(table(spark, folder, "pages")).select("page", "href")


@query("page_links_absolute", r"""SELECT page, link, COUNT(*) AS n FROM (SELECT url AS page, unnest(regexp_extract_all(html,
'(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS host,
CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+):', 1) || ':' || href
WHEN starts_with(href, '/') THEN host || href
WHEN starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href
WHEN starts_with(href, '?') THEN regexp_extract(url, '^([^?#]*)', 1) || href
WHEN regexp_extract(url, '^([^?#]*)', 1) = host THEN host || '/' || href
ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*\z', '') || href END AS link FROM pages) GROUP BY 1, 2""")
def page_links_absolute(spark, folder):
    return listing.page_links(table(spark, folder, "pages")).groupBy("page", "link").agg(F.count("*").alias("n"))


@query("page_body", r"SELECT page_id, md5(regexp_extract(html, '(?is)<body.*?>(.*?)</body\s*>', 1)) AS body FROM pages")
def page_body(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(listing.page_body(F.col("html"))).alias("body"))


# Listing pages over the addresses of ``pages``: four resources each, of five kinds; many of the linked pages are the first one.
_KINDS = ["'/dados/leitos_' || CAST(2015 + n % 9 AS VARCHAR) || '_' || CAST(n AS VARCHAR) || '.csv'", "'pacote-' || CAST(2010 + n % 7 AS VARCHAR) || '.zip'",
          "'doc-' || CAST(n AS VARCHAR) || '.pdf'", "'json_2020.zip'", "alvo"]
_RESOURCES = f"""first_page AS (SELECT url AS first_url FROM pages ORDER BY page_id LIMIT 1),
resources AS (SELECT page, alvo, n, CASE n % 5 WHEN 0 THEN {_KINDS[0]} WHEN 1 THEN {_KINDS[1]} WHEN 2 THEN {_KINDS[2]} WHEN 3 THEN {_KINDS[3]} ELSE {_KINDS[4]} END AS href
  FROM (SELECT a.url AS page, a.page_id * 4 + i AS n, CASE WHEN (a.page_id * 4 + i) % 3 = 0 THEN first_url ELSE a.url END AS alvo
    FROM pages a, first_page, (SELECT unnest([0, 1, 2, 3]) AS i))),
hosts AS (SELECT *, regexp_extract(page, '^([a-zA-Z]+://[^/?#]*)', 1) AS host, regexp_extract(page, '^([^?#]*)', 1) AS plain_page FROM resources),
links AS (SELECT *, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN host || href
  WHEN plain_page = host THEN host || '/' || href ELSE regexp_replace(plain_page, '[^/]*$', '') || href END AS link FROM hosts)"""


def _listing(spark, folder):
    """Pages whose html lists the four resources and has a button."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    numbered = pages.withColumn("first_url", pages.select(F.min_by("url", "page_id")).scalar())

    def item(i: int):
        n = F.col("page_id") * 4 + i
        text = n.cast("string")
        href = (F.when(n % 5 == 0, F.concat(F.lit("/dados/leitos_"), (2015 + n % 9).cast("string"), F.lit("_"), text, F.lit(".csv")))
                .when(n % 5 == 1, F.concat(F.lit("pacote-"), (2010 + n % 7).cast("string"), F.lit(".zip")))
                .when(n % 5 == 2, F.concat(F.lit("doc-"), text, F.lit(".pdf"))).when(n % 5 == 3, F.lit("json_2020.zip"))
                .otherwise(F.when(n % 3 == 0, F.col("first_url")).otherwise(F.col("url"))))
        return F.concat(F.lit('<li class="resource-item"><a class="heading" href="/h">t</a><a href="'), href, F.lit('" class="resource-url-analytics">d</a></li>'))

    button = F.concat(F.lit('<a class="btn btn-primary" href="/baixar/'), F.col("page_id").cast("string"), F.lit('.csv">b</a>'))
    return numbered.select("url", F.concat(*[item(i) for i in range(4)], button).alias("html"))


@query("file_links", "WITH " + _RESOURCES + r"""SELECT page, link,
COALESCE(TRY_CAST(NULLIF(regexp_extract(link, '(\d{4})', 1), '') AS INTEGER), 0)::BIGINT AS year, COUNT(*) AS n FROM links WHERE n % 5 < 2 GROUP BY ALL""")
def file_links(spark, folder):
    """Data files that listing pages link to."""
    return listing.file_links(_listing(spark, folder)).groupBy("page", "link", "year").agg(F.count("*").alias("n"))


@query("second_hop", "WITH " + _RESOURCES + r""", buttons AS (SELECT regexp_replace(url, '#.*$', '') AS hop,
min(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/baixar/' || CAST(page_id AS VARCHAR) || '.csv') AS target FROM pages GROUP BY 1)
SELECT page, link, COUNT(*) AS n FROM (SELECT page, link FROM links WHERE n % 5 < 2 OR n % 5 = 3
UNION ALL SELECT page, target FROM links JOIN buttons ON regexp_replace(alvo, '#.*$', '') = hop WHERE n % 5 = 4
  AND NOT regexp_matches(lower(alvo), '(\.(csv|zip)|\.pdf|xml|json)$')) GROUP BY 1, 2""")
def second_hop(spark, folder):
    """Files linked directly, and those behind the button of a linked page, which is the same page for many links."""
    pages = _listing(spark, folder)
    return listing.direct_or_second_hop(pages, pages).groupBy("page", "link").agg(F.count("*").alias("n"))


@query("geojson_names", """SELECT c_name || ' São ' || CAST(c_custkey % 7 AS VARCHAR) AS name, upper(c_name) || ' SAO ' || CAST(c_custkey % 7 AS VARCHAR) AS name_key FROM customer""")
def geojson_names(spark, folder):
    """One collection in one file and on one line, cut into many tasks where features begin."""
    rows = table(spark, folder, "customer")
    feature = F.concat(
        F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct(F.concat("c_name", F.lit(" São "), (F.col("c_custkey") % 7).cast("string")).alias("name"), F.col("c_custkey").alias("id"))),
        F.lit(', "geometry": {"type": "Point", "coordinates": ['), F.col("c_acctbal").cast("string"), F.lit(", 1.5]}}"))
    path = scratch_dir(spark, "geojson")
    opened = F.when(F.col("c_custkey") == rows.select(F.min("c_custkey")).scalar(), F.concat(F.lit('{"type": "FeatureCollection", "features": ['), feature)).otherwise(feature)
    rows.select("c_custkey", opened.alias("value")).coalesce(1).sortWithinPartitions("c_custkey").select("value").write.option("lineSep", ", ").text(path)
    return feature_names(spark, [path])
