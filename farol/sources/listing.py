"""File links and page bodies out of a table of fetched pages (url, html)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.functions.dates import first_year
from farol.operators.joins import members, salted_lookup

_HREF = r"""(?is)href\s*=\s*["']([^"']*)["']"""


def without_dots(url: Column) -> Column:
    """Address whose path has no ``.`` and ``..`` segments; those above the root fall away."""
    host = F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    rest = F.substring(url, F.length(host) + F.length(path) + 1, F.length(url))
    segments = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), none, lambda done, s: F.when(
        s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    last = F.element_at(segments, -1)
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.rlike("(^|/)[.]{1,2}(/|$)"), F.concat(host, folded, rest)).otherwise(url)


def plain_text(c: Column) -> Column:
    """The five basic entities as their characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _has_class(name: str) -> str:
    """Pattern of a class attribute with the name as one of its words."""
    return rf"""class\s*=\s*(?:"(?:[^"]*\s)?{re.escape(name)}(?:\s[^"]*)?"|'(?:[^']*\s)?{re.escape(name)}(?:\s[^']*)?')"""


def absolute_url(base: Column, href: Column) -> Column:
    """Link target seen from the page it stands on."""
    href = plain_text(href)
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    host = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, "^([^?#]*)", 1)
    folder = F.when(page == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    return without_dots(F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/"), F.concat(host, href))
            .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
            .when(href.startswith("?"), F.concat(page, href))
            .otherwise(F.concat(folder, href)))


def _anchors(html: Column, css: str | None) -> Column:
    """Opening anchor tags, optionally only those with a class."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    if css is None:
        return tags
    return F.filter(tags, lambda tag: tag.rlike(f"(?is){_has_class(css)}"))


def page_links(pages: DataFrame, item: str | None = None, css: str | None = None) -> DataFrame:
    """(page, link) per anchor with a target; inside list items only the first one counts."""
    if item is None:
        tags = pages.select("url", F.explode(_anchors(F.col("html"), css)).alias("tag"))
    else:
        blocks = F.regexp_extract_all(
            F.col("html"), F.lit(rf"(?is)<li\s[^>]*{_has_class(item)}[^>]*>.*?</li\s*>"), F.lit(0))
        items = pages.select("url", F.explode(blocks).alias("block"))
        tags = items.select("url", F.get(_anchors(F.col("block"), css), 0).alias("tag"))
    found = tags.where(F.col("tag").rlike(_HREF)).select("url", F.regexp_extract("tag", _HREF, 1).alias("href"))
    return found.select(F.col("url").alias("page"), "href", absolute_url(F.col("url"), F.col("href")).alias("link"))


def file_links(pages: DataFrame, item: str | None = "resource-item", css: str | None = "resource-url-analytics") -> DataFrame:
    """Data files of a listing page, oldest first by the year in the address."""
    links = page_links(pages, item, css)
    name = F.lower("href")
    wanted = name.contains(".csv") | (name.endswith(".zip") & ~name.contains("json") & ~name.contains("xml"))
    return links.where(wanted).withColumn("year", first_year(F.col("link"))).orderBy("year", "link")


def direct_or_second_hop(listing: DataFrame, pages: DataFrame, item: str | None = "resource-item",
                         css: str | None = "resource-url-analytics", button: str = "btn-primary") -> DataFrame:
    """Data files (page, link) linked directly, else by the button on the linked page; documents are ignored.

    Linked addresses are resolved, without a fragment, before they meet the pages' own; of pages with one address the least
    button target counts. A page that a large share of all links point to is met by salted rows.
    """
    links = page_links(listing, item, css).withColumn("name", F.lower("href"))
    is_file = F.col("name").rlike(r"\.(csv|zip)$")
    ignored = F.col("name").rlike(r"(\.pdf|xml|json)$")
    direct = links.where(is_file).select("page", "link")
    hops = links.where(~is_file & ~ignored).select("page", "href", F.regexp_replace("link", "#.*$", "").alias("hop"))
    # the address is matched first; the html is read of pages that are linked
    known = pages.select(F.regexp_replace("url", "#.*$", "").alias("hop"), "url", "html")
    wanted = members(known, hops, {"hop": "hop"})
    buttons = wanted.select("hop", "url", F.get(_anchors(F.col("html"), button), 0).alias("tag")).where(F.col("tag").rlike(_HREF)).groupBy("hop").agg(
        F.min(absolute_url(F.col("url"), F.regexp_extract("tag", _HREF, 1))).alias("link"))
    found = salted_lookup(hops, buttons, {"hop": "hop"}, ["link"], ["page", "href"])
    return direct.unionByName(found.where(F.col("link").isNotNull()).select("page", "link"))


def page_body(html: Column) -> Column:
    """Text between the body tags, '' without them."""
    return F.regexp_extract(html, r"(?is)<body.*?>(.*?)</body\s*>", 1)
