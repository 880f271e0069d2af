"""Not-modified revisits in web archives: each is resolved to the latest earlier full response of its url.

The as-of join sorts only keys, times and validators, in day ranges per url: what a url had before a day comes
from the last response of each earlier day, so a url with a third of all captures is not one task's.
Payloads and headers are fetched afterwards, for the captures that are referred to: those are marked in the scan, so that the payloads of
others are not shuffled.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready
from farol.llm.exact_dedup import marked

#: Headers that a not-modified answer may renew in the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")

#: Query parameters that do not name another resource.
TRACKING = ("ref", "fbclid", "gclid")


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.``, path without trailing slash, query without tracking parameters in order, no scheme or fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    place, query = F.regexp_extract(bare, r"^[^?]*", 0), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_extract(place, "^[^/]*", 0)), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolved(captures: DataFrame) -> DataFrame:
    """(record_id, url, at, kind, headers, payload) -> one row for each revisit.

    ``kind`` is ``response`` or ``revisit``, ``at`` a timestamp, ``headers`` a map with lower-case names. Columns: record_id, url_key,
    refers_to, outcome, headers, payload. A revisit refers to the latest response of its canonical url at an earlier time, the
    largest record_id if several have that time. The etags must be equal (weak marks aside) if the revisit has one, else the
    last-modified dates. Outcomes: ``resolved``; ``unchecked`` without validators in the revisit; ``changed`` if they differ;
    ``missing`` without an earlier response. Only the first two get a payload and headers: the response's, renewed by the revisit's
    permitted ones. A null url is the empty url; rows with a null id, time or kind resolve nothing, and such revisits are
    ``missing``. Repeated rows: revisits resolve each, a response counts once. A record_id may stand for several captures: payload and
    headers are those of the capture with the url and time that were found, the least payload (then headers) of several such. Payloads
    of any length are passed through. Empty tables give an empty result; further columns are ignored.
    """
    stages = Stages(ready(captures.sparkSession))
    rows = captures.select("record_id", canonical(F.col("url")).alias("url_key"), F.unix_micros("at").alias("at"), F.to_date("at").alias("day"), "kind",
                           F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"))
    rows = stages.put("revisits-keys", rows.where("kind = 'revisit' or (kind = 'response' and record_id is not null and at is not null)"))
    response = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "modified"))
    daily = rows.groupBy("url_key", "day").agg(F.max(response).alias("last"))
    earlier_days = Window.partitionBy("url_key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select("url_key", "day", F.max("last").over(earlier_days).alias("carried"))
    same_day = Window.partitionBy("url_key", "day").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.max(response).over(same_day)).where("kind = 'revisit'").alias("r").join(
        carried.alias("c"), F.expr("r.url_key = c.url_key and r.day = c.day"), "left").select(
        "r.record_id", "r.url_key", "r.at", "r.etag", "r.modified", F.when(F.col("r.at").isNotNull(), F.coalesce("r.found", "c.carried")).alias("found"))
    outcome = (F.when(F.col("found").isNull(), "missing")
               .when(F.col("etag").isNotNull(), F.when(_weak(F.col("etag")) == _weak(F.coalesce("found.etag", F.lit(""))), "resolved").otherwise("changed"))
               .when(F.col("modified").isNotNull(), F.when(F.col("found.modified").eqNullSafe(F.col("modified")), "resolved").otherwise("changed"))
               .otherwise("unchecked"))
    found = stages.put("revisits-found", found.select(
        "record_id", "url_key", "at", F.col("found.record_id").alias("refers_to"), F.col("found.at").alias("refers_at"), outcome.alias("outcome")))
    stages.drop("revisits-keys")
    capture = ["full_id", "full_key", "full_at"]
    referred = stages.put("revisits-referred", found.where("outcome in ('resolved', 'unchecked')").select(
        F.col("refers_to").alias("full_id"), F.col("url_key").alias("full_key"), F.col("refers_at").alias("full_at")).distinct())
    responses = captures.where("kind = 'response' and at is not null").select(
        F.col("record_id").alias("full_id"), canonical(F.col("url")).alias("full_key"), F.unix_micros("at").alias("full_at"),
        F.struct(F.col("headers").alias("headers"), F.col("payload").alias("payload")).alias("full"))
    full = marked(responses, referred, *capture).where("again").groupBy(*capture).agg(
        F.min_by("full", F.struct("full.payload", F.to_json("full.headers"))).alias("full"))
    own = captures.where("kind = 'revisit'").select(
        F.col("record_id").alias("own_id"), canonical(F.col("url")).alias("own_key"), F.unix_micros("at").alias("own_at"), F.col("headers").alias("own_headers")).groupBy(
        "own_id", "own_key", "own_at").agg(F.min_by("own_headers", F.to_json("own_headers")).alias("own_headers"))
    # only revisits that get a response meet the payloads; the others need no join
    usable = F.col("outcome").isin("resolved", "unchecked")
    renewed = F.map_filter(F.coalesce("own_headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("full.headers", lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    joined = found.where(usable).join(
        full, (F.col("refers_to") == F.col("full_id")) & (F.col("url_key") == F.col("full_key")) & (F.col("refers_at") == F.col("full_at"))).join(
        own, F.col("record_id").eqNullSafe(F.col("own_id")) & (F.col("url_key") == F.col("own_key")) & F.col("at").eqNullSafe(F.col("own_at")), "left")
    columns = ["record_id", "url_key", "refers_to", "outcome"]
    return joined.select(*columns, merged.alias("headers"), F.col("full.payload").alias("payload")).unionByName(found.where(~usable).select(
        *columns, F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast(captures.schema["payload"].dataType).alias("payload")))


def _lines(data: bytes, at: int) -> tuple[list[str], int]:
    """Header lines from a place up to an empty line, and the place after it."""
    end = data.find(b"\r\n\r\n", at)
    end = len(data) if end < 0 else end
    return data[at:end].decode("utf-8", "replace").split("\r\n"), end + 4


def _named(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k.strip()}


def records(data: bytes) -> Iterator[dict]:
    """Captures in the bytes of one WARC file, gzipped or not; records of other types are passed over."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        lines, body = _lines(data, at)
        fields = _named(lines[1:])
        size = int(fields.get("content-length", 0))
        if fields.get("warc-type") in ("response", "revisit"):
            block = data[body:body + size]
            head, start = _lines(block, 0)
            yield {"record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "at": fields.get("warc-date"),
                   "kind": fields["warc-type"], "headers": _named(head[1:]), "payload": block[start:].decode("utf-8", "replace")}
        at = body + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of WARC files for ``resolved``; a file is read in one task."""
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("at", pa.string()), ("kind", pa.string()),
                        ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                for record in records(data.as_py()):
                    yield pa.RecordBatch.from_pylist([record | {"headers": list(record["headers"].items())}], schema)

    rows = ready(spark).read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "record_id string, url string, at string, kind string, headers map<string,string>, payload string")
    return rows.withColumn("at", F.to_timestamp("at"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages as captures an hour apart: every third a revisit, with an etag that changes with the url's pages' numbers or a date."""
    key, number = canonical(F.col("url")), F.col("page_id")
    etag = F.concat(F.lit('"'), F.substring(F.md5(F.concat(key, F.lit("/"), F.expr("page_id div 4000").cast("string"))), 1, 8), F.lit('"'))
    date = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.expr("page_id div 4000") * 86_400), "yyyy-MM-dd")
    headers = F.map_filter(F.create_map(
        F.lit("date"), F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + number * 3600), "yyyy-MM-dd HH:mm:ss"),
        F.lit("etag"), F.when(number % 5 != 0, F.concat(F.when(number % 2 == 0, "W/").otherwise(""), etag)),
        F.lit("last-modified"), F.when(number % 7 != 0, date),
        F.lit("content-type"), F.when(number % 3 != 2, "text/html"),
        F.lit("content-length"), F.length("html").cast("string")), lambda k, v: v.isNotNull())
    return pages.select(number.cast("long").alias("record_id"), "url", F.timestamp_seconds(F.lit(1_600_000_000) + number * 3600).alias("at"),
                        F.when(number % 3 == 2, "revisit").otherwise("response").alias("kind"), headers.alias("headers"), F.col("html").alias("payload"))


def revisit_digests(pages: DataFrame) -> DataFrame:
    """Resolved revisits of the pages' captures with their headers as one text and the hash of their payload."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolved(page_captures(pages)).select("record_id", "url_key", "refers_to", "outcome", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))
