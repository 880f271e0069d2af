"""URL filtering: longest-match host and path rules, and a Bloom filter cascade for the listed hosts.

The first filter of the cascade holds the listed keys. The second holds those other keys of the
corpus that the first lets through, the third the listed keys that the second lets through, and so on
until none is left. As every key of the corpus went into the making, a key's answer is exact: it is
listed if the first filter without it is an even one. Filters have a fixed number of bits a key; beyond ``BLOCK_KEYS``
listed keys the key space is cut into blocks by hash, each with a cascade of its own, so what is
broadcast at once stays below ``BLOCK_KEYS * BITS`` bits for the first level and less for the others.
Pages meet the filters in place; they are not joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready

BITS, PROBES = 10, 7
BLOCK_KEYS = 20_000_000

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: A host is listed if one of its labels holds one of these.
TERMS = ("adult-", "ads-", "-bets", "casino", "-pills", "spam-")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host or its parent and the start of the path, and its verdict; null without any."""
    def fits(name: str, start: str) -> Column:
        return ((host == name) | host.endswith("." + name)) & path.startswith(start)

    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        rule = F.when(fits(name, start), name + start).otherwise(rule)
        verdict = F.when(fits(name, start), kind).otherwise(verdict)
    return rule, verdict


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key, one row per probe."""
    h = hashes.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)])


def _words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column("hash").to_numpy(), bits).ravel()
            value = np.left_shift(np.uint64(1), at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    return run


def _holds(level: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, len(level) * 64)
    return np.all((level[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1), axis=0)


def _passing(level):
    """Keys that a filter lets through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_holds(level.value, batch.column("hash").to_numpy()))).select(["key"])

    return run


def cascade(listed: DataFrame, others: DataFrame, stages: Stages, name: str) -> list[np.ndarray]:
    """Filters, alternately of listed keys and of the other keys that pass, for two tables (key) without common keys."""
    spark, levels = listed.sparkSession, []
    inside, outside = listed, others
    while count := inside.count():
        bits = -(-count * BITS // 64) * 64
        salted = inside.select(F.xxhash64(F.lit(len(levels)), "key").alias("hash"))
        words = salted.mapInArrow(_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        level = np.zeros(bits // 64, np.uint64)
        level[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(level)
        passing = outside.select("key", F.xxhash64(F.lit(len(levels)), "key").alias("hash")).mapInArrow(_passing(shared), "key string")
        inside, outside = stages.put(f"{name}-{len(levels)}", passing), inside
        levels.append(level)
    return levels


def _listed(levels):
    """Whether the cascade has the key of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes")
            table = hashes.flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.int64)
            answer, open_ = np.zeros(batch.num_rows, bool), np.ones(batch.num_rows, bool)
            for k, level in enumerate(levels.value):
                held = _holds(level, np.ascontiguousarray(table[:, k]))
                answer[open_ & ~held] = k % 2 == 1
                open_ &= held
            answer[open_] = len(levels.value) % 2 == 1
            yield pa.RecordBatch.from_arrays([*[c for c, f in zip(batch.columns, batch.schema) if f.name != "hashes"], pa.array(answer)],
                                             [*[f.name for f in batch.schema if f.name != "hashes"], "listed"])

    return run


def with_membership(rows: DataFrame, listed: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``rows`` (with a text column ``key``) and a column ``listed``: whether its key is one of ``listed`` (key)."""
    spark = ready(rows.sparkSession)
    stages = Stages(spark)
    universe = rows.select("key").distinct()
    listed = stages.put("urls-listed", listed.select("key").distinct())
    others = stages.put("urls-others", universe.join(listed, "key", "left_anti"))
    blocks = max(1, -(-listed.count() // block_keys))
    out = None
    for block in range(blocks):
        def mine(df: DataFrame, block: int = block) -> DataFrame:
            return df if blocks == 1 else df.where(F.pmod(F.xxhash64(F.lit("block"), "key"), F.lit(blocks)) == block)

        levels = cascade(mine(listed), mine(others), stages, f"urls-level-{block}")
        shared = spark.sparkContext.broadcast(levels)
        hashed = mine(rows).withColumn("hashes", F.array(*[F.xxhash64(F.lit(k), "key") for k in range(max(1, len(levels)))]))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        part = hashed.mapInArrow(_listed(shared), f"{kinds}, listed boolean")
        out = part if out is None else out.unionByName(part)
    stages.keep()
    return out


def hosts_with_terms(keys: DataFrame, terms=TERMS) -> DataFrame:
    """The listed ones of the hosts (key)."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains("key", F.lit(term))
    return keys.where(found)


def judged_urls(pages: DataFrame, rules=RULES, terms=TERMS, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """pages -> (page_id, host, path, rule, verdict), one row per row.

    The longest fitting rule decides; without one a url is blocked if the cascade lists its host. A null url and one
    without ``://`` have empty host and path and are allowed. Repeated rows and null ids are judged each. An empty
    table gives an empty result.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("key"), path.alias("path"))
    known = with_membership(rows, hosts_with_terms(rows.select("key"), terms), block_keys)
    rule, verdict = ruled(F.col("key"), F.col("path"), rules)
    return known.select("page_id", F.col("key").alias("host"), "path", rule.alias("rule"),
                        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
