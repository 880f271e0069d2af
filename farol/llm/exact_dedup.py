"""Exact duplicates by progressive refinement, with DataFrame functions only.

Rows are grouped by the length of their text, then by length and the hash of a prefix; each step takes only the
rows whose group of the step before had more than one. Only what survives both is hashed in full. No text is
shuffled to learn that: the keys of the surviving groups become bits of a bitmap of at most ``MOST_BITS`` bits
(32 MB, whatever the input), which is broadcast in segments of 4 KB and asked in the scan. Two keys may share a
bit; that costs a full hash, never a wrong group, because the last step compares whole hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready

#: Characters of the prefix that the second step hashes.
PREFIX = 256
#: A bitmap has 16 bits a key, at least one segment, and this many at most.
MOST_BITS = 1 << 28
SEGMENT_BITS = 1 << 15


def _bit(bits: int, *key: str) -> Column:
    """Number of a key's bit, from 0."""
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def _bitmap(keys: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """The keys as a bitmap, one row per segment that has a bit, and its size in bits."""
    bits = SEGMENT_BITS
    wanted = min(MOST_BITS, 16 * keys.count())
    while bits < wanted:
        bits *= 2
    # Spark numbers the bits of a bitmap from 1 and its segments, too
    bit = _bit(bits, *key) + 1
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("segment")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("segment_bits")), bits


def marked(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """``rows`` with ``again``: whether the bit of their key is set, which it is for all ``keys``, of the same types, and few others."""
    bitmap, bits = _bitmap(keys, *key)
    bit = _bit(bits, *key)
    byte = F.conv(F.hex(F.substring("segment_bits", (F.col("bit") % SEGMENT_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("bit", bit).withColumn("segment", F.floor(F.col("bit") / SEGMENT_BITS) + 1).join(
        F.broadcast(bitmap), "segment", "left").withColumn(
        "again", F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))).drop("bit", "segment", "segment_bits")


def _measured(docs: DataFrame, normalise, *more: Column) -> DataFrame:
    return docs.select(normalise(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"), *more).withColumn(
        "length", F.octet_length("body"))


def _refined(docs: DataFrame, stages: Stages, normalise, prefix: int, *more: Column) -> DataFrame:
    """``more`` of every row, and ``full``: the hash of its text, or null where no other row can have it."""
    start = F.xxhash64(F.substring("body", 1, prefix)).alias("start")
    lengths = stages.put("exact-lengths", _measured(docs, normalise).groupBy("length").count().where("count > 1").select("length"))
    starts = stages.put("exact-starts", marked(_measured(docs, normalise), lengths, "length").where("again").select("length", start).groupBy(
        "length", "start").count().where("count > 1").select("length", "start"))
    rows = marked(_measured(docs, normalise, *more).withColumn("start", start), starts, "length", "start")
    return rows.withColumn("full", F.when(F.col("again"), F.sha2("body", 256))).drop("start", "again")


def copy_groups(docs: DataFrame, normalise=lambda text: text, prefix: int = PREFIX, **carry: Column) -> DataFrame:
    """documents -> doc_id, keep_id, group_size, kept of every row, and the columns ``carry`` over ``docs``.

    Rows are equal when their texts are identical after ``normalise`` (a function of a column; by default no
    change). The row with the largest doc_id stays; null is the smallest, and of repeated rows with that doc_id one
    stays. A null text is empty, and empty texts are equal. Texts of any length are hashed whole. An empty table
    gives an empty result; further columns of any name are ignored unless they are carried.
    """
    stages = Stages(ready(docs.sparkSession))
    rows = _refined(docs, stages, normalise, prefix, F.col("doc_id").cast("long").alias("doc_id"),
                    F.struct(F.lit(0).alias("none"), *[c.alias(name) for name, c in carry.items()]).alias("carried"))
    rows = stages.put("exact-rows", rows.select("doc_id", "length", "full", "carried", F.monotonically_increasing_id().alias("row_id")))
    # copies are counted before the shuffle, and a row per group comes back to them
    groups = stages.put("exact-groups", rows.where("full IS NOT NULL").groupBy("length", "full").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep")).where("group_size > 1"))
    single = F.col("group_size").isNull()
    return rows.join(groups, ["length", "full"], "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row_id") == F.col("keep.row_id"))).alias("kept"), *[F.col("carried").getField(name).alias(name) for name in carry])


def without_copies(docs: DataFrame, normalise=lambda text: text, prefix: int = PREFIX) -> DataFrame:
    """The rows that stay, with all their columns; null texts, ties and repeated rows as in ``copy_groups``.

    Rows without a possible copy pass in the scan. Of the others each task keeps the largest doc_id per text before
    the shuffle, so a group of any size sends one row per task.
    """
    stages = Stages(ready(docs.sparkSession))
    rows = _refined(docs, stages, normalise, prefix, F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
                    F.col("doc_id").cast("long").alias("place")).select("doc", "place", "length", "full")
    rows = stages.put("exact-rows", rows)
    first = F.row_number().over(Window.partitionBy("length", "full").orderBy(F.col("place").desc_nulls_last()))
    best = rows.where("full IS NOT NULL").withColumn("rank", first).where("rank = 1")
    return rows.where("full IS NULL").select("doc").unionByName(best.select("doc")).select("doc.*")
