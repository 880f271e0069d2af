"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

The documents of each source stand in a shuffled queue, by a hash of their doc_id, which may be passed twice. A word's
virtual finish time is the number of words that its source has sent by then, divided by the source's target, and a
document's that of its last word: sources that are served in the order of finish times all progress alike.

The mix is the global order of finish times, cut off where the total budget is reached. The order is made by ranges:
words are summed by the ranges of virtual time in which their documents begin and end, the running sums of these ranges
say between which two the cut lies, and only the words between them are sorted, by finer ranges again and one by one in the last
of these. So no queue is sorted in one task, and documents that are being sent at the cut are taken in part.

Running sums within a queue are built from the sums of 4,096 hash ranges per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready

#: Words of all sources that a range of virtual time holds about; ranges of time 1 at most, and finer ranges in each.
RANGE_WORDS, MOST_RANGES, FINER = 1 << 16, 1 << 20, 1024
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["no_source", "source"]


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """Row identity, source, size in words and place in the shuffled queue of each document, and the columns ``more``."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col("source").cast("string").alias("origin"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more).select(
        "*", F.col("origin").isNull().alias("no_source"), F.coalesce("origin", F.lit("")).alias("source"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.col("text_hash").cast("string")))).alias("turn")).withColumn("range", F.substring("turn", 1, 3))


def targets(rows: DataFrame, weights: tuple[int, ...], percent: int, repeats: int) -> DataFrame:
    """Size and target of each source: shares of ``percent`` % of all sizes by weight, none above ``repeats`` times its size.

    Sources reach their limit in the order of limit per weight; each that does leaves the rest to the others.
    One row per source goes through one task.
    """
    sources = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    number = F.row_number().over(Window.partitionBy().orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int")).cast("decimal(18,0)")
    limit = (F.col("source_size") * repeats).cast("decimal(30,0)")
    queue = sources.withColumn("number", number).withColumn("weight", weight).withColumn("limit", limit)
    order = Window.partitionBy().orderBy(F.col("limit").cast("double") / F.col("weight").cast("double"), "number")
    others = order.rowsBetween(Window.unboundedPreceding, -1)
    queue = queue.select(
        "*", F.sum("source_size").over(everything).alias("all"),
        F.coalesce(F.sum("limit").over(others), F.lit(0)).alias("given"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(others), F.lit(0))).alias("open"))
    wide = "decimal(38,0)"
    # left for this source and those after it, in hundredths of a word
    left = (F.col("all").cast(wide) * percent - F.col("given").cast(wide) * 100).cast(wide)
    queue = queue.withColumn("left", left).withColumn(
        "full", F.col("limit").cast("double") * 100 * F.col("open").cast("double") <= F.col("weight").cast("double") * F.col("left").cast("double"))
    first = F.min(F.when(~F.col("full"), F.struct(F.col("limit").cast("double") / F.col("weight").cast("double"), "number", "left", "open"))).over(everything)
    queue = queue.withColumn("first", first)
    return queue.select(*SOURCE, "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(
        (F.col("weight").cast("double") * F.col("first.left").cast("double")) / (F.col("first.open").cast("double") * 100)).alias("target"))


def _sent(time: float, begin: Column) -> Column:
    """Words of a copy that its source has sent at a virtual time."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.lit(time) * F.col("target")) - begin)).cast("long")


def _between(copies: DataFrame, budget: int, ranges: int, stages: Stages) -> tuple[int, int]:
    """Ranges of virtual time between whose starts the budget is reached.

    At the first one all documents that have begun fit into the budget, at the second one those that have ended fill it.
    """
    # times beyond four times the cut's need no ranges of their own
    def limited(time: Column) -> Column:
        return F.least(time, F.lit(4 * ranges)).cast("long")

    begins, ends = F.col("begin") / F.col("target") * ranges, (F.col("begin") + F.col("size")) / F.col("target") * ranges
    sums = stages.put("mixing-ranges", copies.groupBy(limited(F.floor(begins)).alias("first"), limited(F.ceil(ends)).alias("last")).agg(F.sum("size").alias("words")))
    events = sums.select(F.inline(F.array(
        F.struct((F.col("first") + 1).alias("range"), F.col("words").alias("begun"), F.lit(0).cast("long").alias("done")),
        F.struct(F.col("last").alias("range"), F.lit(0).cast("long").alias("begun"), F.col("words").alias("done"))))).groupBy("range").agg(
        F.sum("begun").alias("begun"), F.sum("done").alias("done"))
    upto = Window.orderBy("range")
    found = events.select("range", F.sum("begun").over(upto).alias("begun"), F.sum("done").over(upto).alias("done")).agg(
        F.max(F.when(F.col("begun") <= budget, F.col("range"))).alias("low"), F.min(F.when(F.col("done") >= budget, F.col("range"))).alias("high")).first()
    return found["low"] or 0, found["high"]


def _last_words(copies: DataFrame, budget: int, ranges: int, low: int, high: int, stages: Stages) -> DataFrame:
    """(row_id, copy, more): words between two ranges that come before the cut, in the order of their finish times."""
    start, stop = low / ranges, high / ranges
    near = copies.withColumn("base", _sent(start, F.col("begin"))).withColumn("top", _sent(stop, F.col("begin")))
    rest = budget - (near.agg(F.sum("base")).first()[0] or 0)
    words = near.where("top > base").select("row_id", "copy", *SOURCE, "target", "begin", F.explode(F.sequence(F.col("base") + 1, F.col("top"))).alias("word"))
    time = (F.col("begin") + F.col("word")) / F.col("target")
    words = stages.put("mixing-words", words.select("row_id", "copy", *SOURCE, time.alias("time"), F.floor((time - start) * (ranges * FINER)).alias("finer")))
    upto = Window.orderBy("finer")
    finer = words.groupBy("finer").agg(F.count("*").alias("n")).select("finer", "n", F.sum("n").over(upto).alias("upto"))
    cut = finer.where(F.col("upto") >= rest).orderBy("finer").limit(1).select("finer", (F.lit(rest) - F.col("upto") + F.col("n")).alias("left")).first()
    if rest <= 0 or cut is None:
        return words.where(F.lit(rest > 0)).groupBy("row_id", "copy").agg(F.count("*").alias("more"))
    place = F.row_number().over(Window.partitionBy("finer").orderBy("time", *SOURCE, "row_id"))
    last = words.where(F.col("finer") == cut["finer"]).withColumn("place", place).where(F.col("place") <= cut["left"])
    whole = words.where(F.col("finer") < cut["finer"])
    return whole.select("row_id", "copy").unionByName(last.select("row_id", "copy")).groupBy("row_id", "copy").agg(F.count("*").alias("more"))


def queued(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, repeats: int = 2) -> DataFrame:
    """documents -> one row per row with its source's size and target and its copies (copy, start, finish, taken).

    ``start`` and ``finish`` are virtual times. Sources in the order of their code points, null last, take the
    weights in turn. A null text has no words; texts without words and empty sources get 0. Ties in the hash
    go by doc_id and size; a null doc_id queues by the hash of its text; repeated rows stand in the queue each. Words that finish
    at the same time go by source. An empty table gives an empty result.
    """
    stages = Stages(ready(docs.sparkSession))
    return _queued(stages.put("mixing-sizes", sized(docs, F.monotonically_increasing_id().alias("row_id"))), stages, weights, percent, repeats).drop("row_id")


def _queued(rows: DataFrame, stages: Stages, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, repeats: int = 2) -> DataFrame:
    """``queued`` from staged sizes; their ``row_id`` settles the ties of repeated rows and is kept."""
    ranges = rows.groupBy(*SOURCE, "range").agg(F.sum("size").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy(*SOURCE).orderBy("range")) - F.col("in_range")
    ranges = ranges.select(*SOURCE, "range", before.alias("before_range"))
    goals = stages.put("mixing-goals", targets(rows, weights, percent, repeats))
    inside = F.sum("size").over(Window.partitionBy(*SOURCE, "range").orderBy("turn", "doc_id", "size", "text_hash", "row_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = stages.put("mixing-queue", rows.join(ranges, [*SOURCE, "range"]).withColumn("before", F.col("before_range") + inside).join(goals, SOURCE).select(
        "row_id", "doc_id", "text_hash", "origin", *SOURCE, "size", "source_size", "target", "before"))

    budget = goals.agg(F.sum(F.floor("target"))).first()[0] or 0
    begins = F.array(*[(F.col("before") + n * F.col("source_size")).cast("long") for n in range(repeats)])
    copies = placed.where("size > 0 AND target > 0").select("row_id", *SOURCE, "size", "target", F.posexplode(begins).alias("copy", "begin"))
    low, more = 0, None
    parts = 1 << min(MOST_RANGES.bit_length() - 1, (budget // RANGE_WORDS).bit_length())
    if budget:
        low, high = _between(copies, budget, parts, stages)
        more = stages.put("mixing-last-words", _last_words(copies, budget, parts, low, high, stages).groupBy("row_id").agg(
            *[F.sum(F.when(F.col("copy") == n, F.col("more"))).alias(f"more_{n}") for n in range(repeats)]))
        placed = placed.join(more, "row_id", "left")

    def copy(n: int) -> Column:
        start = F.col("before") + n * F.col("source_size")
        time = F.nullif(F.col("target"), F.lit(0.0))
        last = F.coalesce(F.col(f"more_{n}"), F.lit(0)) if more is not None else F.lit(0)
        return F.struct(F.lit(n + 1).alias("copy"), (start / time).alias("start"), ((start + F.col("size")) / time).alias("finish"),
                        (_sent(low / parts, start) + last).cast("long").alias("taken"))

    return placed.select("row_id", "doc_id", "text_hash", F.col("origin").alias("source"), "size", "source_size", "target",
                         F.array(*[copy(n) for n in range(repeats)]).alias("copies"))


def schedule(docs: DataFrame, **share) -> DataFrame:
    """The mix itself, range-sorted by virtual finish time: the copies (doc_id, text_hash, copy, start, finish, taken) with words in it."""
    return queued(docs, **share).select("doc_id", "text_hash", "source", F.inline("copies")).where("taken > 0").orderBy("finish", "source", "doc_id")


def mixed(docs: DataFrame, **share) -> DataFrame:
    """One row per document: size, source_size, target and the words that the mix takes, repeats counted."""
    return queued(docs, **share).select(
        "doc_id", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["taken"]).alias("taken"))


def mixed_documents(docs: DataFrame, **share) -> DataFrame:
    """The documents of the mix with their columns, one row per copy in it, and ``copy``, ``finish`` and ``taken``.

    Columns of the input with these three names are replaced. Nulls, ties, repeated rows and empty tables as in ``queued``;
    texts of any length keep their whole text, and ``taken`` says how many of its words the mix counts.
    """
    stages, added = Stages(ready(docs.sparkSession)), ("copy", "finish", "taken")
    rows = stages.put("mixing-rows", docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row_id")))
    sizes = stages.put("mixing-sizes", sized(rows.select("row_id", "doc.doc_id", "doc.text", "doc.source"), F.col("row_id")))
    copies = _queued(sizes, stages, **share).select("row_id", F.inline("copies")).where("taken > 0")
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in added]
    return rows.join(copies, "row_id").select(*kept, *added)
