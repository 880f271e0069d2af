"""Exact near-duplicate classes by Jaccard similarity of word shingles: universe partition and the pigeonhole principle.

A set's shingles are dealt by their hashes to the m segments of its size band. If two sets are at
least ``percent`` similar and the smaller has s shingles, at most H(s) shingles belong to only one
of them. So when the smaller set is given H(s) + 1 units over its segments, there is a segment
in which the two differ by fewer shingles than its units: none for one unit (the segment's subsets
are equal), at most one for two units (equal, or one subset is the other without one shingle:
the one-deletion neighbourhood). Every set can use any units: one in each segment and a second one
in a few designated segments, for which one-deletion neighbourhoods are indexed.

Units are allocated by cost, the number of sets that a unit would make candidates. First every
index key links its members to the most central of them (whose keys have the most members), the best such
link of each set is verified and components are formed: sets of one component need no further comparison,
so a key whose members are all in one component costs nothing. Only sets without enough free units take the cheapest of the
others. A candidate pair is passed on for verification only if the parity sketches of its sets (for
each of 1,024 bins, whether it has an odd number of shingles) differ in no more bins than similar sets may
differ in shingles, which drops no similar pair. Every pair that links different components is thus found,
while a group of n copies costs about n verifications.

Nodes are distinct shingle sets, named by a 64-bit fingerprint, so copies of a text, repeated rows
and rows without a doc_id need no care of their own: they have the node of their set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready, texts
from farol.llm.components import components
from farol.llm.exact_dedup import marked
from farol.llm.textbytes import Rolling, as_long, mix, shingles, text_blocks

_HALF = np.uint64(32)
BINS = 1024
SIZES = ["n_shingles", "needed", "segments", "designated"]
OWN, DELETED = 1, 2  # flags of a key: of the set's own size band; of a subset without one of its shingles


class Bands:
    """Size bands, each with its segments; a set's partners are in its band or the next smaller or larger one."""

    def __init__(self, percent: int, ratio: float = 1.5):
        self.percent = percent
        tops = [max(1, (percent - 1) // (100 - percent))]  # sets up to this size are similar only if equal
        while tops[-1] < 1 << 40:
            tops.append(max(int((tops[-1] + 1) * ratio), self.largest(tops[-1]) + 1))
        self.tops = np.array(tops)
        self.segments = self.differing(self.tops) + 1
        self.designated = np.minimum(self.segments, np.maximum(2, self.segments // 24))

    def differing(self, size):
        """Shingles that the smaller set of a similar pair and its partner may not share."""
        return size * (100 - self.percent) // self.percent

    def largest(self, size):
        """Size of the largest partner."""
        return size * 100 // self.percent

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes, "left")


def _sets(percent: int, shingle: int):
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                owner, value, _ = shingles(data, offsets, shingle)
                sizes = np.bincount(owner, minlength=end - row)
                band = bands.of(sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[row:end], batch.column("text_hash")[row:end], pa.array(sizes), pa.array(_nodes(owner, value, sizes).view(np.int64), mask=sizes == 0),
                    pa.array(np.where(sizes > bands.tops[0], bands.differing(sizes) + 1, 0)),
                    pa.array(bands.segments[band]), pa.array(bands.designated[band]), _sketches(owner, value, end - row)],
                    ["doc_id", "text_hash", "n_shingles", "node", "needed", "segments", "designated", "sketch"])

    return run


def _sketches(owner: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    """Parities of the shingles in each bin, as longs."""
    counts = np.bincount(owner * BINS + (value & np.uint64(BINS - 1)).astype(np.int64), minlength=rows * BINS)
    longs = np.packbits((counts & 1).astype(np.uint8)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(longs) + 1, BINS // 64, dtype=np.int32)), pa.array(longs))


def _nodes(owner: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each shingle set."""
    sums = np.zeros(len(sizes), np.uint64)
    np.add.at(sums, owner, mix(value + np.uint64(0x51ED27)))
    return mix(sums * np.uint64(0xD6E8FEB86659FD93) + sizes.astype(np.uint64))


def _keys(percent: int, shingle: int):
    """Index keys of each text's set: the subset in every segment of its band and of the next smaller band within reach."""
    bands = Bands(percent)

    def keys(band: np.ndarray, use: np.ndarray, owner, value, own: int):
        segments = np.where(use, bands.segments[band], 0)
        first = np.cumsum(segments) - segments
        mine = use[owner]
        owner, value = owner[mine], value[mine]
        part = ((value >> _HALF) * segments[owner].astype(np.uint64) >> _HALF).astype(np.int64)
        slot, weight = first[owner] + part, mix(value + np.uint64(0x9D5C07))
        sums = np.zeros(int(segments.sum()), np.uint64)
        np.add.at(sums, slot, weight)
        who = np.repeat(np.arange(len(band)), segments)
        seat = np.arange(len(sums)) - first[who]
        salt = mix((band[who].astype(np.uint64) << _HALF) + seat.astype(np.uint64) + np.uint64(1))
        yield who, mix(sums + salt), seat * 4 + own
        less = part < bands.designated[band][owner]
        slot, who = slot[less], owner[less]
        yield who, mix(sums[slot] - weight[less] + salt[slot]), part[less] * 4 + own + DELETED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                owner, value, _ = shingles(data, offsets, shingle)
                sizes = np.bincount(owner, minlength=end - row)
                node, band = _nodes(owner, value, sizes), bands.of(sizes)
                below = np.maximum(band - 1, 0)
                for at, use, own in ((band, band > 0, OWN), (below, (below > 0) & (sizes <= bands.largest(bands.tops[below])), 0)):
                    for who, key, meta in keys(at, use, owner, value, own):
                        for k in range(0, len(who), 1 << 17):
                            part = slice(k, k + (1 << 17))
                            yield pa.RecordBatch.from_arrays(
                                [as_long(key[part]), as_long(node[who[part]]), pa.array(meta[part].astype(np.int32))], ["key", "node", "meta"])

    return run


def _similar(percent: int, shingle: int):
    """Pairs of texts -> whether they are similar, from the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for row, end, data, offsets in text_blocks(batch.column("text_a")):
                owner, value, _ = shingles(data, offsets, shingle)
                size = np.bincount(owner, minlength=end - row)
                for low, high, data_b, offsets_b in text_blocks(batch.column("text_b")[row:end]):
                    other, value_b, _ = shingles(data_b, offsets_b, shingle)
                    size_b = np.bincount(other, minlength=high - low)
                    mine = (owner >= low) & (owner < high)
                    who, what = np.concatenate([owner[mine] - low, other]), np.concatenate([value[mine], value_b])
                    order = np.lexsort((what, who))
                    who, what = who[order], what[order]
                    both = np.bincount(who[1:][(who[1:] == who[:-1]) & (what[1:] == what[:-1])], minlength=high - low)
                    union = size[low:high] + size_b - both
                    linked[row + low:row + high] = (union > 0) & (100 * both >= percent * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, shingle: int, stages: Stages, name: str) -> DataFrame:
    """The linked ones of the node pairs (a, b). Each node's text is fetched once, from its first document."""
    pairs = stages.put(f"{name}-pairs", pairs)
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = wanted.join(nodes.select("node", "first_doc", "first_text"), "node")
    found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["first_doc"]) & (F.xxhash64(docs["text"]) == wanted["first_text"]))
    found = stages.put(f"{name}-texts", found.select("node", "text").dropDuplicates(["node"]))
    both = pairs.join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(
        found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    links = both.mapInArrow(_similar(percent, shingle), "a long, b long, linked boolean").where("linked").select("a", "b")
    links = stages.put(f"{name}-links", links)
    stages.drop(f"{name}-pairs", f"{name}-texts")
    return links


def _remaining(shared: DataFrame, stars: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """Candidates between different components that the cheapest sufficient units of the smaller set leave."""
    def labelled(df, column, name):
        return df.join(labels.select(F.col("node").alias(column), F.col("label").alias(name)), column, "left").withColumn(
            name, F.coalesce(name, column))

    apart = labelled(labelled(stars.select("node", "hub"), "node", "label"), "hub", "hub_label")
    apart = stages.put("jaccard-apart", apart.where("label != hub_label").select("node", "hub"))
    mixed = shared.join(apart, ["node", "hub"], "left_semi").select("key").distinct()
    rows = labelled(shared.join(mixed, "key", "left_semi").select("key", "node", "meta").distinct(), "node", "label")
    rows = stages.put("jaccard-mixed", rows.join(nodes.select("node", *SIZES), "node").select(
        "key", "node", "label", *SIZES, F.expr("meta >> 2").alias("seat"),
        F.expr(f"(meta & {OWN}) != 0").alias("own"), F.expr(f"(meta & {DELETED}) != 0").alias("deleted")))

    # costs: members of other components that each unit would meet
    whole, less = F.sum(F.expr("cast(not deleted as bigint)")), F.sum(F.expr("cast(deleted as bigint)"))
    by_label = rows.groupBy("key", "label").agg(whole.alias("whole_in"), less.alias("less_in"))
    by_key = by_label.groupBy("key").agg(F.sum("whole_in").alias("whole_all"), F.sum("less_in").alias("less_all"))
    own = rows.where("own").join(by_key, "key").join(by_label, ["key", "label"])
    costs = own.groupBy("node", "seat").agg(
        *[F.first(c).alias(c) for c in SIZES],
        F.sum(F.expr("if(deleted, 0, whole_all - whole_in)")).alias("first_cost"),
        F.sum(F.expr("if(deleted, whole_all - whole_in, less_all - less_in)")).alias("second_cost"))
    items = costs.select("node", "seat", *SIZES, F.expr(
        "inline(array(struct(1 AS unit, first_cost AS cost), struct(2 AS unit, greatest(first_cost, second_cost) AS cost)))"))
    # a segment that is not designated has no second unit: there only equal subsets were indexed
    items = items.where("cost > 0 and (unit = 1 or seat < designated)")
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("cost", "unit", "seat"))).withColumn(
        "costly", F.count("*").over(Window.partitionBy("node")))
    chosen = ranked.where("rank <= needed - (segments + designated - costly)").select("node", "seat", "unit")

    sketches = nodes.select("node", "sketch")
    small = rows.where("own").join(chosen, ["node", "seat"]).join(sketches, "node").select(
        "key", F.col("node").alias("small"), F.col("label").alias("small_label"), F.col("n_shingles").alias("size"), F.col("deleted").alias("cut"), "unit",
        F.col("sketch").alias("small_sketch"))
    small = stages.put("jaccard-chosen", small)
    large = rows.join(small.select("key").distinct(), "key", "left_semi").select("key", "node", "label", "n_shingles", "deleted").join(sketches, "node")
    # sets of a + b shingles share at least percent / (100 + percent) of them if they are similar
    differing = " + ".join(f"bit_count(small_sketch[{k}] ^ sketch[{k}])" for k in range(BINS // 64))
    allowed = f"size + n_shingles - 2 * (((size + n_shingles) * {percent} + {99 + percent}) div {100 + percent})"
    met = small.join(large, "key").where(
        f"label != small_label and n_shingles >= size and n_shingles * {percent} <= size * 100 and not (cut and deleted)"
        f" and if(cut or deleted, unit = 2, unit = 1) and {differing} <= {allowed}")
    return met.select(F.least("small", "node").alias("a"), F.greatest("small", "node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id, text_hash, stays), one row per row.

    Two documents link when 100 * shared shingles >= percent * all their shingles; ``component_id`` is the
    least doc_id reachable by links, the document's own included. ``percent`` is above 50 and below 100.
    Words are runs without white space, A-Z as a-z; a text with fewer words than ``shingle`` has one shingle,
    its whole sequence. Null, empty and blank texts have no shingle and link with nothing: their component is
    their own id. Repeated rows and copies link. A null doc_id links like any other and gets the least id of its
    component, null if there is none. ``stays`` marks the first document of each component. An empty table gives an
    empty result. Shingles are compared by 64-bit fingerprints.
    """
    spark = ready(docs.sparkSession)
    stages, docs = Stages(spark), texts(docs)
    sets = stages.put("jaccard-sets", docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _sets(percent, shingle), "doc_id long, text_hash long, n_shingles long, node long, needed long, segments long, designated long, sketch array<long>"))
    nodes = stages.put("jaccard-nodes", sets.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), *[F.first(c).alias(c) for c in (*SIZES, "sketch")]).select(
        "node", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_text"), *SIZES, "sketch"))

    per_key = Window.partitionBy("key")
    # keys of one document per set: the others are passed over in the scan
    firsts = nodes.select(F.col("first_doc").alias("doc_id"), F.col("first_text").alias("text_hash"))
    chosen = marked(docs.withColumn("text_hash", F.xxhash64("text")), firsts, "doc_id", "text_hash").where("again").select(*docs.columns)
    keys = chosen.mapInArrow(_keys(percent, shingle), "key long, node long, meta int")
    met = stages.put("jaccard-met", keys.withColumn("least", F.min("node").over(per_key)).withColumn("most", F.max("node").over(per_key)).withColumn(
        "members", F.count("*").over(per_key)).where("least < most").groupBy("key", "node", "meta").agg(F.first("members").alias("members")))
    weights = met.groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = met.join(weights, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    shared = stages.put("jaccard-shared", met.drop("members").join(hubs, "key"))
    stages.drop("jaccard-met")

    # one verified link for every set: to the hub of its keys that it meets most often
    stars = stages.put("jaccard-stars", shared.where("node != hub").groupBy("node", "hub").agg(
        F.sum(F.expr(f"if((meta & {DELETED}) = 0, 1, 0)")).alias("times")))
    best = stars.groupBy("node").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub")).select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = _verified(best, nodes, docs, percent, shingle, stages, "jaccard-first")
    labels = components(links, stages, "jaccard-near")

    rest = _verified(_remaining(shared, stars, labels, nodes, percent, stages), nodes, docs, percent, shingle, stages, "jaccard-rest")
    labels = components(links.unionByName(rest), stages, "jaccard-all")
    stages.keep("jaccard-sets", "jaccard-all")

    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"), F.min(place).alias("first"))
    alone = F.col("label").isNull()
    return named.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"),
        "text_hash", (alone | (place == F.col("first"))).alias("stays"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """The rows and columns of ``docs``, of each component only its first document by doc_id (null last) and text hash.

    Repeated rows leave one; documents without a shingle (null, empty) stay, one of each doc_id and text. Columns of any name are kept.
    """
    stays = near_duplicates(docs, percent, shingle).where("stays").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    # the row travels as one value, so no column of it can clash
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.xxhash64(docs["text"].cast("string")).alias("text_hash"),
                       docs["doc_id"].cast("long").alias("doc_id"))
    rows = rows.join(stays, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text_hash"]).select("doc.*")
