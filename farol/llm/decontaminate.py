"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, then banded alignment.

An item of m characters that occurs in a document with at most e edits shares at least
m - q + 1 - q * e q-grams with the place, and these lie on diagonals (document place minus item place)
that are at most e apart from the place's. Each item takes the q of floor(m / (e + 1)), 12 at most, so the lemma
tells at its full budget. Diagonals are cut into half bands of e + 1; two neighbours make a band, and bands overlap
by half, so one band holds all shared q-grams of a place. Bands with enough of them are kept, neighbouring ones together,
and verified by aligning the whole item with the document around them. Items without a budget (e = 0) are looked for whole.
Texts are compared in lower case (A-Z) with single spaces.

The items are the stated query set: they are held against all documents in blocks of at most
``BLOCK_BYTES`` of item text, which bounds what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready, texts
from farol.llm.textbytes import BLANK, LOWER, Rolling, text_blocks

Q = 12
BLOCK_BYTES = 4 << 20
#: Shared q-grams that are counted at a time, and diagonals that are aligned at a time.
HITS, DIAGONALS = 1 << 20, 1 << 16
SCREEN = np.uint64(42)  # 2^22 bits say which fingerprints an item can have


def normalized(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with runs of white space as one space, their text offsets, and the place of each byte before."""
    blank = BLANK[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    place = np.flatnonzero(keep)
    out = np.where(blank, np.uint8(32), LOWER[data])[place]
    return out, np.searchsorted(place, offsets), place


def item_index(rows: list[tuple[int, str]], percent: int) -> dict:
    """The items and, by q, their q-grams in the order of their fingerprints, as plain arrays.

    A q-gram that an item repeats is kept once or twice per half band of the item: by its first and last place there.
    Which half band of diagonals a place of the text has with a place of the item depends on these two alone, so
    a text place meets at most two entries per half band, however often the item repeats itself.
    """
    texts_, ids = [], []
    for item, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        part = normalized(data, np.array([0, len(data)]))[0] if len(data) else data
        filled = np.flatnonzero(part != 32)
        if len(filled):
            texts_.append(part[filled[0]:filled[-1] + 1])
            ids.append(item)
    length = np.array([len(t) for t in texts_], np.int64)
    edits = length * percent // 100
    q = np.where(edits > 0, np.minimum(Q, length // (edits + 1)), length)
    by_q = {}
    for size in map(int, np.unique(q)):
        entries = []
        for i in map(int, np.flatnonzero(q == size)):
            gram = Rolling(texts_[i]).grams(size)
            place = np.arange(len(gram))
            half = place // (edits[i] + 1)
            order = np.lexsort((place, half, gram))
            gram, place, half = gram[order], place[order], half[order]
            edge = np.ones(len(gram) + 1, bool)
            edge[1:-1] = (gram[1:] != gram[:-1]) | (half[1:] != half[:-1])
            ends = edge[:-1] | edge[1:]
            entries.append((gram[ends], np.full(int(ends.sum()), i), place[ends]))
        gram, item, place = (np.concatenate(c) for c in zip(*entries))
        order = np.argsort(gram, kind="stable")
        screen = np.zeros(1 << 22, bool)
        screen[(gram >> SCREEN).astype(np.int64)] = True
        by_q[size] = gram[order], item[order], place[order], screen
    return {"ids": ids, "texts": texts_, "length": length, "edits": edits, "needed": length - q + 1 - q * edits, "by_q": by_q}


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most ``edits``), start and end of a place in ``text`` that aligns with the whole item on the diagonals low .. high.

    Row i of the table holds, for diagonal d, the cost of aligning the first i bytes of the item with a stretch that ends
    at place i + d. Ties take the earliest end and the latest start.
    """
    low, high = low - edits, high + edits
    d = np.arange(low, high + 1)
    far = edits + 1
    cost = np.where((d >= 0) & (d <= len(text)), 0, far)
    start = d.copy()
    for i in range(1, len(item) + 1):
        at = i + d - 1
        inside = (at >= 0) & (at < len(text))
        differs = np.where(inside, text[np.clip(at, 0, len(text) - 1)] != item[i - 1], True)
        step = np.where(inside, cost + differs, far)
        begin = start.copy()
        skip = np.append(cost[1:] + 1, far)  # an item byte that the text lacks
        skip[(i + d < 0) | (i + d > len(text))] = far
        better = skip < step
        step[better], begin[better] = skip[better], np.append(start[1:], 0)[better]
        # text bytes that the item lacks: least of step[k] + distance, carried along the row
        reach = step - np.arange(len(d))
        best = np.minimum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == best, np.arange(len(d)), 0))
        more = best + np.arange(len(d))
        carried = (more < step) & inside
        step, begin = np.where(carried, more, step), np.where(carried, begin[source], begin)
        cost, start = np.minimum(step, far), begin
        if cost.min() > edits:
            return None
    k = int(np.argmin(cost))
    return int(cost[k]), int(start[k]), len(item) + int(d[k])


def _found(shared):
    """Documents -> the best place of every item in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            for row, end, raw, raw_offsets in text_blocks(batch.column("text")):
                data, offsets, place = normalized(raw, raw_offsets)
                rows = _matches(items, data, offsets)
                if rows:
                    owner, item, edits, low, high = (np.array(c, np.int64) for c in zip(*rows))
                    ends = np.append(place, len(raw))
                    at = pa.array(owner + row)
                    yield pa.RecordBatch.from_arrays([
                        batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array([items["ids"][i] for i in item], pa.int64()),
                        pa.array(edits), pa.array(place[offsets[owner] + low] - raw_offsets[owner]),
                        pa.array(np.minimum(ends[offsets[owner] + high - 1] + 1, raw_offsets[owner + 1]) - raw_offsets[owner])],
                        ["doc_id", "text_hash", "item_id", "edits", "start", "end"])

    return run


def _spots(grams: np.ndarray, q: int, offsets: np.ndarray, entry: tuple) -> tuple[np.ndarray, ...]:
    """Places of the texts whose q bytes some item has: place, text, first entry and number of entries."""
    gram, _, _, screen = entry
    spots = np.flatnonzero(screen[(grams >> SCREEN).astype(np.int64)])
    owner = np.searchsorted(offsets, spots, "right") - 1
    whole = spots + q <= offsets[owner + 1]
    spots, owner = spots[whole], owner[whole]
    first, last = np.searchsorted(gram, grams[spots], "left"), np.searchsorted(gram, grams[spots], "right")
    some = last > first
    return spots[some], owner[some], first[some], (last - first)[some]


def _hits(spots, owner, first, count, entry, offsets) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, item, place in the text and place in the item of shared q-grams, at most about HITS at a time."""
    _, item, place, _ = entry
    upto = np.cumsum(count)
    low = 0
    while low < len(spots):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + HITS, "right")))
        c = count[low:high]
        hit = np.repeat(first[low:high] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        o = np.repeat(owner[low:high], c)
        yield o, item[hit], np.repeat(spots[low:high], c) - offsets[o], place[hit]
        low = high


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _band_counts(owner, item, spot, place, edits: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, half band, text places that share a q-gram there), sorted."""
    band = np.floor_divide(spot - place, edits[item] + 1)
    order = np.lexsort((spot, band, item, owner))
    owner, item, band, spot = owner[order], item[order], band[order], spot[order]
    once = _groups(owner, item, band, spot)
    owner, item, band = owner[once], item[once], band[once]
    start = _groups(owner, item, band)
    return owner[start], item[start], band[start], np.diff(np.append(start, len(owner)))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of several parts together; a text place is in one part only."""
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    owner, item, band, n = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((band, item, owner))
    owner, item, band, n = owner[order], item[order], band[order], n[order]
    start = _groups(owner, item, band)
    return owner[start], item[start], band[start], np.add.reduceat(n, start)


def _runs(owner, item, band, n, index: dict) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first and last diagonal) of neighbouring bands that share enough q-grams."""
    if not len(owner):
        return
    joined = n.copy()
    next_ = (owner[1:] == owner[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1)
    joined[:-1] += np.where(next_, n[1:], 0)
    kept = np.flatnonzero(joined >= index["needed"][item])
    if not len(kept):
        return
    owner, item, band = owner[kept], item[kept], band[kept]
    half = index["edits"][item] + 1
    new = np.ones(len(kept), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 2)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(kept)) - 1
    for a, z in zip(start, last):
        low, high = int(band[a] * half[a]), int((band[z] + 2) * half[z]) - 1
        for at in range(low, high + 1, DIAGONALS):
            yield int(owner[a]), int(item[a]), at, min(high, at + DIAGONALS - 1)


def _matches(index: dict, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of the best place of each item in each text, the first of equal ones."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    rolling = Rolling(data)
    for q, entry in index["by_q"].items():
        found = _spots(rolling.grams(q), q, offsets, entry)
        if not len(found[0]):
            continue
        inexact = []
        for owner, item, spot, place in _hits(*found, entry, offsets):
            whole = np.flatnonzero(index["edits"][item] == 0)
            whole = whole[np.lexsort((spot[whole], item[whole], owner[whole]))]
            for k in whole[_groups(owner[whole], item[whole])] if len(whole) else []:
                best.setdefault((int(owner[k]), int(item[k])), (0, int(spot[k]), int(spot[k]) + q))
            if len(whole) < len(item):
                more = index["edits"][item] > 0
                inexact.append(_band_counts(owner[more], item[more], spot[more], place[more], index["edits"]))
        for o, i, low, high in _runs(*_summed(inexact), index):
            edits = int(index["edits"][i])
            text = data[offsets[o]:offsets[o + 1]]
            base = max(0, low - edits)
            window = text[base:high + int(index["length"][i]) + 2 * edits + 1]
            result = aligned(index["texts"][i], window, low - base, high - base, edits)
            if result and ((o, i) not in best or result[0] < best[o, i][0]):
                best[o, i] = result[0], result[1] + base, result[2] + base
    return [(o, i, *place) for (o, i), place in best.items()]


def _item_blocks(benchmark: DataFrame, stages: Stages, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``limit`` characters; a longer item is a block of its own."""
    block, room = [], limit
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text is not null and item_id is not null").distinct()
    for row in stages.put("benchmark-items", rows).toLocalIterator():
        if block and len(row["text"]) > room:
            yield block
            block, room = [], limit
        block.append((row["item_id"], row["text"]))
        room -= len(row["text"])
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_hash, item_id, edits, start, end): the best place of each benchmark item in each document that holds it.

    An item occurs where it aligns with at most ``percent`` % of its length in edits, as a string, also inside words; places
    are bytes of the document's text, the first of those with the fewest edits. Only pairs that occur have rows. Items without
    a character, or with a null text or id, are not looked for; of items with one id each text is looked for. Null and empty documents
    hold none; very long ones are searched whole, a stretch of diagonals at a time. Repeated rows give one row each; a null doc_id
    stays null. Empty tables give an empty result; further columns are ignored.
    """
    spark = ready(docs.sparkSession)
    stages, rows = Stages(spark), texts(docs).withColumn("text_hash", F.xxhash64("text"))
    out = None
    for block in _item_blocks(benchmark, stages, block_bytes):
        shared = spark.sparkContext.broadcast(item_index(block, percent))
        part = rows.mapInArrow(_found(shared), "doc_id long, text_hash long, item_id long, edits long, start long, end long")
        out = part if out is None else out.unionByName(part)
    stages.keep()
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows and columns of ``docs`` without any benchmark item."""
    held = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(held, docs["doc_id"].cast("long").eqNullSafe(held["__id"]) & (F.xxhash64(docs["text"].cast("string")) == held["__hash"]), "left_anti")
