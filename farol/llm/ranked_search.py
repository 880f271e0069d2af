"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are indexed in blocks, where the scan reads them: no text is shuffled. A block's grid has a row per term
and a column per document (by doc_id); a point holds the impact of the term there. A quadtree over the grid keeps
for each cell the maximum of its impacts, in breadth-first order: a byte says which quadrants of a cell hold points,
their cells follow by counting the quadrants before them, and a cell with a single point is a leaf that keeps the rest
of its place. Rows are sorted by their maximum, which keeps the maxima of cells close to those of their rows.

An item's terms are row paths. They descend jointly over halves of document ranges, best first: the bound of a range is
the sum over the terms of weight times the maximum of the cell that its path has reached. Ranges whose bound cannot
reach the best documents found are never opened, so the result is exact. The best of each block are ranked over all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready, texts
from farol.llm.textbytes import LOWER, Rolling, text_blocks, words

#: Bytes that belong to no term: ASCII but for digits and letters.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:0x80] = True
for _kept in (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"):
    SEPARATOR[list(_kept)] = False

#: A block ends with the document that brings it to so many points.
BLOCK_POINTS = 1 << 20
#: Items are searched for together up to so many terms, which is what the driver and a task hold of them.
ITEM_TERMS = 1 << 17
#: Bytes of a Parquet row group of an index, a block at least: what a task holds of the blocks it writes or reads.
GROUP_BYTES = 1 << 24
#: Document ranges opened at a time.
OPENED = 128

INDEX = "docs binary, terms binary, grid_rows binary, holders binary, quadrants binary, maxima binary, rest binary, depth int"
#: Leaves keep at most 16 levels of their place in 32 bits.
REST_LEVELS = 16

_COUNT = np.array([bin(v).count("1") for v in range(16)], np.int32)
#: Quadrants before a quadrant, by the byte of a cell.
_BEFORE = np.array([[bin(v & ((1 << q) - 1)).count("1") for q in range(4)] for v in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of a 32-bit number on the even places of a 64-bit one."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, fingerprint and number of occurrences of the distinct terms of each text, and the terms of each text."""
    starts, ends, text = words(data, offsets, SEPARATOR)
    h = Rolling(LOWER[data]).ranges(starts, ends)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return text[first], h[first], np.diff(np.append(first, len(h))), np.bincount(text, minlength=len(offsets) - 1)


class Grid:
    """K2-treap of one block."""

    def __init__(self, docs, terms, grid_rows, holders, quadrants, maxima, rest, depth: int):
        self.docs, self.terms, self.grid_rows, self.holders = docs, terms, grid_rows, holders
        self.quadrants, self.maxima, self.rest, self.depth = quadrants, maxima, rest, depth
        # a block's cells are counted in 32 bits
        self.first = np.cumsum(_COUNT[quadrants], dtype=np.int32)
        self.first -= _COUNT[quadrants]
        self.first += 1
        self.leaf = np.cumsum(quadrants == 0, dtype=np.int32)
        self.leaf -= 1

    @staticmethod
    def build(docs: np.ndarray, column: np.ndarray, h: np.ndarray, impact: np.ndarray) -> Grid:
        """From document ids by column, and column, term and impact of every point."""
        terms, term, holders = np.unique(h, return_inverse=True, return_counts=True)
        highest = np.zeros(len(terms), np.int64)
        np.maximum.at(highest, term, impact.astype(np.int64))
        grid_rows = np.empty(len(terms), np.int64)
        grid_rows[np.argsort(-highest, kind="stable")] = np.arange(len(terms))
        depth = int(max(len(terms), len(docs), 2) - 1).bit_length()
        code = _spread(grid_rows[term]) << np.uint64(1) | _spread(column)
        order = np.argsort(code)
        code, impact = code[order], impact[order].astype(np.uint32)
        del order, term, column, h
        maxima, rests, quadrants = [], [], []
        for level in range(depth + 1):
            if not len(code):
                break
            below = np.uint64(2 * (depth - level))
            prefix = code >> below
            start = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            size = np.diff(np.append(start, len(code)))
            alone = (size == 1) & (level >= depth - REST_LEVELS)
            maxima.append(np.maximum.reduceat(impact, start))
            rests.append((code[start[alone]] & ((np.uint64(1) << below) - np.uint64(1))).astype(np.uint32))
            # a cell with more points has those quadrants in which the next level has a cell
            bits = np.zeros(len(start), np.uint8)
            if level < depth:
                quadrant = (np.uint8(1) << ((code >> (below - np.uint64(2))) & np.uint64(3)).astype(np.uint8)).astype(np.uint8)
                bits = np.where(alone, np.uint8(0), np.bitwise_or.reduceat(quadrant, start)).astype(np.uint8)
            quadrants.append(bits)
            stay = np.repeat(~alone, size)
            code, impact = code[stay], impact[stay]
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return Grid(docs, terms, grid_rows.astype(np.uint32), holders.astype(np.uint32), join(quadrants, np.uint8),
                    join(maxima, np.uint32), join(rests, np.uint32), depth)

    def stored(self) -> tuple:
        return (*[a.tobytes() for a in (self.docs, self.terms, self.grid_rows, self.holders, self.quadrants, self.maxima, self.rest)], self.depth)

    @staticmethod
    def load(docs, terms, grid_rows, holders, quadrants, maxima, rest, depth) -> Grid:
        kinds = (np.int64, np.uint64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32)
        return Grid(*[np.frombuffer(b, k) for b, k in zip((docs, terms, grid_rows, holders, quadrants, maxima, rest), kinds)], depth)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of terms in the block's list of terms, -1 where it has none."""
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == h, at, -1) if len(self.terms) else np.full(len(h), -1)

    def _reach(self, cells: np.ndarray, spread: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Cells that a row path has just reached, without leaves whose point lies in another row."""
        lone = (cells >= 0) & (self.quadrants[cells] == 0)
        if lone.any():
            at, row = np.nonzero(lone)
            low = ((np.uint64(1) << (2 * (self.depth - level[at])).astype(np.uint64)) - np.uint64(1)) & np.uint64(0xAAAAAAAAAAAAAAAA)
            other = (self.rest[self.leaf[cells[at, row]]].astype(np.uint64) ^ spread[row]) & low != 0
            cells[at[other], row[other]] = -1
        return cells

    def best(self, h: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the ``k`` documents with the highest scores above 0, equal scores by column."""
        at = self.find(h)
        held = (at >= 0) & (weight > 0)
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not held.any():
            return columns, scores
        row, weight = self.grid_rows[at[held]].astype(np.int64), weight[held]
        spread = _spread(row) << np.uint64(1)
        level, place = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = self._reach(np.zeros((1, len(row)), np.int64), spread, level)
        bound = ((cells >= 0) * weight * self.maxima[cells]).sum(1)
        while len(bound):
            if len(scores) >= k:
                last, least = scores[k - 1], columns[k - 1]
                useful = (bound > last) | ((bound == last) & (place << (self.depth - level) < least))
                level, place, cells, bound = level[useful], place[useful], cells[useful], bound[useful]
                if not len(bound):
                    break
            chosen = np.zeros(len(bound), bool)
            chosen[np.argpartition(-bound, OPENED)[:OPENED] if len(bound) > OPENED else slice(None)] = True
            c, lv, pl = cells[chosen], level[chosen], place[chosen]
            below = self.depth - 1 - lv
            byte = self.quadrants[c]
            lone = byte == 0
            own = np.where(lone, self.rest[self.leaf[c]].astype(np.int64) >> (2 * below)[:, None] & 1, 0)
            upper = (row[None, :] >> below[:, None] & 1) << 1
            parts = []
            for half in (0, 1):
                q = upper + half
                child = np.where(c < 0, -1, np.where(lone, np.where(own == half, c, -1), np.where(
                    byte >> q & 1, self.first[c] + _BEFORE[byte, q], -1)))
                new = self._reach(np.where(lone, -1, child), spread, lv + 1)
                child = np.where(lone, child, new)
                value = ((child >= 0) * weight * self.maxima[child]).sum(1)
                some = value > 0
                parts.append((lv[some] + 1, 2 * pl[some] + half, child[some], value[some]))
            level, place, cells, bound = (np.concatenate([a[~chosen], *[p[i] for p in parts]]) for i, a in enumerate((level, place, cells, bound)))
            done = level == self.depth
            if done.any():
                columns, scores = np.append(columns, place[done]), np.append(scores, bound[done])
                order = np.lexsort((columns, -scores))[:k]
                columns, scores = columns[order], scores[order]
                level, place, cells, bound = level[~done], place[~done], cells[~done], bound[~done]
        return columns, scores


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = total = 0
        for _, _, data, offsets in text_blocks(batch.column("text")):
            _, _, text = words(data, offsets, SEPARATOR)
            n, total = n + len(np.unique(text)), total + len(text)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["n", "total"])


def _impacts(tf: np.ndarray, n: np.ndarray, holding: int, total: int) -> np.ndarray:
    """Impact of terms with ``tf`` occurrences in documents of ``n`` terms."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 90 + 90 * n * holding // total))


def _indexed(holding: int, total: int, block_points: int):
    def grid(parts: list) -> Grid:
        docs, sizes = np.concatenate([p[0] for p in parts]), np.cumsum([0, *[len(p[0]) for p in parts]])
        column = np.concatenate([p[1] + at for p, at in zip(parts, sizes)])
        order = np.argsort(docs, kind="stable")
        place = np.empty(len(docs), np.int64)
        place[order] = np.arange(len(docs))
        h, impact = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        parts.clear()
        return Grid.build(docs[order], place[column], h, impact)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.binary()) for c in INDEX.split(", ")])
        parts, points = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(grid(parts).stored(), schema)], schema=schema)

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in text_blocks(batch.column("text")):
                text, h, tf, n = _terms(data, offsets)
                text, impact = text.astype(np.int32), _impacts(tf, n[text], holding, total).astype(np.uint32)
                upto = np.cumsum(np.bincount(text, minlength=high - low))
                row = at = 0
                while row < high - low:
                    # up to the document that fills the block
                    stop = min(int(np.searchsorted(upto, at + block_points - points)) + 1, high - low)
                    end = int(upto[stop - 1])
                    parts.append((ids[low + row:low + stop], text[at:end] - row, h[at:end], impact[at:end]))
                    points += end - at
                    row, at = stop, end
                    if points >= block_points:
                        yield block()
                        parts, points = [], 0
        if points:
            yield block()

    return work


#: A null doc_id is this number in an index, behind all others.
NO_ID = (1 << 63) - 1


def build_index(docs: DataFrame, stages: Stages, block_points: int = BLOCK_POINTS) -> tuple[DataFrame, int]:
    """documents -> blocks of the index as a table, and the number of documents with a term.

    Every row is indexed, whole. Rows without a term (null, empty) are in no grid; repeated rows have columns of their own.
    """
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    counted = rows.select("text").mapInArrow(_count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    holding, total = counted["n"] or 0, counted["total"] or 0
    # Parquet looks at the size of a row group after a hundred rows, unless it is told to; a row is a block here
    groups = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    return stages.put("search-index", rows.mapInArrow(_indexed(holding, max(1, total), block_points), INDEX), **groups), holding


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[Grid]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Grid.load(*[batch.column(c.split()[0])[i].as_buffer() for c in INDEX.split(", ")[:-1]], batch.column("depth")[i].as_py())


def _holders(wanted: np.ndarray):
    """Documents of each block that hold the wanted terms."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, holders = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("terms", np.uint64), ("holders", np.uint32)))
                _, a, b = np.intersect1d(wanted, terms, assume_unique=True, return_indices=True)
                total[a] += holders[b]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int64()), pa.array(total[total > 0])], names=["term", "holders"])

    return work


def _searched(items: list[tuple[int, np.ndarray, np.ndarray]], k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grid in _grids(batches):
            found = [(number, *grid.best(h, weight, k)) for number, h, weight in items]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)),
                pa.array(np.concatenate([grid.docs[f[1]] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                names=["number", "doc_id", "score"])

    return work


def search(index: DataFrame, holding: int, items: DataFrame, stages: Stages, k: int = 10, item_terms: int = ITEM_TERMS) -> DataFrame:
    """The ``k`` documents with the highest scores for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Equal scores are ranked by doc_id, null last. Repeated item_ids, null ones too, are ranked each by themselves;
    items without a term, or without a document, have no rows. Items are taken in blocks of ``item_terms`` terms.
    """
    rows = stages.put("search-items", items.select(F.col("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number")))
    results, block, size = [], [], 0

    def run() -> None:
        wanted = np.unique(np.concatenate([h for _, h in block]))
        held = np.zeros(len(wanted), np.int64)
        for r in index.select("terms", "holders").mapInArrow(_holders(wanted), "term long, holders long").groupBy("term").agg(
                F.sum("holders").alias("holders")).collect():
            held[r["term"]] = r["holders"]
        weight = np.array([math.floor(1000 * math.log((2 * holding + 2) / (2 * int(n) + 1))) if n else 0 for n in held], np.int64)
        queue = [(number, h, weight[np.searchsorted(wanted, h)]) for number, h in block]
        best = index.mapInArrow(_searched(queue, k), "number long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "doc_id"))
        results.append(stages.put(f"search-best-{len(results)}", best.withColumn("rank", rank).where(F.col("rank") <= k)))

    for r in rows.select("number", "text").toLocalIterator():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        h = np.unique(_terms(data, np.array([0, len(data)]))[1])
        block.append((r["number"], h))
        size += len(h)
        if size >= item_terms:
            run()
            block, size = [], 0
    if block:
        run()
    kind = "number long, doc_id long, score long, rank int"
    found = reduce(DataFrame.unionByName, results) if results else index.sparkSession.createDataFrame([], kind)
    return found.join(rows.drop("text"), "number").select(
        "item_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_points: int = BLOCK_POINTS, item_terms: int = ITEM_TERMS) -> DataFrame:
    """Index ``docs`` and search it for every item. Empty tables give an empty result; further columns are ignored."""
    stages = Stages(ready(docs.sparkSession))
    index, holding = build_index(docs, stages, block_points)
    return search(index, holding, items, stages, k, item_terms)
