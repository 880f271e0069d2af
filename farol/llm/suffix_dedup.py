"""Removal of long byte strings that an earlier document has: bucket-pointer refinement over the suffixes.

Two suffixes matter to each other only if their first ``length`` bytes are equal, so suffixes are put
into ever finer buckets until a bucket stands for that many bytes:

1. Buckets of q bytes: every suffix gets the identifier of its first 16 bytes. A suffix is listed
   under the least identifier at its offsets 0 .. length - 16, which equal strings share whatever
   document they are in; neighbouring suffixes mostly share it too, so a document lists few buckets.
2. A bucket of several documents is refined in the task that has it. Its suffixes are sorted by their first 8 bytes; a
   suffix then points to the start of its sub-bucket. From there on each bucket is sorted by the pointers that its
   suffixes have at a later offset: 8 bytes on for 16, 16 on for 32, and so on, the last step ending at exactly ``length``
   bytes. Pointers of a step are used by the next one for the suffixes before them, so nothing but the first 8 bytes is ever
   compared as text. Sub-buckets of one document alone are left as they are after every step. In what remains at the
   end, all suffixes but those of the first document are duplicates.
3. A very frequent bucket is refined over all machines instead: by one more shuffle on the identifiers for ``length`` bytes, which
   are pairs of identifiers at later offsets, too (two fingerprints of 64 bits, so that a string has one name everywhere).

Runs of suffixes are cut to ``2 * length``, so what a task holds of a bucket is bounded in bytes.

Stretches of text that are copied whole are settled before: a stretch between two content-defined
places whose bytes an earlier document has goes, with all strings that start in it, and leaves only
the earliest document's. Nothing is lost by that, as whatever equals a string of the later document
equals the earliest one's. So a group of copies, or a passage in a third of all documents, adds one row
per document and stretch; the joins on such keys may be split, and minima are pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready, texts
from farol.llm.textbytes import Rolling, as_long, mix, text_blocks

Q = 16  # bytes of the first buckets
FIRST = 8  # bytes by which the suffixes of a bucket are sorted first
BUCKET_ROWS = 50_000  # runs of suffixes that one task refines together
STRETCH = 128  # mean bytes between two content-defined places
_PAIR = np.uint64(0x9E3779B97F4A7C15)
LISTED = ["rank", "own"]  # what a list of buckets is kept by
ID = ["rank", "text_hash"]  # place of the document in the order, and its text: a document's identity


def ranked(docs: DataFrame) -> DataFrame:
    """Documents with their place in the order (their doc_id; null comes last) and a hash of their text."""
    return texts(docs).select(
        "doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("rank"), F.xxhash64("text").alias("text_hash"), "text",
        # tells documents without an id apart where lists are made
        F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("own"))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then starts[1], ..."""
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(int(counts.sum()))


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the places 0 .. size - 1 lie in one of the ranges."""
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _known(batch: pa.RecordBatch, row: int, end: int, offsets: np.ndarray, column: str):
    """Text number and values of the lists in a column of the rows."""
    lists = batch.column(column)[row:end]
    counts = np.nan_to_num(np.array(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    return np.repeat(np.arange(end - row), counts), lists.flatten()


def _ranges(batch, row, end, offsets, column):
    """Starts and ends, in the block, of the settled suffixes that a row lists."""
    owner, values = _known(batch, row, end, offsets, column)
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = offsets[owner] + values.field("start").to_numpy()
    return starts, starts + values.field("suffixes").to_numpy()


def _open(size: int, offsets: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of at least ``length`` bytes."""
    room = np.diff(offsets) - length + 1
    full = room > 0
    return _covered(size, offsets[:-1][full], offsets[:-1][full] + room[full])


def _runs(wanted: np.ndarray, label: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the longest runs of wanted places with one label; none crosses texts."""
    edge = np.zeros(len(wanted) + 1, bool)
    edge[offsets[offsets <= len(wanted)]] = True
    new = wanted.copy()
    new[1:] &= ~wanted[:-1] | (label[1:] != label[:-1]) | edge[1:len(wanted)]
    starts = np.flatnonzero(new)
    stop = ~wanted | new
    last = np.append(np.flatnonzero(stop), len(wanted))
    ends = last[np.searchsorted(last, starts, "right")]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _pieces(starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut to at most ``most`` places."""
    count = -(-(ends - starts) // most)
    part = _spread(np.zeros(len(count), np.int64), count)
    first = np.repeat(starts, count) + part * most
    return first, np.minimum(first + most, np.repeat(ends, count)), np.repeat(owner, count)


def _stretches(length: int):
    """Stretches between content-defined places, by the bytes that their suffixes' strings cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                one, two = Rolling(data, 1), Rolling(data, 2)
                place = np.zeros(len(data), np.int64)
                grams = one.grams(Q)
                place[:len(grams)] = grams < np.uint64((1 << 64) // STRETCH)
                starts, ends, owner = _runs(_open(len(data), offsets, length), np.cumsum(place), offsets)
                stop = ends + length - 1
                size = (ends - starts).astype(np.uint64)
                yield _rows(batch, row, owner, {
                    "k1": as_long(mix(one.ranges(starts, stop) + size)), "k2": as_long(mix(two.ranges(starts, stop) + size)),
                    "start": pa.array(starts - offsets[owner]), "suffixes": pa.array(ends - starts)})

    return run


def _rows(batch: pa.RecordBatch, row: int, owner: np.ndarray, columns: dict) -> pa.RecordBatch:
    """Rows of texts with the identity of their documents."""
    at = pa.array(owner + row)
    return pa.RecordBatch.from_pydict({k: batch.column(k).take(at) for k in ID} | columns)


def _least(data: np.ndarray, length: int) -> np.ndarray:
    """Of every suffix, the least identifier of its buckets of q bytes at the offsets 0 .. length - q."""
    least, span, wanted = Rolling(data, 1).grams(Q), 1, length - Q + 1
    while span < wanted:
        step = min(span, wanted - span)
        least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
        span += step
    return np.concatenate([least, np.zeros(len(data) - len(least), np.uint64)])


def _buckets(length: int):
    """The buckets of q bytes under which a document's unsettled suffixes are listed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                wanted = _open(len(data), offsets, length) & ~_covered(len(data), *_ranges(batch, row, end, offsets, "settled"))
                least = _least(data, length)
                starts, _, owner = _pieces(*_runs(wanted, least, offsets), 2 * length)
                at = pa.array(owner + row)
                yield pa.RecordBatch.from_arrays([batch.column("rank").take(at), batch.column("own").take(at), as_long(least[starts])], [*LISTED, "bucket"])

    return run


def _shared(length: int):
    """Runs of unsettled suffixes in buckets that other documents list too, with the bytes that their strings cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                wanted = _open(len(data), offsets, length) & ~_covered(len(data), *_ranges(batch, row, end, offsets, "settled"))
                least = _least(data, length)
                owner, listed = _known(batch, row, end, offsets, "buckets")
                pairs = mix(listed.field("bucket").to_numpy().view(np.uint64) + mix(owner.astype(np.uint64)))
                order = np.argsort(pairs)
                pairs, hot = pairs[order], listed.field("hot").to_numpy(zero_copy_only=False)[order]
                starts, ends, owner = _pieces(*_runs(wanted, least, offsets), 2 * length)
                mine = mix(least[starts] + mix(owner.astype(np.uint64)))
                at = np.minimum(np.searchsorted(pairs, mine), len(pairs) - 1)
                keep = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
                starts, ends, owner, hot = starts[keep], ends[keep], owner[keep], hot[at[keep]]
                size = ends - starts + length - 1
                cut, edges = _spread(starts, size), np.concatenate([[0], np.cumsum(size)])
                for k in range(0, len(starts), 1 << 15):
                    part, some = slice(k, k + (1 << 15)), edges[k:k + (1 << 15) + 1]
                    blob = pa.Array.from_buffers(pa.large_binary(), len(some) - 1, [
                        None, pa.py_buffer((some - some[0]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[cut[some[0]:some[-1]]]))])
                    yield _rows(batch, row, owner[part], {
                        "bucket": as_long(least[starts[part]]), "hot": pa.array(hot[part]), "start": pa.array(starts[part] - offsets[owner[part]]),
                        "bytes": blob.cast(pa.binary())})

    return run


def _refined(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Identifiers of the buckets of ``length`` bytes: pairs of finer and finer identifiers at later offsets."""
    names, depth = Rolling(data, seed).grams(Q), Q
    while depth < length:
        step = min(depth, length - depth)
        names = mix(mix(names[:-step] * _PAIR) + names[step:]) if len(names) > step else names[:0]
        depth += step
    return names


def _strings(length: int):
    """Every suffix of the runs with its refined bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("bytes"), 1 << 18):
                places = np.flatnonzero(_open(len(data), offsets, length))
                owner = np.searchsorted(offsets, places, "right") - 1
                shift = batch.column("start")[row:end].to_numpy()
                yield _rows(batch, row, owner, {
                    "k1": as_long(_refined(data, length, 1)[places]), "k2": as_long(_refined(data, length, 2)[places]),
                    "start": pa.array(shift[owner] + places - offsets[owner])})

    return run


def _duplicates(rows: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Runs of suffixes whose refined bucket has an earlier document, for rows that hold whole buckets.

    ``pointer`` is, for every place, the start of its bucket in the sorted order so far. A large bucket is held whole, so what
    is kept for every byte has 32 bits, and ranks are numbered anew.
    """
    _, _, data, offsets = next(text_blocks(rows.column("bytes"), 1 << 62))
    rank = np.repeat(np.unique(rows.column("rank").to_numpy(), return_inverse=True)[1].astype(np.int32), np.diff(offsets))
    left = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))  # bytes up to the end of the run
    left -= np.arange(len(data), dtype=np.int32)
    pointer, depth = np.zeros(len(data), np.int32), FIRST
    live = np.flatnonzero(left >= FIRST).astype(np.int32)
    key = np.zeros(len(data), np.uint64)
    for k in range(FIRST):
        key <<= np.uint64(8)
        key[:len(data) - k] |= data[k:]
    if len(live) < len(key):
        key = key[live]
    live, start = _sorted(live, key)
    pointer[live] = start
    del key
    while True:
        # of each bucket, the first and the last document
        edge = np.flatnonzero(np.append(True, start[1:] != start[:-1])) if len(live) else live
        size = np.diff(np.append(edge, len(live)))
        first = np.repeat(np.minimum.reduceat(rank[live], edge), size) if len(live) else live
        if depth == length:
            break
        last = np.repeat(np.maximum.reduceat(rank[live], edge), size) if len(live) else live
        step = min(depth, length - depth)
        live = live[(first < last) & (left[live] >= depth + step)]
        del first, last, start
        # within a bucket, by the pointer at the later offset; new pointers stay below the next bucket's
        key = pointer[live].astype(np.uint64)
        key <<= np.uint64(32)
        key |= pointer[live + np.int32(step)].astype(np.uint64)
        live, start = _sorted(live, key, pointer[live])
        pointer[live] = start
        del key
        depth += step
    later = np.zeros(len(data), bool)
    later[live[rank[live] > first]] = True
    starts, ends, owner = _runs(later, np.zeros(len(data), np.int8), offsets)
    shift = rows.column("start").to_numpy()
    return _rows(rows, 0, owner, {"start": pa.array(shift[owner] + starts - offsets[owner]), "suffixes": pa.array(ends - starts)})


def _sorted(places: np.ndarray, key: np.ndarray, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their key, and where the bucket of equal keys starts; within its former bucket, which starts at ``base``."""
    order = np.argsort(key)
    places, key = places[order], key[order]
    at = np.arange(len(places), dtype=np.int32)

    def since(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, at, 0))

    new = np.ones(len(places), bool)
    new[1:] = key[1:] != key[:-1]
    del key
    if base is None:
        return places, since(new)
    base = base[order]
    outer = np.ones(len(places), bool)
    outer[1:] = base[1:] != base[:-1]
    return places, base + since(new) - since(outer)


def _grouped(length: int):
    """Rows in the order of buckets -> duplicate runs; a bucket is held until it is complete."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            if not len(bucket):
                continue
            # rows before the last bucket of this batch complete what is held
            ready_rows = int(np.searchsorted(bucket, bucket[-1], "left"))
            if ready_rows or (held and held[-1].column("bucket")[0].as_py() != bucket[0]):
                yield _duplicates(pa.concat_batches([*held, batch.slice(0, ready_rows)]), length)
                held = []
            held.append(batch.slice(ready_rows))
        if held:
            yield _duplicates(pa.concat_batches(held), length)

    return run


def _cut(length: int):
    """Texts without their duplicate bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_blocks(batch.column("text")):
                starts, ends = _ranges(batch, row, end, offsets, "settled")
                gone = _covered(len(data), starts, ends + length - 1)
                spans, _, span_owner = _runs(gone, np.zeros(len(data), np.int8), offsets)
                kept = data[~gone].tobytes()
                removed = np.concatenate([[0], np.cumsum(gone)])[offsets]
                rest = offsets - removed
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id")[row:end], "text_hash": batch.column("text_hash")[row:end],
                    "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(removed)),
                    "n_spans": pa.array(np.bincount(span_owner, minlength=end - row)),
                    "kept": pa.array([kept[a:b] for a, b in zip(rest, rest[1:])], pa.binary())})

    return run


def _later(rows: DataFrame, *kept: str) -> DataFrame:
    """Rows with an earlier document in their bucket (k1, k2)."""
    first = rows.groupBy("k1", "k2").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first < last")
    return rows.join(first.drop("last"), ["k1", "k2"]).where("rank > first").select(*ID, *kept)


def _listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(*ID).agg(F.collect_list(value).alias(name))


def _with(docs: DataFrame, lists: DataFrame) -> DataFrame:
    return docs.join(lists, ID, "left")


def removed(docs: DataFrame, length: int = 50, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """documents -> (doc_id, text_hash, n_bytes, n_removed, n_spans, kept), one row per row.

    Every byte goes that lies in a string of ``length`` bytes which also starts in a document with a
    smaller doc_id; ``kept`` is what is left of the UTF-8 bytes, ``n_spans`` counts the longest removed runs.
    Strings are judged on the input, never cross documents, and repeat freely within one document. Texts
    that are null, empty or shorter than ``length`` lose nothing. Rows with the same doc_id do not
    count as earlier for one another; a null doc_id is later than all others. An empty table gives an
    empty result. ``length`` is at least 16. Buckets with more than ``bucket_rows`` runs are refined over all machines. ``text_hash`` tells apart texts with the same doc_id.
    """
    spark = ready(docs.sparkSession)
    stages, docs = Stages(spark), ranked(docs)
    span = F.struct("start", "suffixes")
    ident = "rank long, text_hash long"
    stretches = stages.put("suffix-stretches", docs.mapInArrow(
        _stretches(length), f"{ident}, k1 long, k2 long, start long, suffixes long"))
    settled = stages.put("suffix-settled", _listed(_later(stretches, "start", "suffixes"), span, "settled"))
    stages.drop("suffix-stretches")

    per_bucket = Window.partitionBy("bucket")
    listed = _with(docs.drop("doc_id"), settled).mapInArrow(_buckets(length), "rank long, own long, bucket long")
    several = listed.withColumn("first", F.min("rank").over(per_bucket)).withColumn("last", F.max("rank").over(per_bucket)).withColumn(
        "hot", F.count("*").over(per_bucket) > bucket_rows).where("first < last")
    buckets = stages.put("suffix-buckets", several.groupBy(*LISTED).agg(F.collect_set(F.struct("bucket", "hot")).alias("buckets")))
    any_hot = not buckets.where(F.exists("buckets", lambda b: b["hot"])).isEmpty()

    wanted = _with(docs.drop("doc_id"), settled).join(buckets, LISTED)
    runs = wanted.mapInArrow(_shared(length), f"{ident}, bucket long, hot boolean, start long, bytes binary")
    spans = settled.select(*ID, F.inline("settled"))
    in_bucket = runs.where("not hot").drop("hot").repartition("bucket").sortWithinPartitions("bucket")
    spans = spans.unionByName(in_bucket.mapInArrow(_grouped(length), f"{ident}, start long, suffixes long"))
    if any_hot:
        strings = runs.where("hot").select(*ID, "start", "bytes").mapInArrow(_strings(length), f"{ident}, k1 long, k2 long, start long")
        spans = spans.unionByName(_later(strings, "start").withColumn("suffixes", F.lit(1).cast("long")))
    spans = stages.put("suffix-spans", _listed(spans, span, "settled"))
    stages.drop("suffix-buckets", "suffix-settled")
    return _with(docs, spans).mapInArrow(
        _cut(length), "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """``removed`` with the SHA-256 of the kept bytes in place of the bytes."""
    return removed(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` with their texts cut; all rows and columns stay, ``n_chars`` is counted anew where there is one.

    Bytes of a character that is only partly removed go with it.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([None if b is None else b.decode("utf-8", "ignore") for b in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), text], ["__id", "__hash", "__kept"])

    cut = removed(docs, length).where("n_removed > 0").select("doc_id", "text_hash", "kept").mapInArrow(
        decode, "__id long, __hash long, __kept string").dropDuplicates(["__id", "__hash"])
    joined = docs.join(cut, docs["doc_id"].cast("long").eqNullSafe(cut["__id"]) & (F.xxhash64(docs["text"]) == cut["__hash"]), "left")
    text = F.coalesce(cut["__kept"], docs["text"])
    changed = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])
