"""Quality rules: counted base rules, and bands of perplexity per language under a smoothed n-gram model.

The model is a modified Kneser-Ney model of three bytes, counted by Spark over the different
texts of a language that pass the base rules, then again over those of them in the band, and smoothed with DataFrame operations. Its probabilities and back-off weights lie in arrays
sorted by the hash of the n-gram. Every byte but the digits is a class of its own, so a language has at most CLASSES ** 3
trigrams (about 6 million of them can stand in UTF-8) whatever the input: that bounds what is broadcast. Many languages are scored in blocks
whose models together have at most ``MODEL_ROWS`` entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready
from farol.llm.textbytes import Rolling, mix, text_blocks, words

#: Entries of the models that are broadcast together (12 bytes each); a single language always fits in a block of its own.
MODEL_ROWS = 4_000_000

#: Bytes of texts that are taken together: small, so that the arrays of a block stay in the processor's caches.
BLOCK = 1 << 18

#: Counts that a counting task holds before it passes them on, summed by language and trigram.
PENDING = 1 << 19

SYMBOLS = b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Every byte by itself, lead and control bytes too; only the digits are one, as the value of a number says nothing of a language."""
    kind = np.arange(256)
    kind[48:58] = 48
    return (np.unique(kind, return_inverse=True)[1] + 1).astype(np.int32)  # codes of three classes fit in 32 bits, too


CLASS_OF = _classes()
CLASSES = int(CLASS_OF.max()) + 1  # 0 stands before the text


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram code that ends at each byte."""
    last = CLASS_OF[data]
    starts = offsets[:-1][np.diff(offsets) > 0]
    middle, first = np.zeros_like(last), np.zeros_like(last)
    middle[1:], first[2:] = last[:-1], last[:-2]
    middle[starts] = 0
    first[starts] = 0
    first[starts[starts + 1 < len(first)] + 1] = 0
    return (first * CLASSES + middle) * CLASSES + last


def _latest(codes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Place of the last equal code, for each code. ``seen`` is a scratch array with a place for every code, whatever it holds."""
    seen[codes] = np.arange(len(codes), dtype=np.int32)
    return seen[codes]


def _of_lang(langs: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[str, np.ndarray | slice]]:
    """Each language of the texts, and where its bytes are."""
    found = sorted(set(langs))
    for lang in found:
        yield lang, slice(None) if len(found) == 1 else np.repeat(langs == lang, np.diff(offsets))


def _summed(pending: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    for lang, parts in pending.items():
        gram, n = (np.concatenate(column) for column in zip(*parts))
        order = np.argsort(gram)
        gram = gram[order]
        first = np.flatnonzero(np.diff(gram, prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(gram[first].astype(np.int64)),
                                          pa.array(np.add.reduceat(n[order], first))], ["lang", "gram", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending, held = {}, 0
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, end, data, offsets in text_blocks(batch.column("text"), BLOCK):
            codes = _grams(data, offsets)
            for lang, of in _of_lang(langs[row:end], offsets):
                mine = np.sort(codes[of])
                if len(mine):
                    first = np.flatnonzero(np.diff(mine, prepend=-1))
                    pending.setdefault(lang, []).append((mine[first], np.diff(first, append=len(mine))))
                    held += len(first)
            if held > PENDING:
                yield from _summed(pending)
                pending, held = {}, 0
    yield from _summed(pending)


def _smoothed(counts: DataFrame, lower: DataFrame | None, order: int) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, n) -> probabilities (lang, gram, p) and weights (lang, gram, weight) of the lower order by context."""
    def those(k: int) -> Column:
        return F.count(F.when(F.col("n") == k, 1))

    few = counts.groupBy("lang").agg(*[those(k).alias(f"t{k}") for k in (1, 2, 3, 4)])
    share = F.expr("t1 / nullif(t1 + 2 * t2, 0)")
    discounts = few.select("lang", *[
        F.least(F.greatest(F.coalesce(k - (k + 1) * share * F.col(f"t{k + 1}") / F.expr(f"nullif(t{k}, 0)"), F.lit(0.5)), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}")
        for k in (1, 2, 3)])
    counts = counts.join(discounts, "lang").withColumn("context", F.expr(f"gram div {CLASSES}")).withColumn(
        "discount", F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end"))
    contexts = counts.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("discount").alias("cut")).withColumn(
        "weight", F.expr("cut / total"))
    p = counts.join(contexts, ["lang", "context"])
    if lower is None:
        p = p.withColumn("rest", F.lit(1.0 / CLASSES))
    else:
        p = p.withColumn("suffix", F.expr(f"gram % {CLASSES ** (order - 1)}")).join(
            lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("rest")), ["lang", "suffix"])
    return (p.select("lang", "gram", F.expr("(n - discount) / total + weight * rest").alias("p")),
            contexts.select("lang", F.col("context").alias("gram"), "weight"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(lang, text_hash, text) of every different text of a language once; copies are reduced before they are dealt out."""
    return docs.groupBy("lang", "text_hash").agg(F.first("text").alias("text"))


def language_models(docs: DataFrame, stages: Stages) -> DataFrame:
    """(lang, text) -> (lang, kind, gram, value): log2 probabilities by order (1-3) and log2 back-off weights (4-6)."""
    three = stages.put("quality-counts", docs.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n")))
    # lower orders count the different classes before them, not occurrences
    two = three.groupBy("lang", F.expr(f"gram % {CLASSES ** 2}").alias("gram")).agg(F.count("*").alias("n"))
    one = two.groupBy("lang", F.expr(f"gram % {CLASSES}").alias("gram")).agg(F.count("*").alias("n"))
    parts, lower = [], None
    for order, counts in enumerate((one, two, three), 1):
        # each order is a small table before the next one reads it, so no plan holds the plans of all orders below
        lower, weights = (stages.put(f"quality-{name}-{order}", table) for name, table in zip(
            ("chances", "weights"), _smoothed(stages.put(f"quality-counts-{order}", counts) if order < 3 else counts, lower, order)))
        parts += [lower.select("lang", F.lit(order).alias("kind"), "gram", F.log2("p").alias("value")),
                  weights.select("lang", F.lit(order + 3).alias("kind"), "gram", F.log2("weight").alias("value"))]
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    model = stages.put("quality-model", model)
    stages.drop(*[f"quality-{name}-{order}" for order in (1, 2, 3) for name in ("chances", "weights")], "quality-counts-1", "quality-counts-2")
    return model


# A model is two arrays: the hashes of its n-grams, sorted, and their values. Broadcasts hold such plain pairs, so that
# workers can read them without this package.
Model = tuple[np.ndarray, np.ndarray]


def _key(kind, gram: np.ndarray) -> np.ndarray:
    return mix(gram.astype(np.uint64) * np.uint64(8) + np.asarray(kind, np.uint64))


def hashed_model(kind: np.ndarray, gram: np.ndarray, value: np.ndarray) -> Model:
    """Values sorted by the hash of their n-gram."""
    keys = _key(kind, gram)
    order = np.argsort(keys)
    return keys[order], value[order].astype(np.float32)


def _find(model: Model, kind: int, gram: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
    keys = _key(kind, gram)
    at = np.minimum(np.searchsorted(model[0], keys), len(model[0]) - 1)
    found = model[0][at] == keys
    return np.where(found, model[1][at], np.float32(default)), found


def model_bits(model: Model, gram: np.ndarray) -> np.ndarray:
    """-log2 of the probability of the last class of every trigram."""
    total, found = _find(model, 3, gram, 0)
    open_, rest = np.flatnonzero(~found), gram[~found]
    for order in (2, 1):
        weight, _ = _find(model, order + 4, rest // CLASSES, 0)
        rest = rest % CLASSES ** order
        p, found = _find(model, order, rest, 0)
        total[open_] += weight + np.where(found, p, 0)
        open_, rest = open_[~found], rest[~found]
    if len(rest):
        total[open_] += _find(model, 4, np.zeros(len(rest), np.int64), 0)[0] - np.float32(np.log2(CLASSES))
    return -total


def _sum_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def _repeated(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all values that a text has twice or more (others may be among them), in an order that has equal ones of
    a text side by side, and which of them equal the one before. Owners must ascend."""
    bits = max(10, (8 * len(value)).bit_length())
    slot = (value + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    # only values that share a slot with another one are sorted
    shared = np.zeros(1 << bits, bool)
    shared[slot[_latest(slot, np.empty(1 << bits, np.int32)) != np.arange(len(slot))]] = True
    order = np.flatnonzero(shared[slot])
    order = order[np.argsort(value[order], kind="stable")]
    a, b = owner[order], value[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, same


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words and words in repeated 3-word windows of each text: what the base rules ask for."""
    starts, ends, owner = words(data, offsets)
    return {"n_words": np.bincount(owner, minlength=len(offsets) - 1), "n_repeat_words": _repeat_words(Rolling(data), starts, ends, owner, len(offsets) - 1)}


def _repeat_words(rolling: Rolling, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    spelled = rolling.ranges(starts, ends)
    at = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    order, same = _repeated(owner[at], mix((spelled[at] * step + spelled[at + 1]) * step + spelled[at + 2] if len(at) else np.zeros(0, np.uint64)))
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = at[order[twice]]
    marked = np.zeros(len(owner), bool)
    for k in range(3):
        marked[hit + k] = True
    return np.bincount(owner[marked], minlength=texts)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, their code points, symbols, repeated lines and words in repeated 3-word windows of each text."""
    texts = len(offsets) - 1
    starts, ends, owner = words(data, offsets)
    n_words = np.bincount(owner, minlength=texts)
    rolling = Rolling(data)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80)

    breaks = np.flatnonzero(data == 10)
    low, high = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]]))
    lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=texts) + 1
    line_owner = np.repeat(np.arange(texts), lines)
    worded = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    order, same = _repeated(line_owner[worded], rolling.ranges(low[worded], high[worded]))
    dup_owner = line_owner[worded][order[same]]

    symbol = np.zeros(256, np.int8)
    symbol[list(SYMBOLS)] = 1
    return {"n_words": n_words, "word_chars": _sum_by_text(letters, offsets), "n_symbols": _sum_by_text(symbol[data], offsets),
            "n_dup_lines": np.bincount(dup_owner, minlength=texts), "n_repeat_words": _repeat_words(rolling, starts, ends, owner, texts)}


def _mean_bits(models: dict[str, Model], langs: np.ndarray, data: np.ndarray, offsets: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Mean bits per byte of each text; without a model of its language all classes are equally likely."""
    sizes, codes = np.diff(offsets), _grams(data, offsets)
    bits = np.zeros(len(data), np.float32)
    for lang, of in _of_lang(langs, offsets):
        if lang in models:
            # every different trigram of the block is looked up once
            mine = codes[of]
            latest = _latest(mine, seen)
            once = np.flatnonzero(latest == np.arange(len(mine)))
            value = np.empty(len(mine), np.float32)
            value[once] = model_bits(models[lang], mine[once])
            bits[of] = value[latest]
        else:
            bits[of] = np.log2(CLASSES)
    return np.round(_sum_by_text(bits.astype(np.float64), offsets) / np.maximum(sizes, 1), 4)


def _texts_at(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of some of the texts."""
    sizes = np.diff(offsets)
    return data[np.repeat(wanted, sizes)], np.concatenate([[0], np.cumsum(sizes[wanted])])


def _passed(batches: Iterator[pa.RecordBatch], min_words: int, max_repeat_percent: int, models=None):
    """Block by block: its rows, which of them pass the base rules, and the mean bits per byte of those."""
    seen = None if models is None else np.empty(CLASSES ** 3, np.int32)
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for row, end, data, offsets in text_blocks(batch.column("text"), BLOCK):
            base, mean = rule_counts(data, offsets), None
            good = (base["n_words"] >= min_words) & (100 * base["n_repeat_words"] <= max_repeat_percent * base["n_words"])
            if models is not None:
                mean = _mean_bits(models.value, langs[row:end][good], *_texts_at(data, offsets, good), seen)
            yield batch.slice(row, end - row), langs[row:end], good, mean


def _passing(min_words: int, max_repeat_percent: int, models=None, bands: dict[str, tuple[float, float]] | None = None):
    """The texts that pass the base rules and, with models, lie in the band of their language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, langs, good, mean in _passed(batches, min_words, max_repeat_percent, models):
            if models is not None and good.any():
                low, high = np.array([bands.get(lang, (np.inf, -np.inf)) for lang in langs[good]]).T
                good[good] = (mean >= low) & (mean <= high)
            yield rows.filter(pa.array(good))

    return run


def _rated(min_words: int, max_repeat_percent: int, models):
    """The mean bits per byte of the texts that pass the base rules and are not empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, good, mean in _passed(batches, min_words, max_repeat_percent, models):
            rows = rows.filter(pa.array(good))
            filled = pc.greater(pc.fill_null(pc.binary_length(rows.column("text")), 0), 0)
            yield pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("text_hash"), pa.array(mean)], ["lang", "text_hash", "bits"]).filter(filled)

    return run


def _score(models):
    """Base counts and the mean bits per byte of each text under the model of its language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.empty(CLASSES ** 3, np.int32)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for row, end, data, offsets in text_blocks(batch.column("text"), BLOCK):
                mean = _mean_bits(models.value, langs[row:end], data, offsets, seen)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id")[row:end], "text_hash": batch.column("text_hash")[row:end], "lang": batch.column("lang")[row:end]}
                    | {k: pa.array(v.astype(np.int64)) for k, v in base_counts(data, offsets).items()}
                    | {"filled": pa.array(np.diff(offsets) > 0), "bits": pa.array(mean)})

    return run


_SCORED = ("doc_id long, text_hash long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, filled boolean, bits double")


def _blocks(model: DataFrame, limit: int) -> list[list[str]]:
    """Languages, taken together while their models have at most ``limit`` entries."""
    blocks, room = [], 0
    for lang, n in sorted(tuple(r) for r in model.groupBy("lang").count().collect()):
        if not blocks or n > room:
            blocks.append([])
            room = max(limit, n)
        blocks[-1].append(lang)
        room -= n
    return blocks


def _by_model(docs: DataFrame, model: DataFrame, limit: int, job, schema: str, held: list) -> DataFrame:
    """``job`` of the broadcast models over all rows, a block of languages at a time; ``held`` gets the broadcasts."""
    spark, out = docs.sparkSession, None
    blocks = _blocks(model, limit) or [[]]
    for block in blocks:
        rows = model.where(F.col("lang").isin(block)).toPandas()
        loaded = spark.sparkContext.broadcast({
            lang: hashed_model(part["kind"].to_numpy(), part["gram"].to_numpy(), part["value"].to_numpy())
            for lang, part in rows.groupby("lang")})
        held.append(loaded)
        # languages without a model go with the first block
        mine = docs.where(~F.col("lang").isin([lang for other in blocks[1:] for lang in other]) if out is None else F.col("lang").isin(block))
        part = (docs if len(blocks) == 1 else mine).mapInArrow(job(loaded), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _bands(scored: DataFrame, width: float) -> DataFrame:
    """(lang, text_hash, bits) of texts that pass the base rules -> (lang, lower, upper) from the exact quartiles of the different ones."""
    # bits have four decimals, so a language has few different values
    once = scored.select("lang", "text_hash", "bits").distinct()
    by_value = once.groupBy("lang", "bits").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("bits")
    share = by_value.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    quartiles = share.groupBy("lang").agg(*[
        F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bits"))).alias(f"q{k}") for k in (1, 2, 3)])
    return quartiles.withColumn("step", F.greatest(F.expr("(q3 - q1) / 1.349"), F.expr("q2 * 0.01"))).select(
        "lang", (F.col("q2") - width * F.col("step")).alias("lower"), (F.col("q2") + width * F.col("step")).alias("upper"))


def judged(docs: DataFrame, width: float = 4.5, min_words: int = 50, max_repeat_percent: int = 50, model_rows: int = MODEL_ROWS,
           rounds: int = 1) -> DataFrame:
    """documents -> one row per row: the base counts, ``base_failed``, ``bits`` (mean bits per byte) and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of them in
    3-word windows that are found again in the text. ``kept``: not base_failed, and bits within ``width``
    robust deviations (quartile range / 1.349, at least 1 % of the median) of the median of the language.
    Model and band are those of its different texts that are not base_failed, once each; ``rounds`` times the model is
    counted again from those of them in the band, so that junk among them is not learned. Perplexity is 2 ** bits; a language
    whose texts are all base_failed has no model, and all byte classes are equally likely there. Null texts are empty: no words, 0 bits,
    base_failed. A null lang is a language of its own, named by the empty text. Repeated rows are counted and
    judged each; a null doc_id does not matter. An empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    stages = Stages(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    rules, found = (min_words, max_repeat_percent), "lang string, text_hash long, text string"
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    trained, held = docs.select("lang", "text_hash", "text").mapInArrow(_passing(*rules), found), []

    def release() -> None:
        while held:
            held.pop().destroy()

    texts = docs.select("lang", "text_hash", "text")
    for _ in range(rounds):
        model = language_models(distinct_texts(trained), stages)
        release()
        rated = _by_model(texts, model, model_rows, lambda models: _rated(*rules, models), "lang string, text_hash long, bits double", held)
        edges = {r["lang"]: (r["lower"], r["upper"]) for r in _bands(rated, width).collect()}
        release()
        trained = _by_model(texts, model, model_rows, lambda models: _passing(*rules, models, edges), found, held)
        stages.drop("quality-counts", "quality-model")
    model = language_models(distinct_texts(trained), stages)
    release()
    scored = stages.put("quality-scored", _by_model(docs, model, model_rows, _score, _SCORED, held).withColumn("base_failed", failed))
    release()
    stages.drop("quality-counts", "quality-model")
    bands = _bands(scored.where("filled and not base_failed"), width)
    return scored.join(bands, "lang", "left").withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("bits").between(F.col("lower"), F.col("upper")), F.lit(False))).select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "bits")


def kept_documents(docs: DataFrame, **rules) -> DataFrame:
    """The rows and columns of ``docs`` that the rules keep."""
    good = judged(docs, **rules).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lang").alias("__lang")).distinct()
    return docs.join(good, docs["doc_id"].cast("long").eqNullSafe(good["__id"]) & (F.xxhash64(docs["text"].cast("string")) == good["__hash"])
                     & (F.coalesce(docs["lang"].cast("string"), F.lit("")) == good["__lang"]), "left_semi")
