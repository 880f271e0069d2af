"""Language identification by compression: the dictionary that encodes a text best names its language.

For every language a raw-content zstandard dictionary is made from a sample of labelled texts that is
bounded by ``dictionary_bytes`` and ``sample_texts``; nothing else is learned. A text is encoded whole
with each dictionary, and a narrow margin between the two best is reported as not confident.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farol.llm.common import ready

LETTER = re.compile(r"[^\W\d_]")
#: What is encoded of a lower-case text: ASCII letters, other ASCII characters as separators, all else as it is.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(FOLDED).split())


#: Hashes of sampled texts that are broadcast at most (about 100 bytes each); a longer list is joined by a shuffle.
LISTED = 100_000


def dictionaries(labelled: DataFrame, dictionary_bytes: int, sample_texts: int, total_bytes: int) -> dict[str, bytes]:
    """(lang, text) -> bytes of each language's dictionary.

    The sample of a language is its ``sample_texts`` first different texts in the order of their hash; equal parts of
    them fill at most ``dictionary_bytes``. All dictionaries together have at most ``total_bytes``.
    """
    labelled = labelled.where("length(text) > 0").withColumn("turn", F.md5("text"))
    first = labelled.select("lang", "turn").distinct().withColumn(
        "n", F.row_number().over(Window.partitionBy("lang").orderBy("turn"))).where(F.col("n") <= sample_texts)
    counts = {r["lang"]: r["count"] for r in first.groupBy("lang").count().collect()}
    if not counts:
        return {}
    size = min(dictionary_bytes, total_bytes // len(counts))
    # what a text can give to a dictionary is cut off before anything is shuffled, and the sample's list is small
    longest = max(max(1, size // n) for n in counts.values())
    if sum(counts.values()) <= LISTED:
        first = F.broadcast(first)
    sample = labelled.select("lang", "turn", F.substring("text", 1, longest).alias("text")).join(first, ["lang", "turn"]).groupBy("lang", "turn").agg(
        F.min("text").alias("text"))
    parts: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for row in sorted(sample.select("lang", "turn", "text").collect()):  # ``sample_texts`` cut texts per language
        share = max(1, size // counts[row["lang"]])
        parts[row["lang"]].append(folded(row["text"][:share])[:share])
    return {lang: b"\n".join(some)[:size] for lang, some in parts.items()}


def _predict(shared, level: int, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sorted(shared.value)
        content = [zstandard.ZstdCompressionDict(shared.value[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k in langs]
        for part in content:
            part.precompute_compress(level=level)
        encoders = [zstandard.ZstdCompressor(level=level, dict_data=part, write_content_size=False) for part in content]
        for batch in batches:
            best, score, sure = [], [], []
            for text in batch.column("text").to_pylist():
                if not langs or text is None or not LETTER.search(text):
                    best.append("und")
                    score.append(0.0)
                    sure.append(False)
                    continue
                data = folded(text)
                sizes = np.array([len(e.compress(data)) for e in encoders])
                order = np.argsort(sizes, kind="stable")
                gap = 1 - sizes[order[0]] / sizes[order[1]] if len(langs) > 1 else 1.0
                best.append(langs[order[0]])
                score.append(float(gap))
                sure.append(bool(gap >= margin))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "confident"])

    return run


def predicted_languages(docs: DataFrame, held_out: int = 2, folds: int = 4, dictionary_bytes: int = 200_000, sample_texts: int = 256,
                        total_bytes: int = 16 << 20, level: int = 3, margin: float = 0.02) -> DataFrame:
    """documents -> (doc_id, held_out, lang_pred, score, confident), one row per row.

    Dictionaries are learned from the documents with a lang whose crc32(doc_id as text) mod ``folds`` is not ``held_out``;
    a null doc_id counts as the empty text. ``score`` is the share of bytes that the best dictionary saves against the
    second; a score below ``margin`` rejects the answer as not ``confident``. Equal sizes go to the first language
    by name. Null texts and texts without a letter, and all texts if nothing could be learned, are ``und`` with score 0.
    Repeated rows are predicted each. An empty table gives an empty result.
    """
    spark = ready(docs.sparkSession)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    learned = dictionaries(rows.where("not held_out and lang is not null").select("lang", "text"), dictionary_bytes, sample_texts, total_bytes)
    shared = spark.sparkContext.broadcast(learned)
    return rows.drop("lang").mapInArrow(
        _predict(shared, level, margin), "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")
