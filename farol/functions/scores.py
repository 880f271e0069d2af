"""Scores of text pairs: token n-gram precision (BLEU) and vector cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two equally long number arrays; null when one has length 0 or norm 0."""
    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)

    def product(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))

    norms = F.sqrt(total(product(a, a))) * F.sqrt(total(product(b, b)))
    return F.try_divide(total(product(a, b)), norms)


def _marked_grams(words: Column, n: int, mark: int) -> Column:
    """All runs of n words as numbers: 63 bits of their hash, and the mark as the last bit."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.shiftleft(F.xxhash64(F.slice(words, i, n)), 1).bitwiseOR(F.lit(mark)))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _shared_grams(a: Column, b: Column, n: int) -> Column:
    """Number of n-grams that two texts share, each as often as it stands in both.

    Both texts' n-grams lie sorted in one array, so equal ones are neighbours, and one pass counts them.
    """
    grams = F.sort_array(F.concat(_marked_grams(a, n, 0), _marked_grams(b, n, 1)))
    start = F.struct(F.lit(None).cast("bigint").alias("gram"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("shared"))

    def step(s: Column, x: Column) -> Column:
        gram, second = F.shiftright(x, 1), F.shiftrightunsigned(F.shiftleft(x, 63), 63).cast("int")
        same = s["gram"].eqNullSafe(gram)
        return F.struct(gram.alias("gram"), (F.when(same, s["a"]).otherwise(0) + 1 - second).alias("a"), (F.when(same, s["b"]).otherwise(0) + second).alias("b"),
                        (s["shared"] + F.when(same, 0).otherwise(F.least(s["a"], s["b"]))).alias("shared"))

    return F.aggregate(grams, start, step, lambda s: s["shared"] + F.least(s["a"], s["b"]))


def bleu(pairs: DataFrame, keys: list[str], reference: str, candidate: str, name: str = "score") -> DataFrame:
    """BLEU-4 per pair, with the length-scaled smoothing of Chen and Cherry (2014), method 4; null for null text.

    A zero match count at order n becomes ``1 / (2**k * 5 / ln(length))`` over the n-gram
    count, where k numbers the zero orders; a candidate of one token keeps a plain zero. Each pair is scored in its
    row, nothing is shuffled; ``keys`` are kept beside the score.
    """
    def words(text: str) -> Column:
        return F.filter(F.split(text, r"\s+"), lambda w: w != "")

    rows = pairs.select(*keys, words(reference).alias("__r"), words(candidate).alias("__c"))
    joined = rows.select(
        *keys, F.size("__r").cast("double").alias("__lr"), F.size("__c").cast("double").alias("__lc"),
        F.col("__r").isNull().alias("__no_r"), F.col("__c").isNull().alias("__no_c"),
        *[F.coalesce(_shared_grams(F.col("__r"), F.col("__c"), n), F.lit(0)).alias(f"__m{n}") for n in range(1, 5)])
    logs, zeros = F.lit(0.0), F.lit(0)
    for n in range(1, 5):
        none, size = F.col(f"__m{n}") == 0, F.greatest(F.col("__lc") - (n - 1), F.lit(1.0))
        zeros = zeros + F.when(none, 1).otherwise(0)
        smooth = F.ln("__lc") / (F.pow(F.lit(2.0), zeros) * 5)
        logs = logs + 0.25 * F.ln(F.when(none, smooth).otherwise(F.col(f"__m{n}").cast("double")) / size)
    brevity = F.when(F.col("__lc") > F.col("__lr"), 1.0).otherwise(F.exp(1 - F.col("__lr") / F.col("__lc")))
    lost = F.greatest(*[F.when(F.col(f"__m{n}") == 0, 1).otherwise(0) for n in range(1, 5)]) == 1
    score = F.when(F.col("__no_r") | F.col("__no_c"), F.lit(None)).when(
        (F.col("__m1") == 0) | (lost & (F.col("__lc") <= 1)), 0.0).otherwise(brevity * F.exp(logs))
    return joined.select(*keys, score.cast("double").alias(name))
