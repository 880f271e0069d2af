"""Fixtures of this folder, imported by its tests."""

from __future__ import annotations

import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 20_000  # a very long text


@pytest.fixture()
def documents(spark):
    """Rows (doc_id, text, lang, source) as a table with further columns whose names clash with the operators' own."""
    def make(rows):
        kind = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, key string, start int, taken string, node int"
        return spark.createDataFrame([(*(tuple(r) + (None,) * 4)[:4], None, "s", "l", "k", 1, "t", 2) for r in rows], kind).repartition(3)

    return make


@pytest.fixture()
def prose():
    """Reproducible words, few enough to repeat."""
    rnd = random.Random(7)
    stock = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(4000)]

    def make(n, seed):
        inner = random.Random(seed)
        return " ".join(inner.choice(stock) for _ in range(n))

    return make
