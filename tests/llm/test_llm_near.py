from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import rows
from samples import LONG, documents, prose  # noqa: F401

from farol.llm.common import Stages, ready
from farol.llm.components import components
from farol.llm.jaccard import Bands, near_duplicates, without_near_duplicates

def sets_of(text, n):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def classes(docs, percent, n):
    """Least id of each component by comparing every pair."""
    sets = {i: sets_of(t, n) for i, t in docs}
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                least[max(x, y)] = min(x, y)
    return sorted(((i, len(sets[i]), top(i)) for i in sets), key=repr)


def edited(text, share, rnd):
    return " ".join(w if rnd.random() > share else rnd.choice("qrst") * 5 for w in text.split())


@pytest.mark.parametrize(("percent", "n"), [(85, 4), (80, 5), (60, 2)])
def test_classes_equal_those_of_all_pairs(spark, documents, prose, percent, n):
    rnd, docs = random.Random(percent), []
    for base in range(12):
        text = prose(rnd.choice([5, 8, 14, 40, 90, 300]), base)
        docs += [edited(text, rnd.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06, 0.1]), rnd) for _ in range(14)]
    docs = list(enumerate(docs))
    got = near_duplicates(documents(docs), percent, n)
    assert rows(got.select("doc_id", "n_shingles", "component_id")) == classes(docs, percent, n)


def test_odd_rows(spark, documents, prose):
    text = prose(60, 1)
    docs = documents([(5, text), (5, text), (3, text.upper()), (None, text), (None, "alone here"), (8, None), (9, ""), (10, " \t\n"), (11, "One two"),
                      (2, "one TWO"), (12, LONG), (13, LONG + "x")])
    got = rows(near_duplicates(docs, 85, 4).select("doc_id", "n_shingles", "component_id"))
    n = len(sets_of(text, 4))
    assert got == sorted([(5, n, 3), (5, n, 3), (3, n, 3), (None, n, 3), (None, 1, None), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 1, 2), (2, 1, 2),
                          (12, 5, 12), (13, 6, 13)], key=repr)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [2, 3, 8, 9, 10, 12]
    assert near_duplicates(docs.limit(0), 85, 4).count() == 0
    named = docs.select("doc_id", "text", docs["key"].alias("__doc_id"), docs["label"].alias("__text_hash"))
    assert {(r["__doc_id"], r["__text_hash"]) for r in without_near_duplicates(named).collect()} == {("k", "l")}


def test_bands_give_the_smaller_set_enough_units():
    bands = Bands(85)
    for size in range(1, 3000):
        band = bands.of(np.array([size]))[0]
        if band:
            assert bands.differing(size) + 1 <= bands.segments[band] + bands.designated[band]
        partner = bands.of(np.array([bands.largest(size)]))[0]
        assert partner - band in (0, 1)


def test_components(spark):
    stages = Stages(ready(spark))
    chain = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(7, 7), (3, 2)]
    got = dict(rows(components(spark.createDataFrame(chain, "a long, b long"), stages, "t")))
    assert all(got[i] == 0 for i in range(41)) and got[100] == 50 and got[79] == 50
    assert components(spark.createDataFrame([], "a long, b long"), stages, "e").count() == 0
