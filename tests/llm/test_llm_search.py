from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from samples import LONG, documents, prose  # noqa: F401

from farol.llm import ranked_search
from farol.llm.common import Stages, ready
from farol.llm.ranked_search import Grid, build_index, ranked, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_definition(docs, items, k=10):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, holding = sum(n for _, _, n in counts), len(counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for number, text in items:
        scores = []
        for i, c, n in counts:
            m = 100 - 90 + 90 * n * holding // total
            score = sum(math.floor(1000 * math.log((2 * holding + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(terms_of(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(number, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture()
def asked(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, number int, doc_id string").repartition(2)


@pytest.mark.parametrize("block_points", [1, 300, 1 << 20])
def test_ranks_equal_those_of_all_scores(spark, documents, asked, prose, block_points):
    rnd = random.Random(block_points)
    docs = [(i, prose(rnd.choice([1, 3, 20, 80, 300]), rnd.randrange(60))) for i in range(150)]
    docs += [(i, "the same words again") for i in range(200, 260)]
    items = [(i, prose(rnd.choice([1, 5, 30]), 1000 + i)) for i in range(15)] + [(50, "again the SAME same"), (51, docs[0][1])]
    assert got(ranked(documents(docs), asked(items), block_points=block_points, item_terms=40)) == by_definition(docs, items)


def test_odd_rows(spark, documents, asked):
    docs = [(1, None), (2, ""), (3, "... !?"), (4, "Été 2024 naïve"), (5, "été"), (None, "été"), (6, "ÉTÉ"), (7, LONG), (8, "a_b-c"), (8, "a_b-c"), (9, "lorem")]
    items = [(1, "été"), (2, "LOREM ipsum"), (3, None), (4, ""), (5, "absent"), (6, "b"), (7, "\0 2024")]
    assert got(ranked(documents(docs), asked(items))) == by_definition(docs, items)
    # repeated items, and those without an id, are ranked each by themselves
    twice = ranked(documents(docs), asked([(None, "été"), (None, "b"), (1, "b"), (1, "b")])).collect()
    assert sorted((r["item_id"] or 0, r["rank"]) for r in twice) == [(0, 1), (0, 1), (0, 2), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2)]


def test_empty_tables(spark, documents, asked):
    docs, items = documents([(1, "a b")]), asked([(1, "a")])
    assert ranked(docs.limit(0), items).count() == 0 and ranked(docs, items.limit(0)).count() == 0
    assert ranked(documents([(1, None)]), items).count() == 0


def test_an_index_serves_several_searches(spark, documents, asked, prose):
    docs = [(i, prose(40, i)) for i in range(60)]
    stages = Stages(ready(spark))
    index, holding = build_index(documents(docs), stages, 200)
    assert index.count() > 5
    for seed in (1, 2):
        items = [(i, prose(10, 500 * seed + i)) for i in range(5)]
        assert got(search(index, holding, asked(items), stages, k=3)) == by_definition(docs, items, 3)


def test_tasks_hold_few_blocks_of_an_index(spark, documents, asked, prose, monkeypatch):
    monkeypatch.setattr(ranked_search, "GROUP_BYTES", 1 << 10)
    docs = [(i, prose(40, i)) for i in range(60)]
    stages = Stages(ready(spark))
    index, holding = build_index(documents(docs).coalesce(1), stages, 200)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    rows = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(rows) == index.count() > 2 and max(rows) == 1
    items = [(i, prose(10, 500 + i)) for i in range(5)]
    assert got(search(index, holding, asked(items), stages, k=3)) == by_definition(docs, items, 3)


def test_grid_keeps_maxima_and_finds_the_best():
    rnd = np.random.default_rng(1)
    for columns, terms, points in ((1, 1, 1), (7, 3, 12), (200, 900, 5000), (3000, 40, 20000)):
        place = np.unique(rnd.integers(0, columns * terms, points))
        impact = rnd.integers(1, 1000, len(place)) * rnd.integers(1, 1000, len(place))
        column, h = place % columns, (place // columns).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        grid = Grid.load(*Grid.build(np.arange(columns), column, h, impact).stored())
        assert grid.maxima[0] == impact.max() and len(grid.rest) == len(place)
        for _ in range(10):
            wanted = np.unique(rnd.choice(h, 5))
            weight = rnd.integers(0, 50, len(wanted))
            scores = np.zeros(columns, np.int64)
            for t, w in zip(wanted, weight):
                np.add.at(scores, column[h == t], w * impact[h == t])
            best = [(c, s) for s, c in sorted((-s, c) for c, s in enumerate(scores) if s > 0)[:4]]
            found = grid.best(wanted, weight, 4)
            assert list(zip(found[0].tolist(), found[1].tolist())) == [(c, -s) for c, s in best]
