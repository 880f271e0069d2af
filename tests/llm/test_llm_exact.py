from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F
from samples import LONG, documents, prose  # noqa: F401

from farol.llm.exact_dedup import copy_groups, without_copies


def groups_of(docs):
    """Largest doc_id and size of each group of equal texts, null ids last."""
    by_text = defaultdict(list)
    for i, text in docs:
        by_text[text or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by_text.items()}


def sample(prose):
    rnd = random.Random(3)
    stock = [prose(rnd.choice([1, 5, 60, 61, 90, 400]), k) for k in range(60)]
    # equal lengths and equal prefixes with other ends
    stock += [prose(80, 1)[:300] + c * 5 for c in "abcdef"] + [prose(3, 9).ljust(40, c) for c in "xyz"]
    docs = [(i, rnd.choice(stock)) for i in range(300)] + [(i, stock[0]) for i in range(300, 500)]
    docs += [(600, None), (601, ""), (602, " "), (603, LONG), (604, LONG), (605, LONG[:-1] + "x"), (606, "é"), (607, "é")]
    docs += [(None, stock[0]), (None, "only here"), (None, "only here"), (700, "three times"), (700, "three times"), (700, "three times")]
    rnd.shuffle(docs)
    return docs


def test_groups_equal_those_of_whole_texts(spark, documents, prose):
    docs = sample(prose)
    want = groups_of(docs)
    got = copy_groups(documents(docs), sha=F.sha2(F.coalesce("text", F.lit("")), 256), text=F.col("text")).collect()
    assert len(got) == len(docs)
    for r in got:
        keep, size = want[r["text"] or ""]
        assert (r["keep_id"], r["group_size"]) == (keep, size)
        assert not r["kept"] or r["doc_id"] == keep
        assert r["sha"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert sorted(r["text"] or "" for r in got if r["kept"]) == sorted(want)


def test_kept_rows_have_their_columns(spark, documents, prose):
    docs = sample(prose)
    kept = without_copies(documents(docs))
    assert kept.columns == documents(docs).columns
    assert sorted((r["text"] or "", r["doc_id"], r["key"], r["taken"]) for r in kept.collect()) == sorted(
        ((t, i, "k", "t") for t, (i, _) in groups_of(docs).items()), key=lambda r: r[0])


def test_texts_are_equal_after_the_given_change(spark, documents):
    docs = documents([(1, "A b"), (2, "a B"), (3, "a c")])
    got = rows(copy_groups(docs, lambda text: F.lower(text)).select("doc_id", "keep_id", "group_size", "kept"))
    assert got == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


@pytest.mark.parametrize("prefix", [1, 1000])
def test_any_prefix_gives_the_same_groups(spark, documents, prose, prefix):
    docs = sample(prose)
    columns = ["doc_id", "keep_id", "group_size"]
    assert rows(copy_groups(documents(docs), prefix=prefix).select(columns)) == rows(copy_groups(documents(docs)).select(columns))


def test_empty_table(spark, documents):
    empty = documents([(1, "a")]).limit(0)
    assert copy_groups(empty).count() == 0 and without_copies(empty).count() == 0


def test_only_surviving_groups_are_hashed_and_no_text_is_shuffled(spark, documents, prose, capsys):
    copy_groups(documents(sample(prose))).explain("formatted")
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" not in plan and "MapIn" not in plan and "body" not in plan
