from __future__ import annotations

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import rows
from samples import LONG, documents, prose  # noqa: F401

from farol.llm.suffix_dedup import deduplicated, digest

def cut(docs, length):
    first = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raw:
        rank = 1 << 62 if i is None else i
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, rank), rank)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < (1 << 62 if i is None else i):
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture()
def tangled(prose):
    rnd, bases = random.Random(3), [prose(60, k) for k in range(8)]
    docs = []
    for i in range(70):
        parts = [rnd.choice(bases)[(a := rnd.randrange(200)):a + rnd.randrange(20, 260)] for _ in range(rnd.randrange(1, 5))]
        docs.append((i, rnd.choice(["", " ", "é", "\n"]).join(parts)))
    return docs + [(70, docs[3][1]), (71, docs[3][1]), (72, "ab" * 200), (73, "ab" * 90), (74, "ba" * 300)]


@pytest.mark.parametrize("bucket_rows", [50_000, 3])
def test_cut_texts_equal_those_of_all_strings(spark, documents, tangled, bucket_rows):
    from farol.llm.suffix_dedup import removed

    got = removed(documents(tangled), 50, bucket_rows).collect()
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got], key=repr) == cut(tangled, 50)


def test_other_lengths(spark, documents, tangled):
    assert rows(digest(documents(tangled[:40]), 23)) == cut(tangled[:40], 23)


def test_odd_rows(spark, documents, prose):
    text = prose(40, 2)
    docs = [(4, text), (4, text), (None, text), (None, "x" + text), (9, None), (10, ""), (11, "é" * 30), (12, "é" * 49), (13, text[:49])]
    assert rows(digest(documents(docs), 50)) == cut(docs, 50)
    long = rows(digest(documents([(1, LONG), (2, LONG[7:])]), 50))
    assert [r[2] for r in long] == [0, len(LONG) - 7]
    assert digest(documents(docs).limit(0), 50).count() == 0


def test_texts_keep_their_rows_and_whole_characters(spark, documents):
    shared = "é" * 40
    docs = documents([(1, "a" + shared), (2, "b" + shared + "ü"), (2, "other"), (3, None)])
    got = deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect() if r["text"] is not None) == [
        (1, "a" + shared, 41), (2, "b", 1), (2, "other", 5)]  # the first byte of the last character also goes


def test_refined_buckets_are_those_of_the_strings():
    import pyarrow as pa

    from farol.llm.suffix_dedup import _duplicates

    rnd = random.Random(9)
    for length in (16, 23, 50):
        for alphabet in ("a", "ab", "abcd"):
            runs = [(rnd.randrange(6), bytes(ord(rnd.choice(alphabet)) for _ in range(rnd.randrange(length, 3 * length)))) for _ in range(25)]
            rows_ = pa.RecordBatch.from_pydict({
                "rank": pa.array([r for r, _ in runs], pa.int64()), "text_hash": pa.array(range(len(runs)), pa.int64()), "bucket": pa.array([0] * len(runs), pa.int64()),
                "start": pa.array([100 * i for i in range(len(runs))], pa.int64()), "bytes": pa.array([b for _, b in runs], pa.binary())})
            got = {(r["text_hash"], r["start"] - 100 * r["text_hash"] + k) for r in _duplicates(rows_, length).to_pylist() for k in range(r["suffixes"])}
            first = {}
            for r, b in runs:
                for p in range(len(b) - length + 1):
                    first[b[p:p + length]] = min(first.get(b[p:p + length], 9), r)
            assert got == {(i, p) for i, (r, b) in enumerate(runs) for p in range(len(b) - length + 1) if first[b[p:p + length]] < r}


def test_a_third_without_an_id_lists_its_own_buckets_only(spark, documents, tangled):
    docs = [(None if i % 3 == 0 else i, t) for i, t in tangled]
    assert rows(digest(documents(docs), 50)) == cut(docs, 50)


def test_texts_of_one_character(spark, documents):
    docs = documents([(i, "z" * (2000 + i)) for i in range(30)])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in digest(docs, 50).collect()}
    assert got == {i: (2000 + i, 2000 + i if i else 0, 1 if i else 0) for i in range(30)}


def test_a_large_bucket_takes_little_memory():
    from farol.llm.suffix_dedup import _duplicates

    rnd = random.Random(4)
    common = bytes(rnd.choices(range(97, 123), k=149))
    texts = [common[:rnd.randrange(60, 150)] for _ in range(8000)]
    rows_ = pa.RecordBatch.from_pydict({"rank": pa.array([(1 << 40) + i for i in range(8000)]), "text_hash": pa.array(range(8000)), "bucket": pa.array([1] * 8000),
                                        "start": pa.array([0] * 8000), "bytes": pa.array(texts, pa.binary())})
    tracemalloc.start()
    got = _duplicates(rows_, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * sum(map(len, texts)), peak / sum(map(len, texts))
    # all suffixes of 50 bytes and more are those of the longest text; a place is kept where its string comes first
    longest = 0
    for i, text in enumerate(texts):
        new = max(0, len(text) - 49 - longest)
        assert got.filter(pc.equal(got.column("text_hash"), i)).column("suffixes").to_pylist() == ([len(text) - 49 - new] if len(text) - 49 - new else [])
        longest = max(longest, len(text) - 49)
        if i == 200:
            break
