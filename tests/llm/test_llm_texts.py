"""Quality, licenses, mixing, languages and decontamination."""

from __future__ import annotations

import collections
import math
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL, rows
from samples import LONG, documents, prose  # noqa: F401

from farol.llm import quality
from farol.llm.common import Stages, ready
from farol.llm.decontaminate import aligned, clean_documents, contaminated
from farol.llm.language import predicted_languages
from farol.llm.licenses import TEMPLATES, license_scan
from farol.llm.mixing import mixed, mixed_documents, schedule
from farol.llm.textbytes import text_blocks

ODD = [(1, None, "en", "a"), (2, "", None, None), (None, "x y z", "en", "a"), (4, " \n\t ", "de", "b"), (5, "Ω≈ç √", "fr", None), (6, LONG, "en", "a"),
       (6, LONG, "en", "a")]


# quality

def base(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    counts = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if counts[tuple(words[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def kneser_ney(texts):
    """Probability of each class after two others, by dictionaries."""
    three = collections.Counter()
    for text in texts:
        codes = [0, 0, *quality.CLASS_OF[list(text.encode())]]
        three.update(zip(codes, codes[1:], codes[2:]))
    two, one = collections.Counter(k[1:] for k in three), collections.Counter()
    one.update(k[1:] for k in two)

    def discounts(counts):
        t = {k: sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)}
        if not t[1] + 2 * t[2]:
            return {k: min(max(0.5, 0.05), k - 0.05) for k in (1, 2, 3)}
        share = t[1] / (t[1] + 2 * t[2])
        return {k: min(max(k - (k + 1) * share * t[k + 1] / t[k] if t[k] else 0.5, 0.05), k - 0.05) for k in (1, 2, 3)}

    tables = []
    for counts in (one, two, three):
        d, total, cut = discounts(counts), collections.Counter(), collections.Counter()
        for k, v in counts.items():
            total[k[:-1]] += v
            cut[k[:-1]] += d[min(v, 3)]
        tables.append((counts, d, total, cut))

    def p(gram):
        counts, d, total, cut = tables[len(gram) - 1]
        lower = p(gram[1:]) if len(gram) > 1 else 1 / quality.CLASSES
        if gram[:-1] not in total:
            return lower
        seen = counts.get(gram, 0)
        return max(0, seen - d[min(seen, 3)] if seen else 0) / total[gram[:-1]] + cut[gram[:-1]] / total[gram[:-1]] * lower

    return p


def test_model_equals_the_formula(spark, documents, prose):
    texts = [prose(80, k) for k in range(6)] + ["Éa 1\nb"]
    stages = Stages(ready(spark))
    model = quality.language_models(documents([(i, t, "en") for i, t in enumerate(texts)]), stages).toPandas()
    hashed = quality.hashed_model(model["kind"].to_numpy(), model["gram"].to_numpy(), model["value"].to_numpy())
    p, grams = kneser_ney(texts), [(0, 0, 5), (1, 2, 3), (200, 1, 1)]
    for text in texts[:2] + ["zq xj Q"]:
        codes = [0, 0, *(int(c) for c in quality.CLASS_OF[list(text.encode())])]
        grams += zip(codes, codes[1:], codes[2:])
    grams = [g for g in grams if max(g) < quality.CLASSES]
    code = np.array([(a * quality.CLASSES + b) * quality.CLASSES + c for a, b, c in grams])
    assert np.allclose(quality.model_bits(hashed, code), [-math.log2(p(g)) for g in grams], atol=1e-3)
    total = sum(p((5, 6, z)) for z in range(quality.CLASSES))
    assert abs(total - 1) < 1e-6


def test_no_lead_or_control_bytes_are_taken_as_one(spark, documents):
    # they differ in lead bytes and control bytes only
    pairs = [("\u4e2d\u6587", "\u5e2d\u6587"), ("\u0430\u0440", "\u0470\u0440"), ("a\x01b", "a\x02b"), ("a\tb", "a\rb")]
    for left, right in pairs:
        (_, _, data, offsets), = text_blocks(pa.array([left, right]))
        codes = quality._grams(data, offsets)
        assert list(codes[offsets[0]:offsets[1]]) != list(codes[offsets[1]:offsets[2]]), (left, right)
    # a text of other characters with the same continuation bytes falls out of the band of its language
    rnd = random.Random(3)
    words = ["".join(chr(0x4E00 + 64 * rnd.randrange(4) + rnd.randrange(64)) for _ in range(2)) for _ in range(40)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(120)), "zh", "a") for i in range(40)]
    other = docs[0][1].translate({c: c + 0x5000 for c in range(0x4E00, 0x4F00)})
    assert [b & 0x3F for b in other.encode() if b & 0xC0 == 0x80] == [b & 0x3F for b in docs[0][1].encode() if b & 0xC0 == 0x80]
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(documents([*docs, (90, other, "zh", "a")])).collect()}
    assert kept[0] and not kept[90]


def test_base_counts_and_bands(spark, documents, prose):
    rnd = random.Random(1)
    docs = [(i, prose(rnd.randrange(40, 120), i), "en", "a") for i in range(40)]
    docs += [(50, docs[0][1] + "\n" + docs[0][1] + "\n#a|b", "en", "a"), (51, "Q9 %% XX!! " * 30, "en", "a"), (52, " ".join(f"Z{i}!Q" for i in range(90)), "en", "a")] + ODD
    table = documents(docs)
    got = quality.judged(table)
    assert rows(got.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == sorted((base(d[1]) for d in docs), key=repr)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert not by_id[52]["base_failed"] and not by_id[52]["kept"] and by_id[51]["base_failed"]
    assert sum(r["kept"] for i, r in by_id.items() if i is not None and i < 50 and not r["base_failed"]) >= 28
    assert not any(r["kept"] for r in by_id.values() if r["base_failed"])
    # the same in blocks of one language each
    assert rows(quality.judged(table, model_rows=1)) == rows(got)
    kept = quality.kept_documents(table)
    assert kept.columns == table.columns and kept.count() == got.where("kept").count()
    assert quality.judged(table.limit(0)).count() == 0


def test_copies_do_not_move_the_band(spark, documents, prose):
    rnd = random.Random(8)
    docs = [(i, prose(rnd.randrange(60, 140), i), "en", "a") for i in range(40)]
    docs += [(50 + i, " ".join(f"Z{i}!Q{k}" for k in range(90)), "en", "a") for i in range(2)]
    alone = {r["doc_id"]: (r["bits"], r["kept"]) for r in quality.judged(documents(docs)).collect()}
    assert sum(kept for _, kept in alone.values()) >= 30
    for copies in (15, 130):  # a quarter and three quarters of the rows of the language
        more = docs + [(1000 + i if i % 2 else None, docs[0][1], "en", "a") for i in range(copies)]
        got = quality.judged(documents(more)).collect()
        assert len(got) == len(more)
        assert {r["doc_id"]: (r["bits"], r["kept"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000} == alone
        assert {(r["bits"], r["kept"]) for r in got if r["doc_id"] is None or r["doc_id"] >= 1000} == {alone[0]}


def batch_of(texts, langs):
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(texts, pa.string())], ["lang", "text"])


def test_a_trigram_is_looked_up_once_a_block(monkeypatch, prose):
    texts = [prose(200, k) for k in range(30)]
    _, _, data, offsets = next(text_blocks(pa.array(texts), 1 << 30))
    gram = np.unique(quality._grams(data, offsets))
    models = {"en": quality.hashed_model(np.full(len(gram), 3), gram, -1 - gram % 7 / 8)}
    asked, bits = [], quality.model_bits
    monkeypatch.setattr(quality, "model_bits", lambda model, codes: asked.append(len(codes)) or bits(model, codes))
    langs = np.array(["en", "xx"] * 15, object)
    mean = quality._mean_bits(models, langs, data, offsets, np.empty(quality.CLASSES ** 3, np.int32))
    assert 0 < sum(asked) <= len(gram)
    codes = quality._grams(data, offsets)
    for i in range(30):
        want = np.mean(1 + codes[offsets[i]:offsets[i + 1]] % 7 / 8) if langs[i] == "en" else math.log2(quality.CLASSES)
        assert abs(mean[i] - want) < 1e-4


def test_counting_trigrams_takes_little_memory(prose):
    texts = [prose(300, k) for k in range(40)]
    texts, langs = texts * 50, ["en", "de"] * 1000
    batch = batch_of(texts, langs)
    assert sum(map(len, texts)) > 3 << 20
    tracemalloc.start()
    counted = list(quality._count(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak
    want = collections.Counter()
    for text, lang in zip(texts[:40], langs):
        codes = [0, 0, *(int(c) for c in quality.CLASS_OF[list(text.encode())])]
        want.update((lang, (a * quality.CLASSES + b) * quality.CLASSES + c) for a, b, c in zip(codes, codes[1:], codes[2:]))
    got = collections.Counter()
    for part in counted:
        for lang, gram, n in zip(*(c.to_pylist() for c in part.columns)):
            got[lang, gram] += n
    assert got == {k: 50 * n for k, n in want.items()}


def test_repeats_are_found_in_blocks_of_any_size():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randrange(30))) + rnd.choice(["", "\na b", "\na b\na b"]) for _ in range(300)] + ["", None, "\n\n"]
    for size in (1, 100, 1 << 18):
        found = [dict(zip(c, v)) for _, _, data, offsets in text_blocks(pa.array(texts), size) for c in [quality.base_counts(data, offsets)] for v in zip(*c.values())]
        assert [tuple(int(r[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in found] == [base(t) for t in texts]


def test_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    good = quality.judged(docs).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.9 * good.count()


def test_bad_documents_go(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = quality.judged(docs).join(labels, "doc_id").where("not base_failed").select("lang", "quality", "kept").toPandas()
    share = seen.groupby(["lang", "quality"])["kept"].mean()
    assert set(share.index.get_level_values(0)) == {"de", "en", "es", "fr"}
    for lang, bad in (("de", 0.05), ("en", 0.02), ("es", 0.4), ("fr", 0.2)):
        assert share[lang, 0] <= bad and share[lang, 1] >= 0.95, (lang, share[lang, 0], share[lang, 1])


# licenses

def test_blocks_equal_those_of_all_templates(spark, documents):
    rnd, docs = random.Random(2), []
    for i in range(60):
        label, notice = TEMPLATES[i % len(TEMPLATES)]
        words = notice.split()
        if i % 3 == 0:
            words = re.sub(r"((?:\S+ ){4,7})", r"\1\n// ", notice).split(" ")
        for _ in range(rnd.randrange(0, 1 + len(words) // 3)):
            words[rnd.randrange(len(words))] = rnd.choice(["foo", "bar", "the", "license"])
        docs.append((100 + i, f"Some text.\n{' '.join(words).title()}, and more; {rnd.choice(['', 'the license'])}\nunder the MIT  License under the mit license"[:rnd.choice([60, 400])]))
    docs += [(70, "cc by nc cc by nc CC-BY-NC"), (71, "under the mit\nlicense"), (72, "under the mitlicense")] + [o[:2] for o in ODD]
    got = license_scan(documents(docs)).collect()
    assert len(got) == len(docs)
    texts = dict(docs)
    for r in got:
        if r["doc_id"] is None:
            continue
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items()
                  for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        more = {}
        for label, notice in TEMPLATES:
            own = set(notice.split())
            length = len(own) * 100 // 80
            for i in range(max(1, len(words) - length + 1)):
                share = len(own & set(words[i:i + length])) / len(own)
                if share >= 0.8:
                    more[label] = max(more.get(label, 0), share)
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((i for i, _ in places), default=None) and r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["labels"] == ",".join(sorted({x for _, x in places} | set(more)))
        assert abs(r["score"] - (1 if places else max(more.values(), default=0))) < 1e-9
    assert license_scan(documents(docs).limit(0)).count() == 0


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark, documents):
    wrapped = [(i, "# " + re.sub(r"((?:\S+ ){7})", r"\1\n# ", notice).title()) for i, (_, notice) in enumerate(TEMPLATES)]
    rnd = random.Random(5)
    everything = [w for _, notice in TEMPLATES for w in notice.split()]
    filler = [f"w{k}" for k in range(3000)]
    for w in everything:
        filler.insert(rnd.randrange(len(filler)), w)
    scattered = " ".join(f"{w} x y z" for w in filler)
    got = {r["doc_id"]: r for r in license_scan(documents([*wrapped, (100, scattered), (101, scattered.replace(" ", "\n"))])).collect()}
    for i, (label, _) in enumerate(TEMPLATES):
        assert label in got[i]["labels"].split(",")
    assert got[100]["labels"] == got[101]["labels"] == "" and got[100]["score"] == 0


# mixing

def test_sources_meet_their_targets(spark, documents, prose):
    rnd = random.Random(5)
    docs = [(100 + i, prose(rnd.randrange(0, 60), i), "en", rnd.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(200)] + ODD
    got = mixed(documents(docs)).collect()
    size = collections.Counter()
    for d in docs:
        size[d[3]] += len(re.findall(r"[^ \t-\r]+", d[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else weight[s] * level
        if not full:
            break
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    taken, sources = collections.Counter(), {d[0]: d[3] for d in docs}
    for r in got:
        s = sources[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(docs) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert rows(mixed(documents(docs))) == sorted((tuple(r) for r in got), key=repr)
    order = [r["finish"] for r in schedule(documents(docs)).collect()]
    assert order == sorted(order)
    copies = mixed_documents(documents(docs))
    assert copies.columns == [c for c in documents(docs).columns if c != "taken"] + ["copy", "finish", "taken"]
    assert mixed(documents(docs).limit(0)).count() == 0 and mixed(documents([(1, None, "en", "a")])).first()["taken"] == 0


def test_repeated_rows_are_sent_once_each(spark, documents, prose):
    docs = [(i, prose(20, i), "en", "a") for i in range(12)]
    docs += [(50, prose(30, 50), "en", "a")] * 3 + [(None, prose(25, 51), "en", "b")] * 3 + [(60, prose(9, 60), "en", s) for s in ("a", "b", None)]
    table = documents(docs)
    got, queue = mixed_documents(table).collect(), schedule(table).collect()
    assert sorted((r["finish"], r["taken"], r["copy"], r["doc_id"] or -1, r["source"] or "") for r in got) == sorted(
        (r["finish"], r["taken"], r["copy"], r["doc_id"] or -1, r["source"] or "") for r in queue)
    budget = 1.5 * sum(len(d[1].split()) for d in docs)
    assert budget - 3 <= sum(r["taken"] for r in got) <= budget
    assert max(collections.Counter((r["doc_id"], r["source"], r["copy"]) for r in got).values()) == 3


@pytest.mark.parametrize("range_words", [1, 40, 1 << 16])
def test_the_cut_of_the_global_order_is_where_targets_are_reached(spark, documents, prose, monkeypatch, range_words):
    from farol.llm import mixing

    monkeypatch.setattr(mixing, "RANGE_WORDS", range_words)
    rnd = random.Random(range_words)
    docs = [(None if i % 3 == 0 else i, prose(rnd.choice([1, 7, 60, 400]), i), "en", rnd.choice(["a", "b", "b", "b", "c", None])) for i in range(120)]
    docs += [(500, prose(3000, 1), "en", "c"), (501, "", "en", "empty"), (502, "one two", "en", "tiny")]
    got = mixing.queued(documents(docs)).collect()
    by_source, words_of = collections.defaultdict(list), {}
    for r in got:
        by_source[r["source"]].append(r)
    for source, rows_ in by_source.items():
        target, size = rows_[0]["target"], sum(r["size"] for r in rows_)
        assert size == rows_[0]["source_size"]
        copies = sorted((c["start"], c["finish"], c["taken"], r["size"]) for r in rows_ if r["size"] for c in r["copies"])
        sent = 0
        for start, finish, taken, n in copies:
            # all words of a source that finish by virtual time 1, in the order of its queue
            assert taken == max(0, min(n, math.floor(target) - sent)) and abs(finish - (sent + n) / target) < 1e-9
            sent += n
        words_of[source] = sum(c[2] for c in copies)
        assert words_of[source] == (math.floor(target) if size else 0)
    assert len(by_source) == 6 and sum(words_of.values()) > 0


# languages

def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()


def test_odd_languages(spark, documents):
    docs = documents(ODD + [(20, "12 34", "en", "a")])
    got = predicted_languages(docs).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 4, 20))
    assert predicted_languages(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in predicted_languages(documents([(1, "abc", None, "a")])).collect()} == {"und"}


# decontamination

def edits(a, b):
    row = [0] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        last, row[0] = row[0], i
        for j in range(1, len(b) + 1):
            last, row[j] = row[j], min(last + (a[i - 1] != b[j - 1]), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_alignment_equals_the_full_table():
    rnd = random.Random(1)
    for _ in range(150):
        item = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(5, 25)))
        text = bytearray(bytes(rnd.choices(b"abc", k=rnd.randint(0, 10))) + item + bytes(rnd.choices(b"abc", k=rnd.randint(0, 10))))
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(text))
            rnd.choice([lambda: text.__setitem__(k, rnd.choice(b"abc")), lambda: text.__delitem__(k), lambda: text.insert(k, rnd.choice(b"abc"))])()
        want = edits(item, bytes(text))
        got = aligned(np.frombuffer(item, np.uint8), np.frombuffer(bytes(text), np.uint8), -5, len(text), 5)
        assert (got[0] if got else None) == (want if want <= 5 else None)
        if got:
            assert edits(item, bytes(text)[got[1]:got[2]]) == got[0]


def test_items_are_found_within_their_edits(spark, documents, prose):
    rnd = random.Random(4)
    items = [(i, prose(30, 900 + i)) for i in range(10)] + [(20, "too short"), (21, None), (None, prose(30, 1)), (22, prose(4, 950))]
    docs = []
    for i in range(80):
        item = rnd.choice(items[:10])[1]
        chars = list(item)
        for _ in range(rnd.choice([0, 0, 3, 6, 9, 14, 20, 60])):
            chars[rnd.randrange(len(chars))] = rnd.choice("xyzé")
        docs.append((i, f"{prose(20, i)} {''.join(chars).upper() if i % 2 else ''.join(chars)}\n\n{prose(20, i + 500)}"))
    docs += [(90, items[0][1].replace(" ", "\n \t")), (91, items[13][1]), (92, items[3][1][:60])] + [o[:2] for o in ODD]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in contaminated(documents(docs), table).collect()}

    def flat(text):
        return re.sub(r"[ \t-\r]+", " ", text or "").translate({c: c + 32 for c in range(65, 91)}).encode()

    want = {}
    for d, text in docs:
        for i, item in items:
            p = flat(item).strip()
            if i is not None and p:
                budget = len(p) * 6 // 100
                if len(flat(text)) < 5000 and (n := edits(p, flat(text))) <= budget:
                    want[d, i] = n
    assert got == want and len(want) > 30
    assert got == {(r["doc_id"], r["item_id"]): r["edits"] for r in contaminated(documents(docs), table, block_bytes=100).collect()}
    clean = clean_documents(documents(docs), table)
    assert clean.columns == documents(docs).columns and clean.count() == len(docs) - len({d for d, _ in want})
    assert contaminated(documents(docs), table.limit(0)).count() == 0 and contaminated(documents(docs).limit(0), table).count() == 0


def test_short_and_repetitive_items_at_their_full_budget(spark, documents):
    rnd = random.Random(11)
    items = [(m, "".join(rnd.choice("abcd ") for _ in range(m - 2)).strip().ljust(m, "a")) for m in range(3, 41)]
    items += [(60, "ab " * 60), (61, "abc" * 20), (62, "a" * 50), (63, "x")]
    docs = []
    for i in range(120):
        chars = list(rnd.choice(items)[1])
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 10])):
            k = rnd.randrange(len(chars))
            chars[k:k + 1] = rnd.choice([[], ["b"], [chars[k], "c"]]) if len(chars) > 1 else chars
        docs.append((i, "".join(rnd.choices("abcd ", k=rnd.randint(0, 30))) + "".join(chars) + "".join(rnd.choices("abcd ", k=rnd.randint(0, 30)))))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(documents(docs), table).collect()

    def flat(text):
        return re.sub(r"[ \t-\r]+", " ", text).encode()

    want = {(d, i): n for d, text in docs for i, item in items if (n := edits(flat(item).strip(), flat(text))) <= len(flat(item).strip()) * 6 // 100}
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in got} == want and len(want) > 100
    for r in got:
        part = dict(docs)[r["doc_id"]].encode()[r["start"]:r["end"]].decode()
        assert edits(flat(dict(items)[r["item_id"]]).strip(), flat(part)) == r["edits"]


def test_long_repetitive_texts_take_time_and_memory_in_proportion():
    from farol.llm.decontaminate import _matches, item_index

    index = item_index([(1, "ab " * 60)], 6)
    for n in (3_000, 48_000):
        data = np.frombuffer(b"ab " * n, np.uint8)
        started = time.time()
        assert [m[:3] for m in _matches(index, data, np.array([0, len(data)]))] == [(0, 0, 0)]
        assert time.time() - started < 4


def test_blocks_hold_every_text_once():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "c" * 50, "é", "x"]).slice(1)
    got = [bytes(data[a:b]).decode() for _, _, data, offsets in text_blocks(column, 10) for a, b in zip(offsets, offsets[1:])]
    assert got == ["", "", "c" * 50, "é", "x"]


@pytest.mark.parametrize("size", [1, 3])
def test_weights_of_one_source(spark, documents, prose, size):
    got = mixed(documents([(i, prose(10, i), "en", "only") for i in range(size)])).collect()
    assert sum(r["taken"] for r in got) == 15 * size
