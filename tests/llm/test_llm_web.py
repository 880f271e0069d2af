"""Chat trees, revisits, URLs, registered queries and the pipeline."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import random

import duckdb
import pytest
from conftest import SMALL, rows
from samples import LONG, documents, prose  # noqa: F401

import corpus_pipeline
from farol.llm import queries
from farol.llm.chat_tree import chat_digests, conversations, escaped, parsed, trees, unescaped
from farol.llm.revisits import canonical, read_warc, resolved
from farol.llm.url_filter import judged_urls, with_membership

TABLES = ["documents", "pages", "benchmark", "conversations"]


# chat

ODD_TEXTS = ["\\### Assistant: </turn> ok", "</turn>\n<turn role=\"assistant\">\n", "\\", "\\\\<", "", "a\\", "é\n", '"<']


def chat_rows():
    rnd, out = random.Random(3), []
    for conv in range(60):
        shared = rnd.choice([0, 1, 2, 3])
        for turn in range(rnd.randint(1, 5)):
            text = f"shared {turn}" if turn < shared else rnd.choice(ODD_TEXTS)
            out.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    return [*out, (70, 0, None, None), (71, None, "assistant", "x"), (71, 0, "as\"<\\sistant", "y"), (72, 0, "assistant", "t"), (72, 0, "assistant", "t"),
            (None, 1, "assistant", "none"), (73, 0, "assistant", LONG)]


def chat_frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], "conv_id long, turn long, role string, text string, path string, turns int").repartition(3)


def wanted_chats(data):
    by = {}
    for conv, turn, role, text in data:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        content = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(content.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1 << 16, 40])
def test_chats_read_back(spark, size):
    got = chat_digests(chat_frame(spark, chat_rows()), size)
    assert rows(got.drop("formatted_chars")) == wanted_chats(chat_rows())
    assert chat_digests(chat_frame(spark, chat_rows()).limit(0)).count() == 0


def test_escapes():
    for text in ODD_TEXTS:
        assert unescaped(escaped(text)) == text and "</turn>" not in escaped(text)
    with pytest.raises(ValueError):
        parsed("no turn")


@pytest.mark.parametrize("tokenizer", [None, "/opt/tokenizers/byte_bpe_50k.json"])
def test_shared_turns_are_emitted_once(spark, tokenizer):
    data = [(c, t, "user", f"turn {t}" if t < 2 else f"own {c}") for c in range(9) for t in range(4)]
    packs = trees(conversations(chat_frame(spark, data)).coalesce(1), tokenizer=tokenizer).collect()
    assert sum(p["text"].count("turn 0<") for p in packs) == len(packs)
    for pack in packs:
        assert [n["start"] for n in pack["nodes"]] == [0, *[n["end"] for n in pack["nodes"]][:-1]]
        assert not tokenizer or len(pack["token_ids"]) == pack["nodes"][-1]["end"]
        for node, spans in zip(pack["nodes"], pack["intervals"]):
            chain, at = [], node["parent"]
            while at >= 0:
                chain.append(pack["nodes"][at])
                at = chain[-1]["parent"]
            seen = sorted(k for n in chain for k in range(n["start"], n["end"]))
            assert seen == [k for s in spans for k in range(s["start"], s["end"])] and node["position"] == len(seen)


# revisits

def captures(spark, data):
    day = dt.datetime(2024, 1, 1)
    made = [(i, url, None if at is None else day + dt.timedelta(hours=at), kind, headers, payload, "clash") for i, url, at, kind, headers, payload in data]
    return spark.createDataFrame(made, "record_id long, url string, at timestamp, kind string, headers map<string,string>, payload string, url_key string").repartition(3)


def test_revisits_take_the_latest_earlier_response(spark):
    rnd, data = random.Random(6), []
    for i in range(300):
        kind = rnd.choice(["response", "revisit"])
        headers = {k: v for k, v in (("etag", rnd.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", rnd.choice(["m", "n", None])),
                                     ("content-type", "t" if kind == "response" else "wrong"), ("date", str(i))) if v}
        data.append((i, f"http://{rnd.choice(['a', 'www.a', 'b'])}.org/{rnd.choice(['x', 'x/', 'x#f', 'y?utm_a=1'])}", rnd.randrange(100), kind, headers, f"p{i}"))
    data += [(900, None, 5, "revisit", {}, None), (901, "http://a.org/x", None, "revisit", {}, None), (902, "http://a.org/x", None, "response", {}, "bad"),
             (903, "http://a.org/x", 200, None, {}, "bad"), (None, "http://a.org/x", 201, "response", {}, "bad"), (904, "http://a.org/x", 300, "revisit", {}, None)]
    table = captures(spark, data)
    got = {r["record_id"]: r for r in resolved(table).collect()}
    keys = {r["record_id"]: r["k"] for r in table.select("record_id", canonical(table["url"]).alias("k")).collect()}
    for i, _, at, kind, headers, _ in data:
        if kind != "revisit":
            continue
        full = [d for d in data if d[3] == "response" and d[0] is not None and d[2] is not None and at is not None and keys[d[0]] == keys[i] and d[2] < at]
        best = max(full, key=lambda d: (d[2], d[0]), default=None)
        if best is None:
            outcome = "missing"
        elif "etag" in headers:
            outcome = "resolved" if best[4].get("etag", "").removeprefix("W/") == headers["etag"].removeprefix("W/") else "changed"
        elif "last-modified" in headers:
            outcome = "resolved" if best[4].get("last-modified") == headers["last-modified"] else "changed"
        else:
            outcome = "unchecked"
        r = got[i]
        assert (r["refers_to"], r["outcome"]) == (best and best[0], outcome)
        if outcome in ("resolved", "unchecked"):
            assert r["payload"] == best[5]
            assert r["headers"] == best[4] | {k: v for k, v in headers.items() if k != "content-type"}
        else:
            assert r["payload"] is None and r["headers"] is None
    assert len(got) == sum(d[3] == "revisit" for d in data)
    assert resolved(table.unionByName(table)).count() == 2 * len(got)
    assert resolved(table.limit(0)).count() == 0


def test_one_record_id_for_several_captures(spark):
    table = captures(spark, [
        (1, "http://a.org/", 10, "response", {"etag": "x"}, "A"), (1, "http://b.org/", 10, "response", {"etag": "x"}, "B"), (1, "http://b.org/", 5, "response", {"etag": "x"}, "old"),
        (1, "http://c.org/", 10, "response", {"etag": "x", "n": "2"}, "C2"), (1, "http://c.org/", 10, "response", {"etag": "x", "n": "1"}, "C1"),
        (7, "http://b.org/", 20, "revisit", {"etag": "x", "date": "b"}, None), (7, "http://a.org/", 20, "revisit", {"etag": "x", "date": "a"}, None),
        (8, "http://c.org/", 20, "revisit", {"etag": "x"}, None)])
    got = {r["url_key"]: (r["payload"], r["headers"]) for r in resolved(table).collect()}
    assert got == {"a.org": ("A", {"etag": "x", "date": "a"}), "b.org": ("B", {"etag": "x", "date": "b"}), "c.org": ("C1", {"etag": "x", "n": "1"})}


def test_warc_files(spark, tmp_path):
    def record(kind, name, date, head, body=""):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n{body}".encode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\nWARC-Target-URI: http://a.org/\r\nWARC-Date: {date}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    data = record("warcinfo", "0", "2024-01-01T00:00:00Z", "a: b") + record("response", "1", "2024-01-01T00:00:00Z", 'ETag: "x"\r\nServer: s', "WARC/body é") + record(
        "revisit", "2", "2024-01-02T00:00:00Z", 'ETag: W/"x"\r\nDate: d')
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(data))
    got = resolved(read_warc(spark, str(tmp_path))).collect()
    assert [(r["record_id"], r["refers_to"], r["outcome"], r["payload"]) for r in got] == [("2", "1", "resolved", "WARC/body é")]
    assert got[0]["headers"] == {"etag": 'W/"x"', "server": "s", "date": "d"}


# urls

def test_membership_is_exact(spark):
    keys = [(f"h{i}.org",) for i in range(3000)]
    table, listed = spark.createDataFrame([*keys, ("h1.org",), ("",)], "key string"), spark.createDataFrame([(f"h{i}.org",) for i in range(0, 3300, 7)], "key string")
    for block_keys in (10 ** 6, 100):
        got = with_membership(table, listed, block_keys).collect()
        assert len(got) == 3002
        assert all(r["listed"] == (r["key"] != "" and int(r["key"][1:-4]) % 7 == 0) for r in got)
    assert not any(r["listed"] for r in with_membership(table, listed.limit(0)).collect())


def test_rules_and_odd_urls(spark):
    urls = {"http://a.net/x": "net/", "HTTP://EXAMPLE.NET/en/1": "example.net/en/", "https://m.Example.com/de/x?y": "example.com/de/", "http://a.org/fr/": "org/fr/",
            "http://a.net": None, "http://notnet/": None, "http://x.org/de/": None, "no scheme": None, None: None, "http://www.casino-x.org/": None, "http://a.org/?http://x.net/": None,
            "http://net/": "net/", "http://example.net?q=/en/": None, "http://a.example.net/english": "net/"}
    pages = spark.createDataFrame([(i, u, "listed", "k") for i, u in enumerate(urls)] + [(None, "http://a.net/x", "l", "k")] * 2, "page_id long, url string, listed string, key string")
    got = judged_urls(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        url = "http://a.net/x" if r["page_id"] is None else list(urls)[r["page_id"]]
        assert r["rule"] == urls[url], url
        want = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(r["rule"], "block" if url and "casino" in url else "allow")
        assert r["verdict"] == want
    assert {(r["host"], r["path"]) for r in got if r["page_id"] in (1, 12, 7, 8)} == {("example.net", "/en/1"), ("example.net", ""), ("", "")}
    assert judged_urls(pages.limit(0)).count() == 0


# registered queries and the pipeline

@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"op2_decontaminate", "op4_quality_rules", "op7_language_id"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SMALL)
    cursor = sql.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.select(*columns)) == sorted(cursor.fetchall(), key=repr)


def test_native_queries_run_no_python(spark):
    for name in ("op5_license_scan", "op6_weighted_fair_mix", "op12_exact_dedup"):
        text = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs
    folders = queries.table(spark, SMALL, "documents").count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL).cache()
        assert after.columns == names and 0 < after.count() <= folders
        folders, before = after.count(), after
    mix = corpus_pipeline.run(spark, SMALL)
    assert set(names) <= set(mix.columns) and mix.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
