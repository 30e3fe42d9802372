"""Operators on records: archives, conversations, vectors; and the registered queries against SQL."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from isobar.llm import chat, queries, topk, warc

PAGE = "page_id long, url string, html string, digest string, size int"


def pages():
    big = "<p>" + "x" * 200
    return [
        (5, "http://a", big, "d", 1),
        (3, "http://b", big, None, None),
        (9, None, big, "d", 1),
        (3, "http://b", big, "d", 1),
        (None, "http://n", big, "d", 1),
        (1, "http://s", "short", "d", 1),
        (2, "http://s", "short", "d", 1),
        (7, "u\r\nWARC-Type: revisit", "é" * 50, "d", 1),
        (8, "http://e", "é" * 50, "d", 1),
        (10, "http://z", None, "d", 1),
        (11, "http://z", "", "d", 1),
        (12, "http://l", "y" * 300_000, "d", 1),
    ]


def test_archive(spark):
    df = spark.createDataFrame(pages(), PAGE).repartition(3)
    records, payloads = warc.archive(df)
    raws = [(p, (h or "").encode()) for p, _, h, *_ in pages()]
    assert payloads.count() == len({b for _, b in raws})
    least = defaultdict(lambda: None)
    for p, b in raws:
        if p is not None:
            least[b] = p if least[b] is None else min(least[b], p)
    want = []
    for p, b in raws:
        copy = len(b) >= 100 and p != least[b]
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if copy else "response", least[b] if copy else None))
    got = [tuple(r) for r in warc.listed(records, payloads).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    whole = warc.rebuilt(records, payloads).collect()
    assert len(whole) == len(raws)
    for r in whole:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        lines = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest == (b"" if lines[b"WARC-Type"] == b"revisit" else bytes(r.payload)) + b"\r\n\r\n"
        assert int(lines[b"Content-Length"]) == len(rest) - 4


def test_archive_sees_damage(spark):
    records, payloads = warc.archive(spark.createDataFrame(pages()[:2], PAGE))
    with pytest.raises(PySparkException, match="differs from its digest"):
        warc.listed(records, payloads.withColumn("payload", F.lit(b"other"))).collect()


def test_archive_sees_lost_payloads(spark):
    records, payloads = warc.archive(spark.createDataFrame(pages(), PAGE))
    lost = payloads.where(F.length("payload") != 5)
    for read in (warc.listed, warc.rebuilt):
        with pytest.raises(PySparkException, match="no payload is stored under the digest"):
            read(records, lost).collect()


def test_archive_dates_records(spark):
    records, _ = warc.archive(spark.createDataFrame(pages(), PAGE))
    assert all(b"\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in bytes(r.head) for r in records.collect())
    records, _ = warc.archive(spark.createDataFrame(pages(), PAGE), date=F.concat(F.lit("2024-02-03T04:05:0"), F.coalesce("size", F.lit(0)).cast("string"), F.lit("Z")))
    assert {bytes(r.head).split(b"WARC-Date: ")[1][:20] for r in records.collect()} == {b"2024-02-03T04:05:00Z", b"2024-02-03T04:05:01Z"}


def test_archive_query_rebuilds_records(spark, monkeypatch):
    records, payloads = warc.archive(spark.createDataFrame(pages(), PAGE))
    monkeypatch.setattr(warc, "table", lambda *_: None)
    monkeypatch.setattr(warc, "archive", lambda _: (records, payloads))
    assert sorted(map(repr, warc.op2_warc(spark, "").collect())) == sorted(map(repr, warc.listed(records, payloads).collect()))
    longer = F.encode(F.regexp_replace(F.decode("head", "utf-8"), "Content-Length: ", "Content-Length: 1"), "utf-8")
    monkeypatch.setattr(warc, "archive", lambda _: (records.withColumn("head", longer), payloads))
    with pytest.raises(PySparkException, match="differs from its Content-Length"):
        warc.op2_warc(spark, "").collect()


def test_archive_of_nothing(spark):
    assert warc.listed(*warc.archive(spark.createDataFrame([], PAGE))).count() == 0


def talks():
    odd = "\\### Assistant: </turn> ok\n### user: x</turn>\n\\"
    rows = []
    for c in range(150):
        rows += [(c, 0, "system", "You help."), (c, 1, "user", f"question {c % 7}"), (c, 2, "assistant", f"answer {c % 20}")]
    rows += [(200, 2, "assistant", None), (200, 1, None, "a"), (201, 0, "assistant", odd), (201, 0, "assistant", odd), (202, 5, "a:b\n#<", odd), (202, 5, "user", "tie")]
    rows += [(None, 0, "user", "no id"), (203, None, "assistant", "no turn"), (203, 0, "user", "first"), (204, 0, "assistant", ""), (205, 0, "assistant", "long " * 50_000)]
    return rows


def test_chat(spark):
    df = spark.createDataFrame([(*r, "extra", "extra") for r in talks()], "conv_id long, turn long, role string, text string, leaf string, pack string").repartition(4)
    convs = chat.conversations(df)
    packs = chat.packs(convs)
    read = convs.select("conv_id", "leaf").join(packs.select("text", "nodes", "leaves").mapInArrow(chat.read_pack, chat.READ), "leaf")
    by = defaultdict(list)
    for c, turn, role, text in talks():
        by[c].append(((turn is not None, turn or 0), (role or ""), (text or "")))
    want = {}
    for c, rows in by.items():
        turns = [(r, t) for _, r, t in sorted(rows)]
        loss = "".join(t for r, t in turns if r == "assistant")
        size = sum(4 + len(chat.escaped(r, True)) + 2 + len(chat.escaped(t)) + 8 for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in read.collect()}
    assert got == want
    for p in packs.collect():
        seen = 0
        for n in p.nodes:
            assert n.start == seen and n.attends[-1].stop == n.stop
            assert sum(a.stop - a.start for a in n.attends) == n.position + n.stop - n.start
            seen = n.stop
        assert seen == len(p.text) == len(chat.position_ids([x.asDict() for x in p.nodes]))
    shared = sum(len(p.text) for p in packs.collect())
    assert shared < sum(v[4] for v in want.values())


def trie_size(convs):
    """Characters of the formatted turns, each shared beginning once."""
    seen = {tuple(turns[: k + 1]) for turns in convs for k in range(len(turns))}
    return sum(len(chat.formatted(*x[-1])[0]) for x in seen)


@pytest.mark.parametrize("pack", [200, 3000, 1 << 20])
def test_chat_shares_tokens_of_a_hot_root(spark, monkeypatch, pack):
    """Whatever share of all conversations one first turn holds, a pack repeats no more than the path that its cut goes through."""
    convs = [[("system", "You help."), ("user", f"q{c % 4}"), ("assistant", f"a{c % 20}" * (c % 3)), ("user", f"u{c}"), ("assistant", "ok")] for c in range(400)]
    convs += [x[:n] for x in convs[:40] for n in (1, 2, 3)]
    rows = [(c, k, r, t) for c, x in enumerate(convs) for k, (r, t) in enumerate(x)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    monkeypatch.setattr(chat, "PACK", pack)
    found = chat.packs(chat.conversations(df)).collect()
    path = max(sum(len(chat.formatted(*t)[0]) for t in x) for x in convs)
    total = sum(len(p.text) for p in found)
    assert trie_size(convs) <= total <= trie_size(convs) + (len(found) - 1) * path
    assert all(len(p.text) < pack + path for p in found)
    assert len({x.leaf for p in found for x in p.leaves}) == sum(len(p.leaves) for p in found) == len({tuple(x) for x in convs})
    for p in found:  # a shared beginning stands once in its pack
        assert len(p.nodes) == len({"".join(p.text[a.start : a.stop] for a in n.attends) for n in p.nodes})


def test_chat_rows_without_an_id(spark):
    rows = [(None, k, "user", f"t{k % 3}") for k in range(50)]
    convs = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(len(r.turns) for r in convs.collect()) == [1] * 50
    assert sum(len(p.leaves) for p in chat.packs(convs).collect()) == 3


def test_chat_of_nothing(spark):
    assert chat.packs(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def brute_top(rows, ids, queries_, k):
    whole = lambda v: [int(np.floor(1024 * float(x))) for x in v]
    good = [(i, whole(v)) for i, v in zip(ids, rows, strict=True) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in dict((i, v) for i, v in good if i in queries_).items():
        scored = [(-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(v, w, strict=False)))), i is None, i or 0) for i, w in good if i != q]
        out += [(q, n, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("scale", "block", "rows"), [(1.0, 256, 8192), (1.0, 16, 60), (1e5, 256, 8192), (1e15, 256, 8192)])
def test_top_k(spark, monkeypatch, scale, block, rows):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLICE_ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk.search_slice, "__defaults__", (block,))
    r = np.random.default_rng(1)
    vectors = [(np.round(x * 4) / 4 * scale).tolist() for x in r.normal(size=(300, 6))]
    vectors[17], vectors[18], vectors[19], vectors[20] = None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [float("inf")] * 6
    vectors[21], vectors[22] = [0.5 * scale, -0.5 * scale], []
    ids = [*range(299), None]
    asked = [0, 10, 18, 21, 22, 50, 60, 70, 80]
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, query string")
    found = topk.top_k(df, df.where(F.col("vec_id").isin(asked)))
    assert sorted(map(repr, (tuple(x) for x in found.collect()))) == brute_top(vectors, ids, asked, 10)


def test_top_k_prunes(monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(16, 32)) * 4
    rows = np.floor(1024 * (centres[np.repeat(np.arange(16), 256)] + r.normal(size=(4096, 32)) / 8))
    calls, real = [], topk.best
    monkeypatch.setattr(topk, "best", lambda *a: calls.append(1) or real(*a))
    queries_ = rows[::256]
    found = topk.search_slice(queries_, np.arange(0, 4096, 256), rows, np.arange(4096), 10)
    for k, (places, scores) in enumerate(found):
        s = queries_[k] @ rows.T
        s[256 * k] = -np.inf
        assert sorted(scores, reverse=True) == sorted(s, reverse=True)[:10] and len(places) == 10
    assert len(calls) < 16 * 8  # of 16 times 16 blocks


def test_top_k_sends_what_survives(spark, monkeypatch):
    """Of blocks of clustered vectors few are sent to a group of queries, and the answer is exact."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(24, 16)) * 4
    vectors = (centres[np.repeat(np.arange(24), 120)] + r.normal(size=(2880, 16)) / 8).tolist()
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 6)
    tables, real = {}, topk.written
    monkeypatch.setattr(topk, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    asked = list(range(0, 2880, 60))
    found = topk.top_k(df, df.where(F.col("vec_id") % 60 == 0))
    assert sorted(map(repr, (tuple(x) for x in found.collect()))) == brute_top(vectors, range(2880), asked, 10)
    blocks, groups = tables["blocks"].count(), tables["queries"].select("group").distinct().count()
    assert groups == 8 and tables["survivors"].count() < 0.4 * blocks * groups


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, df).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, d)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())
