"""Every operator on awkward tables: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askmill.llm import collisions, dom_crf, hilbert, imatch, mixing, nbsvm, packing, simhash, token_files, tool_calls
from askmill.llm.queries import BYTE_BPE, SCHEMAS, WORD_BPE

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, _row string, key string, score string"
TEXTS = ["", "one", "Two words", None, "a b c d e f g", "é ü\n\n  x\t|y", "long " * 30_000, "a b c d e f g", "a b c d e f g"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows and ids, and columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 3 else None, None, "x", "y", "z", None) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, 5, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [(2, "Two words", "en", "s2", 9, "x", "y", "z", None)] * 2
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


@cache
def loaded(path):
    return Tokenizer.from_file(path)


def encoded(path, text, end):
    tokenizer = loaded(path)
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4").tobytes()


def test_imatch(odd, none):
    rows = imatch.fingerprinted(odd).collect()
    own = texts_of(odd)
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((i, len(t)) for i, t in own)
    assert len({r.fingerprint for r in rows if r.n_chars == 13}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert imatch.fingerprinted(none).count() == 0
    alone = imatch.fingerprinted(odd.where("doc_id = 4")).first()
    assert alone.near_next == 1 and alone.fingerprint


def test_mixing(odd, none):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count() and mixing.mixed(none).count() == 0
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    sizes = {s: sum(r.size for r in rows if r.source == s) for s in {r.source for r in rows}}
    assert all(r.source_size == sizes[r.source] and r.target <= 2 * r.source_size for r in rows)
    taken = sum(r.taken for r in rows)
    documents = mixing.mixed_documents(odd)
    assert documents.columns == odd.columns
    assert documents.select(F.sum(mixing.words(F.col("text")))).first()[0] == taken


def test_hilbert(odd, none):
    rows = hilbert.sharded(odd).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == odd.count() and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of(odd)
    )
    assert hilbert.sharded(none).count() == 0


def test_packing(odd, none):
    rows = packing.sequences(odd, WORD_BPE).collect()
    lengths = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == lengths[r.sequence_id] and len(r.ids) == 4 * r.length
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= packing.CAPACITY and sorted(lengths) == list(range(len(lengths)))
    whole = Counter()
    for i, t in texts_of(odd):
        whole[i] += len(encoded(WORD_BPE, t, 1)) // 4
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == whole
    assert packing.sequences(none, WORD_BPE).count() == 0


def test_token_files(odd, none, tmp_path):
    files = token_files.write(odd, BYTE_BPE, folder=str(tmp_path / "files"))
    keys = odd.select("doc_id").distinct()
    rows = sorted(token_files.read(files, token_files.lookup(files, keys)).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, encoded(BYTE_BPE, t, 0)) for i, t in texts_of(odd))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    unknown = keys.sparkSession.createDataFrame([(10**9,)], "doc_id long")
    assert token_files.lookup(files, unknown).count() == 0
    assert token_files.written_and_read(none, BYTE_BPE).count() == 0


def test_token_files_of_one_key(spark, tmp_path):
    """A key's documents lie in several shards, and so do those without one; -1 is a key like any other."""
    ids = [7] * 3000 + [None] * 2500 + [-1, 8]
    docs = spark.createDataFrame([(i, f"text {n % 50}") for n, i in enumerate(ids)], "doc_id long, text string")
    whole = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(whole, "false")
    try:
        files = token_files.write(docs, BYTE_BPE, folder=str(tmp_path / "files"))
    finally:
        spark.conf.set(whole, "true")
    assert files.shards.count() > 3
    found = token_files.lookup(files, docs.select("doc_id").distinct())
    assert found.where("last > shard and doc_id = 7").count() == found.where("last > shard and doc_id is null").count() == 1
    rows = sorted(token_files.read(files, found).collect(), key=lambda r: r.start)
    want = {f"text {n}": encoded(BYTE_BPE, f"text {n}", 0) for n in range(50)}
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, want[t]) for i, t in texts_of(docs))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))


def test_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    by_text = {t: simhash.fingerprint(t) for _, t in texts_of(odd)}
    assert Counter((r.doc_id, r.bits % 2**64) for r in rows) == Counter((i, by_text[t]) for i, t in texts_of(odd))
    assert {r.component_id for r in rows if r.doc_id in (4, 7, 8)} == {4}
    assert {r.component_id for r in rows if r.doc_id in (0, 3)} == {0}
    assert simhash.near_duplicates(none).count() == 0


def test_nbsvm(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (99, 0), (3, 7), (2, None)], "doc_id long, label int")
    model = nbsvm.train(odd, labels)
    rows = nbsvm.scored(odd, model)
    assert rows.columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    assert rows.count() == odd.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.collect())
    assert nbsvm.scored(none, nbsvm.train(none, labels)).count() == 0
    one = nbsvm.train(odd, labels.where("label = 1"))
    assert {r.score for r in nbsvm.scored(odd, one).collect()} == {0.5}


def test_dom_crf(spark):
    page = "<html><body><nav><a>Home</a></nav><article><h1>T</h1><p>Some words &amp; more,\n here.</article><footer>end"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (3, None, ""), (4, "u", "<p"), (5, "u", "<article>" + "<p>x y" * 5_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = dom_crf.extracted(pages, dom_crf.train(pages, sample=6)).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert {r.text for r in out if r.page_id == 1} == {"T\nSome words & more, here."}
    assert [r.text for r in out if r.page_id is None] == [""]
    empty = pages.where("false")
    assert dom_crf.extracted(empty, dom_crf.train(empty)).count() == 0


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", None, "search", '{"limit": 3, "query": "x"}', 0),
            (1, 3, "b", "a", "search", '{"query": 3, "limit": 3}', 0),
            (1, 5, "c", "b", "route", "[1]", 0),
            (1, 7, "a", None, "search", "{}", 0),
            (2, 1, "p", "q", "measure", '{"limit": 1.5, "z": null}', 0),
            (2, 3, "q", "p", "measure", '{"limit": 1}', 0),
            (2, 5, "r", "none", "guess", None, 0),
            (None, None, None, None, None, None, None),
        ],
        "conv_id long, turn long, call_id string, parent_id string, name string, arguments string, row long",
    )
    results = spark.createDataFrame(
        [(1, 2, "a", 'said "x"'), (1, 8, "a", None), (1, 4, "zz", "lost"), (None, 1, "a", "x")],
        "conv_id long, turn long, call_id string, content string",
    )
    schemas = spark.createDataFrame(SCHEMAS, "name string, parameter string, kind string, required boolean")
    out = tool_calls.linked(calls, results, schemas).collect()
    state = {(r.conv_id, r.turn, r.kind): (r.status, r.depth) for r in out}
    assert len(out) == 12
    assert state[1, 1, "call"] == ("ok", 0) and state[1, 3, "call"] == ("wrong_type", 1)
    assert state[1, 5, "call"] == ("malformed", 2) and state[1, 7, "call"][0] == "repeated"
    assert state[2, 1, "call"] == state[2, 3, "call"] == ("cycle", None) and state[2, 5, "call"] == ("unknown_tool", 0)
    assert state[1, 4, "result"][0] == "orphan" and state[1, 8, "result"] == ("linked", 0)
    place = {(r.conv_id, r.turn): r.position for r in out}
    assert place[1, 1] < place[1, 2] < place[1, 3] < place[1, 5] and place[1, 1] < place[1, 8]
    message = {(r.conv_id, r.turn): r.message for r in out}
    assert message[1, 1] == '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","role":"assistant","status":"ok"}'
    assert message[1, 2] == '{"content":"said \\"x\\"","name":"search","role":"tool","tool_call_id":"a"}'
    assert message[1, 8].startswith('{"content":null')
    assert tool_calls.linked(calls.where("false"), results.where("false"), schemas).count() == 0


def test_tool_calls_in_one_chain(spark):
    """All rows in one conversation: a chain of calls, a crowded turn, and many rows alike."""
    n = 300
    chain = [(1, i, f"c{i}", f"c{i - 1}" if i else None, "search", '{"limit":1,"query":"x"}') for i in range(n)]
    calls = spark.createDataFrame(chain, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string")
    said = [(1, i, f"c{i}", "done") for i in range(n)]
    crowd = [(1, 5, "lost", "x" * (200 + i % 100) + str(i)) for i in range(200)] + [(1, None, None, "same")] * 500
    results = spark.createDataFrame(said + crowd, "conv_id long, turn long, call_id string, content string")
    schemas = spark.createDataFrame(SCHEMAS, "name string, parameter string, kind string, required boolean")
    out = sorted(tool_calls.linked(calls, results, schemas).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(2 * n + 700))
    assert [(r.turn, r.kind) for r in out[: 2 * n]] == [(i // 2, "result" if i % 2 else "call") for i in range(2 * n)]
    rest = [(r.turn is not None, r.turn or 0, r.call_id or "", r.message) for r in out[2 * n :]]
    assert rest == sorted(rest)
    assert not [v for v in spark.catalog.listTables() if "conversations" in v.name or "argument" in v.name]


def test_collisions(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((30, 16))
    near = base[:10] + 0.01 * rng.standard_normal((10, 16))
    vectors = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    vectors += [(100, base[0].tolist()), (100, base[0].tolist()), (None, base[1].tolist()), (101, None), (102, [0.0] * 16), (103, [])]
    vectors += [(104, [1.0, None, 2.0]), (105, [float("nan")] * 16), (106, [1.0, 0.0]), (107, [2.0, 0.0]), (108, [float("inf"), 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    rows = collisions.near_duplicates(df).collect()
    assert len(rows) == len(vectors)
    by_id = {r.vec_id: r for r in rows}
    assert by_id[0].n_links == 3 and by_id[100].n_links == 3 and by_id[100].component_id == 0 and not by_id[100].kept
    assert by_id[1].n_links == 2 and by_id[None].component_id == 1
    assert by_id[106].n_links == 1 and by_id[107].component_id == 106
    for i in (20, 101, 102, 103, 104, 105, 108):
        assert by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept
    assert collisions.near_duplicates(df.where("false")).count() == 0
