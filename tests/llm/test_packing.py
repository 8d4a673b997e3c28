"""Full windows are numbered without a group's work."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from askmill.llm import packing, wordids
from askmill.llm.queries import WORD_BPE, op4_packing


def test_groups_hold_no_full_windows(spark, monkeypatch):
    rows = [(n, k * 2048, 2048, n << 40 | k) for n in range(3) for k in range(500)] + [(9, 0, 100 + n, 9 << 40 | n) for n in range(50)]
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, deal long").repartition(3)
    made, stored = {}, packing.stored

    def noted(df, name):
        made[name] = stored(df, name)
        return made[name]

    monkeypatch.setattr(packing, "stored", noted)
    out = packing.packed(cut).collect()
    assert made["windows"].count() == 50
    assert sorted((r.doc_id, r.start, r.length) for r in out) == sorted(r[:3] for r in rows)
    loads = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == loads.get(r.sequence_id, 0)
        loads[r.sequence_id] = r.offset + r.length
    assert sorted(loads) == list(range(len(loads))) and max(loads.values()) <= 2048


def test_pieces_hold_the_ids_of_the_plain_call(spark):
    texts = [None, "", "one <|endoftext|> two", "<|startoftext|>", "a\u00a0b  c", "word " * 9000, "x" * 7000, "tail"]
    docs = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {n: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for n, t in enumerate(texts)}
    got = {}
    for r in packing.pieces(docs, WORD_BPE).collect():
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        got.setdefault(r.doc_id, []).append((r.start, ids))
    assert {n: [i for _, ids in sorted(parts) for i in ids] for n, parts in got.items()} == want
    for parts in got.values():
        at = 0
        for start, ids in sorted(parts):
            assert start == at
            at += len(ids)


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: [*plain.encode(r.text or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    covered = dict.fromkeys(want, 0)
    for r in sorted(op4_packing(spark, folder).collect(), key=lambda r: (r.doc_id, r.start)):
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == covered[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        covered[r.doc_id] += r.length
    assert covered == {n: len(ids) for n, ids in want.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_and_white_space_have_the_ids_of_plain_calls(name):
    rng = random.Random(8)
    parts = ["a", "b|", "word", "é", "漢", " ", "  ", "\n", "\t", "\r", "\0", "\x0b", "\x1d", "\x85", "\xa0", " ", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, [4, 1, 4, 1, 1, 8, 0.3, 3, *[0.2] * 9], k=rng.randint(0, 12))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "\n\n", "a\n", "\na", "\0", "a \0"]
    encoder = wordids.WordIds(public_tokenizers.path(name), cached=200)
    plain = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(own, encoder.width).tolist() for own in encoder.encode(texts)] == plain
    assert sum(encoder._words(t or "") is not None for t in texts) > 500


def test_no_pattern_runs_over_plain_texts(monkeypatch):
    monkeypatch.setattr(wordids, "_PIECES", None)
    encoder = wordids.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert [len(own) // 2 for own in encoder.encode(["one two\nthree"])] == [4]
