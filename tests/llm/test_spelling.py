"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from askmill.llm import spelling
from askmill.llm.queries import QUERIES


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(words):
    rows, forms = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        form = min(close, key=lambda v: (-words[v], v)) if close else None
        forms[w] = form if form and words[form] >= 2 * n else None
        rows[w] = len(close)
    out = {}
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = forms[w], root, n, rows[w], words[forms[w]] if forms[w] else None
    return out


def rows_of(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_groups_equal_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abéÉ") for _ in range(rng.randint(1, 7))): rng.randint(1, 400) for _ in range(600)}
    words |= {"x" * k: 3**k for k in range(1, 9)}  # runs of one letter, a chain of forms
    long_ = "".join(rng.choice("abc") for _ in range(66))
    words |= {long_: 9, long_[1:]: 20, long_[:64]: 3, long_[:65]: 7, long_[:30] + "z" + long_[31:]: 50, "q" * 3000: 5, "q" * 2999 + "r": 50, "q" * 2999: 1}
    given = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.grouped(given)) == brute(words)
    pairs = [(r.word, r.near) for r in spelling.neighbours(given).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in words for b in words if near(a, b)}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (2, "Kettle kettle,KETTLE kettel ×Étages Étages"), (None, "kettle Étages kettles"), (None, "kettles kettles")]
    docs += [(4, "Étages kettle" * 3), (4, "w" * 100_000 + " " + "kettles " * 40_000)] + [(n, "settle kettle settles" + " kittle" * (n % 3 == 0)) for n in range(400)]
    given = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, word string")
    want = brute(count(docs))
    assert want["kittle"][1] == "kettles" and len(want) >= 6
    assert rows_of(spelling.grouped(spelling.counted(given, slips=97))) == want
    assert spelling.grouped(spelling.counted(given.where("false"))).count() == 0


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(QUERIES["op13_spelling"](spark, folder)) == brute(count(docs))
