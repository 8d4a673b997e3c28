"""The lexicon against counted words."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from askmill.llm import imatch
from askmill.llm.wordhash import word_hashes


def hashed(word):
    return int(word_hashes(np.frombuffer(word.encode(), np.uint8))[0])


def test_terms_of_one_slot_are_told_apart(spark):
    by_slot = {}
    for i in range(30_000):
        by_slot.setdefault(int(imatch.slots(np.array([hashed(f"w{i}")], np.uint64))[0]), []).append(f"w{i}")
    (stop, rare), (one, other) = [v[:2] for v in by_slot.values() if len(v) > 1][:2]
    texts = [f"{stop} {stop.upper()} a{i} b{i // 4} c{i % 7}" for i in range(100)]
    for i in range(5):
        texts[i] += f" {rare}"
    texts[10] += f" {one}"
    texts[20] += f" {other}"
    counts = Counter(w for t in texts for w in set(t.lower().split()))
    low, high = (len(texts) ** (1 - x) for x in (imatch.BAND[1], imatch.BAND[0]))
    want = {hashed(w) for w, n in counts.items() if max(2, low) <= n <= high}
    assert hashed(rare) in want and not {hashed(w) for w in (stop, one, other)} & want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = np.asarray(imatch.lexicon(docs))
    assert got.dtype == np.uint64 and got.tolist() == sorted(want)
    marks = imatch.fingerprints([f"{w} b1 b2 b3 b4".encode() for w in (rare, stop, one, other)], imatch.occupied(got), got)
    assert (marks[1] == marks[2]).all() and (marks[1] == marks[3]).all() and (marks[0] != marks[1]).any()


def test_frequencies_of_nested_texts(spark):
    docs = spark.createDataFrame([(" ".join(f"t{j}" for j in range(i)),) for i in range(60)], "text string")
    whole = {r.bucket: (bytes(r.terms), bytes(r.counts)) for r in imatch.frequencies(docs).collect()}
    total = sum(len(t) for t, _ in whole.values()) // 8
    assert total == 59
    assert sum(np.frombuffer(c, np.int64).sum() for _, c in whole.values()) == 60 * 59 // 2


def plain(text: str, band: set[int]) -> list[int]:
    """A fingerprint by the definition: every subset hashed on its own."""
    terms = sorted({hashed(w) for w in text.split()})
    kept = [t for t in terms if t in band]
    kept = kept if len(kept) >= imatch.LEAST else terms
    hash_ = lambda x: int(imatch.mix(np.array([x % 2**64], np.uint64))[0])
    out = []
    for replica in range(imatch.REPLICAS):
        draws = [(t, hash_(t + imatch.SEED + replica)) for t in kept]
        for level in range(imatch.LEVELS):
            inside = [hash_(d ^ t) for t, d in draws if d % 2 ** (level + 1) == 0]
            total = sum(inside) % 2**64
            out.append(max(hash_(total) >> 48, 1) if total else 0)
    return out


def alike(a: list[int], b: list[int]) -> float:
    pairs = [(x, y, 2.0 ** (n % imatch.LEVELS)) for n, (x, y) in enumerate(zip(a, b, strict=True)) if x or y]
    return sum(w for x, y, w in pairs if x == y) / sum(w for _, _, w in pairs) if pairs else 1.0


def test_every_column_by_the_definition(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choices(words, k=draw.randrange(25))) for _ in range(40)] + ["", "é" * 7, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in imatch.fingerprinted(docs).collect()}
    held = Counter(w for t in texts for w in set((t or "").split()))
    low, high = (len(texts) ** (1 - x) for x in reversed(imatch.BAND))
    band = {hashed(w) for w, n in held.items() if max(2, low) <= n <= high}
    texts = [t or "" for t in texts]
    hexed = lambda marks: np.array(marks, "<u2").tobytes().hex()
    for n, text in enumerate(texts):
        after = texts[n - 1]  # descending doc_id; after the last comes the first
        half = len(text) // 2
        other = text[: len(text) - half] + after[:half]
        own, changed, following = (plain(t, band) for t in (text, other, after))
        row = found[n]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (hexed(own), hexed(changed))
        assert abs(row.near_edited - alike(own, changed)) < 1e-12 and abs(row.near_next - alike(own, following)) < 1e-12
