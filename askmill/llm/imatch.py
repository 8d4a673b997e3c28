"""I-Match fingerprints over a band of inverse document frequency.

A text's terms are its words with A-Z in lower case, each known by a 64-bit hash. Document frequencies of all
documents are counted by term, and a term is kept where its frequency lies in the band: neither nearly
everywhere nor nearly nowhere, on the scale of log(N / df) / log N. The lexicon is the sorted terms in the
band, 8 bytes each; every task holds it, with a bit for each of `SLOTS` slots that spares most look-ups.
A text with fewer than `LEAST` terms in the band keeps all its terms.

The kept distinct terms are sorted, and hashed once for each of `REPLICAS` * `LEVELS` randomised subsets of
the lexicon: a subset of level k holds a seeded half of the lexicon's terms raised to the power k + 1, so
large subsets name a text as a whole and small ones hold one term or two of it. The fingerprint is all these
hashes. Two fingerprints are alike as far as their subsets agree: subsets that hold no term of either don't
count, and a subset counts by the size of the ones left out, as small subsets that agree say most. Equal
fingerprints have likeness 1, and equal texts equal fingerprints.

Nulls, empty and repeated rows: a null text is empty; a text without words has the fingerprint of no terms,
like only to itself. Rows are paired in descending `doc_id`, null last, ties in the order of their texts'
hashes; the only row of a table is next to itself. An empty table gives no rows. Other columns are left
out. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.frames import stored
from askmill.llm.wordhash import all_word_hashes, mix, raw_texts

#: Bits that tell quickly that a term is not in the lexicon.
SLOTS = 1 << 22
#: Ranges of terms that are added up each on their own.
BUCKETS = 1 << 10
#: Terms that a task counts before it sends them.
MOST = 1 << 22
#: The band on the scale of log(N / df) / log N: 0 for a term of every document, 1 for a term of one.
BAND = (0.1, 0.9)
LEAST = 4
REPLICAS = 10
LEVELS = 13
SEED = 11


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct terms of each text, and the text of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _summed(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct terms and the sums of their counts."""
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(terms)), bool), terms[1:] != terms[:-1]]))
    return terms[new], np.add.reduceat(counts, new) if len(new) else counts


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that the empty upper bytes cost nothing."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def frequencies(docs: DataFrame, low: float = 0, high: float = float("inf")) -> DataFrame:
    """bucket, terms, counts: the terms with a document frequency from low to high, sorted, and the frequencies.

    A task adds up its own documents' terms first, and sends them sorted, as packed differences, a row for each range.
    """

    def sent(held: list) -> pa.RecordBatch:
        terms, counts = held[0]
        ends = np.searchsorted(terms >> np.uint64(54), np.arange(BUCKETS + 1, dtype=np.uint64))
        rows = []
        for bucket in np.flatnonzero(np.diff(ends)).tolist():
            at = slice(ends[bucket], ends[bucket + 1])
            rows.append((bucket, _packed(np.diff(terms[at], prepend=np.uint64(0))), _packed(counts[at].astype("<u4"))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)],
            names=["bucket", "terms", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> list:
            return [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        for batch in batches:
            for _, hashes, counts in all_word_hashes(raw_texts(batch["text"])):
                terms, _ = _distinct(hashes, counts)
                held.append(_summed(terms, np.ones(len(terms), np.int64)))
                size += len(held[-1][0])
                if size > MOST:
                    held = merged()
                    size = len(held[0][0])
                    if size > MOST // 2:
                        yield sent(held)
                        held, size = [], 0
        if size:
            yield sent(merged())

    def add(rows: pa.Table) -> pa.Table:
        terms = np.concatenate([np.cumsum(_unpacked(t.as_py(), "<u8"), dtype=np.uint64) for t in rows["terms"]])
        counts = np.concatenate([_unpacked(c.as_py(), "<u4").astype(np.int64) for c in rows["counts"]])
        terms, counts = _summed(terms, counts)
        kept = (counts >= low) & (counts <= high)
        return pa.table({"bucket": rows["bucket"][:1], "terms": [terms[kept].tobytes()], "counts": [counts[kept].tobytes()]})

    kinds = "bucket int, terms binary, counts binary"
    # Splits that one task counts share their terms, so less is sent; as long as all cores have a task.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // 8)
    return docs.select("text").coalesce(tasks).mapInArrow(count, kinds).groupBy("bucket").applyInArrow(add, kinds)


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The sorted terms whose document frequency lies in the band."""
    rows = docs.count()
    low, high = (rows ** (1 - x) for x in (band[1], band[0]))
    found = frequencies(docs, max(2, low), high).select("bucket", "terms").collect()
    found.sort(key=lambda r: r.bucket)
    return np.frombuffer(b"".join(r.terms for r in found), np.uint64)


def occupied(terms: np.ndarray) -> np.ndarray:
    """Which slots have a term."""
    out = np.zeros(SLOTS, bool)
    out[slots(terms)] = True
    return out


def fingerprints(texts: list[bytes], kept: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """A row of `REPLICAS` * `LEVELS` hashes for each text; 0 where a subset holds none of its terms.

    Terms are kept that are in a slot of `kept` and, where it is given, in the sorted `known`.
    """
    out = np.zeros((len(texts), REPLICAS, LEVELS), np.uint16)
    for start, hashes, counts in all_word_hashes(texts):
        terms, owner = _distinct(hashes, counts)
        inside = kept[slots(terms)]
        if known is not None and len(known):
            maybe = np.flatnonzero(inside)
            at = np.minimum(np.searchsorted(known, terms[maybe]), len(known) - 1)
            inside[maybe] = known[at] == terms[maybe]
        few = np.bincount(owner[inside], minlength=len(counts)) < LEAST
        inside |= few[owner]
        terms, owner = terms[inside], owner[inside]
        for replica in range(REPLICAS):
            draw = mix(terms + np.uint64(SEED + replica))
            # trailing zeros: level k holds the terms with more than k of them
            level = np.minimum(np.bitwise_count((draw & (~draw + np.uint64(1))) - np.uint64(1)), LEVELS).astype(np.int64)
            own = mix(draw ^ terms)
            sums = np.zeros(len(counts) * (LEVELS + 1), np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(sums, owner * (LEVELS + 1) + level, own)
                sums = sums.reshape(len(counts), LEVELS + 1)[:, :0:-1].cumsum(axis=1, dtype=np.uint64)[:, ::-1]
            marks = (mix(sums) >> np.uint64(48)).astype(np.uint16)
            out[start : start + len(counts), replica] = np.maximum(marks, sums != 0)
    return out.reshape(len(texts), -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How alike fingerprints are, row by row, from 0 to 1."""
    weight = np.tile(2.0 ** np.arange(LEVELS), REPLICAS)
    counted = ((a != 0) | (b != 0)) @ weight
    return np.where(counted > 0, ((a == b) & (a != 0)) @ weight / np.maximum(counted, 1), (a == b).all(axis=1).astype(float))


def edited(text: str, after: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_MADE = {"edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_ROW = (
    "doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, part int, edge int, text string"
)


def fingerprinted(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents go to one range shuffle by `doc_id`, so the next document is the next row; the last row of a
    range meets the first of the next range in a join of two rows for each range.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon(docs, band))

    def row_batch(columns: dict, part: int, edge: int, texts: list) -> pa.RecordBatch:
        n = len(texts)
        columns |= {
            "part": pa.array([part] * n, pa.int32()),
            "edge": pa.array([edge] * n, pa.int32()),
            "text": pa.array(texts, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)

    def edge_row(doc_id: int | None, text: str, part: int, edge: int) -> pa.RecordBatch:
        void = {name: pa.nulls(1, kind) for name, kind in _MADE.items()}
        return row_batch({"doc_id": pa.array([doc_id], pa.int64()), "n_chars": pa.nulls(1, pa.int64()), **void}, part, edge, [text])

    def compared(ids: list, own: list[str], after: list[str], kept: np.ndarray, shifted: bool, part: int) -> pa.RecordBatch:
        """shifted: the next documents are the same ones but for the first, and one more."""
        n = len(own)
        changed = [edited(t, x).encode() for t, x in zip(own, after, strict=True)]
        others = [t.encode() for t in (after[-1:] if shifted else after)]
        marks = fingerprints([t.encode() for t in own] + changed + others, kept, sent.value)
        mine, theirs = marks[:n], marks[n : 2 * n]
        following = np.concatenate([mine[1:], marks[2 * n :]]) if shifted else marks[2 * n :]
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in own], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t).digest() for t in changed], pa.binary()),
            "fingerprint": pa.array([m.tobytes() for m in mine], pa.binary()),
            "edited_fingerprint": pa.array([m.tobytes() for m in theirs], pa.binary()),
            "near_edited": likeness(mine, theirs),
            "near_next": likeness(mine, following),
        }
        return row_batch(columns, part, 0, [None] * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, kept = TaskContext.get().partitionId(), None, occupied(sent.value)
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for start in range(0, len(ids), 512):
                own_ids, own = ids[start : start + 512], texts[start : start + 512]
                if held:
                    own_ids, own = [held[0], *own_ids], [held[1], *own]
                else:
                    yield edge_row(own_ids[0], own[0], part, 1)
                held = own_ids[-1], own[-1]
                if len(own) > 1:
                    yield compared(own_ids[:-1], own[:-1], own[1:], kept, True, part)
        if held:
            yield edge_row(*held, part, 2)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = occupied(sent.value)
        for batch in batches:
            yield compared(*(batch[c].to_pylist() for c in ("doc_id", "text", "after")), kept, False, 0)

    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # the row's number parts rows that are alike
    ranged = rows.repartitionByRange(*order, F.monotonically_increasing_id())
    made = stored(ranged.sortWithinPartitions(*order).mapInArrow(run, _ROW), "fingerprints")

    # One first and one last row for each range that has rows; the last range's next is the first range.
    parts = made.where("edge = 1").select("part")
    ring = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(ring)).alias("next_part"))
    firsts = made.where("edge = 1").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    lasts = made.where("edge = 2").join(following, "part").join(firsts, "next_part").select("doc_id", "text", "after")
    rows = made.where("edge = 0").unionByName(lasts.mapInArrow(joined, _ROW))

    return rows.select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
