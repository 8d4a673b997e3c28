"""SimHash near duplicates found by anchor-point covering.

A document's fingerprint has a bit for each bit position of its shingles' 64-bit hashes, set where over
half of them have it. Fingerprints link at `DISTANCE` or fewer differing bits.

Covering. The 64 bits are three bands of 22, 21 and 21 bits. Four differing bits leave two of the bands
with at most two between them, so each pair of bands is searched with threshold 2. The anchors of a band
are the 4,096 words of the perfect binary Golay code, whose covering radius is 3: every value of a band
has one anchor within 3, its home. Between two values that differ in two bits lies one that differs from
either in one bit, and its homes are within 3 + 1 of both. So a fingerprint is replicated to the anchors
of a band pair within the covering radius plus its share of the threshold: home in one band and any
anchor within 4 in the other, about 29 anchor pairs altogether out of 3 * 2**24. Fingerprints linked
meet at one of them at least, whatever the data. Those that meet are compared bit by bit.

Equal fingerprints are one node, so copies cost nothing. Where up to `CELL` fingerprints meet, one task
compares them as they come sorted; where more do, their anchor is split into blocks and pairs of blocks,
each again at most a cell's work. Cells give links that connect what they found, not all its pairs.

Nulls, empty and repeated rows: a null or empty text has no shingles and the fingerprint zero, linked like
any other. A null `doc_id` never names a component unless all its documents have none. Rows of one
`doc_id` count each on their own and the result has a row for each. An empty table gives no rows. Other
columns are left out. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.frames import stored
from askmill.llm.graph import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints at one anchor that one task compares.
CELL = 2048
#: First bit and number of bits of the bands, and the pairs of bands searched.
BANDS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Generator of the Golay code of 23 bits: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
_LENGTH, _CHECKS = 23, 11


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)], "<u8")
    count = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        some = hashes[start : start + (1 << 16)]
        bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and bits: the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, bits bigint")


def _syndromes(values: np.ndarray) -> np.ndarray:
    """Remainders of the values, as polynomials over two elements, by the code's generator."""
    left = values.astype(np.int64)
    for bit in range(_LENGTH - 1, _CHECKS - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - _CHECKS)), left)
    return left


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the error patterns of up to 4 bits, lightest first: values, starts, ends."""
    ones = [1 << i for i in range(_LENGTH)]
    patterns, layer = [0], {0}
    for _ in range(4):
        layer = {p | o for p in layer for o in ones if not p & o}
        patterns += sorted(layer)
    patterns = np.array(patterns)
    of = _syndromes(patterns)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=1 << _CHECKS)
    ends = np.cumsum(counts)
    return patterns[order], ends - counts, ends


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within 4 of 23-bit values: the position of each value, its anchor, and whether it is its home.

    An anchor is named by its upper 12 bits, which tell the code words apart.
    """
    patterns, starts, ends = _cosets()
    at = _syndromes(values)
    counts = ends[at] - starts[at]
    owner = np.repeat(np.arange(len(values)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    error = patterns[starts[at][owner] + within]
    return owner, (values[owner] ^ error) >> _CHECKS, within == 0


def replicas(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of fingerprints and the anchor pairs they are replicated to."""
    bits = bits.astype(np.uint64)
    rows, keys = [], []
    band = [anchors(((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in BANDS]
    homes = [anchor[home] for _, anchor, home in band]
    for number, (i, j) in enumerate(PAIRS):
        for one, other, first in ((i, j, True), (j, i, False)):
            owner, anchor, home = band[other]
            if not first:  # both homes have been taken above
                owner, anchor = owner[~home], anchor[~home]
            key = (homes[one][owner] << 12 | anchor) if first else (anchor << 12 | homes[one][owner])
            rows.append(owner)
            keys.append(key | number << 24)
    return np.concatenate(rows), np.concatenate(keys)


def linked(bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, that connect all of the distinct fingerprints within `distance`.

    A search from each in turn over those not reached yet: at most one link for each, however many pairs.
    """
    left = np.arange(len(bits))
    sources, ends = [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= distance
            found = left[near]
            if len(found):
                sources.append(np.full(len(found), at))
                ends.append(found)
                front.extend(found.tolist())
                left = left[~near]
    if not sources:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sources), np.concatenate(ends)


def _sorted_cells(keys: np.ndarray, bits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Short runs are compared all at once, a shift at a time."""
    new = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    sizes = np.diff(np.append(new, len(keys)))
    a, b = [], []
    for start, size in zip(new[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        i, j = linked(bits[start : start + size], distance)
        a.append(i + start)
        b.append(j + start)
    place = np.arange(len(keys)) - np.repeat(new, sizes)
    rest = np.flatnonzero((np.repeat(sizes, sizes) <= 16) & (np.repeat(sizes, sizes) > 1))
    ends = np.repeat(sizes, sizes)
    for shift in range(1, 16):
        rest = rest[place[rest] + shift < ends[rest]]
        if not len(rest):
            break
        near = np.bitwise_count(bits[rest] ^ bits[rest + shift]) <= distance
        a.append(rest[near])
        b.append(rest[near] + shift)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _cells(batches: Iterator[tuple[np.ndarray, np.ndarray]], distance: int, most: int):
    """Over rows sorted by key: links of cells up to `most`, and the rows of larger cells as they are.

    Gives (links or not, two arrays). A cell that runs on over batches is kept until it is whole or too large.
    """
    held_keys, held, large = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for keys, bits in batches:
        if large is not None:
            own = keys == large
            if own.any():
                yield False, keys[own], bits[own]
                keys, bits = keys[~own], bits[~own]
            if not len(keys):
                continue
            large = None
        keys, bits = np.concatenate([held_keys, keys]), np.concatenate([held, bits])
        sizes = np.unique(keys, return_counts=True)
        for key in sizes[0][sizes[1] > most].tolist():
            own = keys == key
            yield False, keys[own], bits[own]
            if key == keys[-1]:
                large = key
            keys, bits = keys[~own], bits[~own]
            if large is not None:
                break
        if not len(keys):
            held_keys, held = keys, bits
            continue
        cut = len(keys) if large is not None else int(np.searchsorted(keys, keys[-1]))
        if cut:
            a, b = _sorted_cells(keys[:cut], bits[:cut], distance)
            if len(a):
                yield True, bits[a], bits[b]
        held_keys, held = keys[cut:], bits[cut:]
    if len(held):
        a, b = _sorted_cells(held_keys, held, distance)
        if len(a):
            yield True, held[a], held[b]


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        yield batch["key"].to_numpy(), batch["bits"].to_numpy().view(np.uint64)


def links(nodes: DataFrame, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (bits) of `nodes` within `distance` bits."""
    if distance > DISTANCE:
        raise ValueError("the bands are laid out for 4 differing bits")
    kinds = "found boolean, a bigint, b bigint"

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch["bits"].to_numpy()
            for start in range(0, len(bits), 8192):
                some = bits[start : start + 8192]
                rows, keys = replicas(some.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(some[rows])], names=["key", "bits"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, a, b in _cells(_arrays(batches), distance, cell):
            a, b = (x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), found)), pa.array(a), pa.array(b)], names=["found", "a", "b"])

    placed = nodes.select("bits").mapInArrow(replicate, "key int, bits bigint")
    met = stored(placed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, kinds), "anchors")
    hot = met.where("not found").select(F.col("a").alias("key"), F.col("b").alias("bits"))
    small = met.where("found").select("a", "b")

    # Anchors with more than a cell of fingerprints: blocks by hash, and a cell for each pair of blocks.
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(cell)).cast("int").alias("blocks"))
    blocks = stored(blocks, "large-anchors")
    if blocks.isEmpty():
        return small
    own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    dealt = hot.join(blocks, "key").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "bits")

    def pairs(rows: pa.Table) -> pa.Table:
        bits = rows["bits"].to_numpy().view(np.uint64)
        i, j = linked(bits, distance)
        return pa.table({"a": pa.array(bits[i].view(np.int64)), "b": pa.array(bits[j].view(np.int64))})

    return small.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(pairs, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, bits and component_id, the smallest doc_id that links lead to from it, itself included."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, distance), "a", "b")
    in_links = nodes.join(roots, F.col("bits") == F.col("node")).select("bits", "root", "least")
    first = in_links.groupBy("root").agg(F.min("least").alias("component_id"))
    named = in_links.join(first, "root").select("bits", "component_id")
    single = nodes.join(roots, F.col("bits") == F.col("node"), "left_anti").select("bits", F.col("least").alias("component_id"))
    names = stored(named.unionByName(single), "components")
    return marked.join(names, "bits").select("doc_id", "bits", "component_id")
