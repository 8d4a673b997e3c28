"""Packing by Karmarkar-Karp multiway differencing.

A document's ids end in one end id and are cut into full windows first; what is left goes in pieces of at
most `PIECE` ids. Full windows are only numbered. The pieces are dealt into groups of about `GROUP_WINDOWS` windows each. In a group
every piece starts as a partial partition of one filled window; the two partitions with the largest
imbalance are merged again and again, fullest window onto emptiest, until one partition of near-equal
windows is left. Where its fullest window exceeds the capacity, the group is tried with one more window.

Nulls, empty and repeated rows: a null text is empty and still has its end id; rows with a null or
repeated `doc_id` are packed like any other, each on its own. An empty table gives no pieces. Columns
other than `doc_id` and `text` are left out. A text of any length is cut into as many windows as it needs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.frames import running_totals, stored
from askmill.llm.wordids import CACHED_WORDS, word_ids

CAPACITY = 2048
#: Longest piece of what remains of a document after its full windows: with several pieces to a window
#: the differencing comes out near equal; with whole remainders padding is about 4 % instead of 1 %.
PIECE = 512
#: Windows that one group fills. A group is one differencing problem: some 700 pieces, whatever the input.
GROUP_WINDOWS = 128

_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, deal bigint"


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, piece: int = PIECE, cached: int = CACHED_WORDS
) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids: the ids as little-endian unsigned 32-bit integers.

    `deal` differs from row to row; it deals pieces out to groups. `cached` words are kept by each Python worker.
    """

    def cut(n: int) -> Iterator[tuple[int, int]]:
        full = n - n % capacity
        yield from ((a, capacity) for a in range(0, full, capacity))
        yield from ((a, min(piece, n - a)) for a in range(full, n, piece))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, deal = word_ids(tokenizer, cached), TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in batched(zip(batch["doc_id"].to_pylist(), batch["text"], strict=True), 512):
                rows = []
                for (doc, _), own in zip(some, encoder.encode([t.as_py() for _, t in some]), strict=True):
                    ids = np.append(np.frombuffer(own, encoder.width), end_id).astype("<u4")
                    for start, length in cut(len(ids)):
                        rows.append((doc, start, length, len(ids), ids[start : start + length].tobytes(), deal))
                        deal += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "deal"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def differenced(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Multiway differencing of `sizes` into `windows` sets of their positions, emptiest first."""
    heap = []
    for turn, i in enumerate(np.argsort(-sizes, kind="stable").tolist()):
        loads = np.zeros(windows, np.int64)
        loads[-1] = sizes[i]
        heap.append((-int(sizes[i]), turn, loads, [()] * (windows - 1) + [(i,)]))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, loads, sets = heapq.heappop(heap)
        _, _, others, their = heapq.heappop(heap)
        loads = loads + others[::-1]
        order = np.argsort(loads, kind="stable")
        loads = loads[order]
        merged = [a + b for a, b in zip(sets, reversed(their), strict=True)]
        heapq.heappush(heap, (int(loads[0] - loads[-1]), turn, loads, [merged[i] for i in order.tolist()]))
        turn += 1
    return [list(s) for s in heap[0][3]]


def balanced(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Near-equal windows, as few as differencing can fill without one above `capacity`."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = differenced(sizes, windows)
        fullest = max(int(sizes[s].sum()) for s in sets)
        if fullest <= capacity:
            return [s for s in sets if s]
        windows += 1


def packed(cut: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Adds sequence_id, numbered from 0 without gaps, and offset, the piece's place in its sequence.

    `cut` has length and deal; its other columns travel along, so give narrow rows. A deal is a row's
    number, so groups are even whatever the documents are.
    """
    cut = stored(cut, "pieces")
    full, rest = cut.where(F.col("length") >= capacity), cut.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (group_windows * capacity)))
    kept = [f for f in cut.schema.fields if f.name != "deal"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    names = [f.name for f in kept]

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("deal", kind="stable").reset_index(drop=True)
        sets = balanced(rows["length"].to_numpy(np.int64), capacity)
        order = np.concatenate([np.asarray(s, np.int64) for s in sets])
        out = rows.loc[order, names]
        out["window"] = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        ends = out.groupby("window")["length"].cumsum()
        out["offset"] = ends - out["length"]
        out["pack_group"] = key[0]
        return out

    grouped = rest.withColumn("pack_group", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    filled = stored(
        grouped.groupBy("pack_group").applyInPandas(fill, f"{schema}, window bigint, offset bigint, pack_group bigint"),
        "windows",
    )
    counts = filled.groupBy("pack_group").agg((F.max("window") + 1).alias("windows"))
    firsts = running_totals(counts, ["pack_group"], "windows", "first")
    filled = filled.join(firsts.select("pack_group", "first"), "pack_group")
    # Full windows are no group's work: they are numbered along `deal`, and the filled ones after them.
    whole = running_totals(full.withColumn("_window", F.lit(1).cast("long")), ["deal"], "_window", "sequence_id")
    sequence = F.lit(full.count()) + F.col("first") + F.col("window")
    return whole.select(*names, "sequence_id", F.lit(0).cast("long").alias("offset")).unionByName(
        filled.select(*names, sequence.alias("sequence_id"), "offset")
    )


def sequences(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, offset, doc_id, start, length, ids: what a training job reads, one row per piece."""
    return packed(pieces(docs, tokenizer, end_id, capacity), capacity)
