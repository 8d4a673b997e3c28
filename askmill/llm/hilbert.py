"""Sharding along a Hilbert curve over document metadata.

Each dimension (source, language, length) is quantised into `2**BITS` bins of near equal row counts, a
row's bins are the corner of a cell, and rows are sorted by the cell's place on the Hilbert curve. Runs of
that order are the shards: neighbours on the curve are neighbours in every dimension, so the smallest and
largest values of a shard are narrow in all of them and a reader prunes files by any. The law is `rows`:
counts of shards differ by one at most.

Within a cell rows go by the hash of their text and then by `doc_id`, so equal texts of one source and
language lie side by side and a cell of any size can be cut.

Nulls, empty and repeated rows: a null dimension is in the lowest bin; a null text is empty and has
length 0. Rows that are alike throughout take neighbouring places, in either order. An empty table gives
no rows. Columns other than those named here are left out of the placement.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.llm.frames import running_totals, stored

DIMENSIONS = ("source", "lang", "n_chars")
#: Bins of a dimension as a power of two: 32 bins, so at most 32 edges reach the driver for each.
BITS = 5
SHARDS = 8


def curve_index(coordinates: list[np.ndarray], bits: int) -> np.ndarray:
    """The place on the Hilbert curve of cells with these coordinates.

    From the top bit down: where a coordinate's bit is set, the lower bits of the first are inverted, and
    where not, exchanged with that coordinate's; Gray decoding of the turned coordinates gives the place.
    """
    x = [np.asarray(c, np.int64).copy() for c in coordinates]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            on = (x[i] >> bit & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ turn) >> bit & 1)
    return place


def edges(df: DataFrame, name: str, bits: int = BITS) -> list:
    """The least value of each bin but the lowest: bins of near equal row counts, at most `2**bits`.

    Values are counted, and a value's bin is where the rows before it end; only the edges are collected.
    """
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    before = running_totals(counts, ["value"], "n", "before")
    rows = before.agg(F.sum("n")).first()[0]
    if not rows:
        return []
    bins = before.groupBy(F.floor(F.col("before") * (1 << bits) / F.lit(rows)).alias("bin"))
    return sorted(r.edge for r in bins.agg(F.min("value").alias("edge")).collect())[1:]


def quantised(value: Column, at: list) -> Column:
    bins = F.lit(0)
    for edge in at:
        bins = bins + F.coalesce((value >= F.lit(edge)).cast("int"), F.lit(0))
    return bins


def sharded(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, the dimensions, size, text_crc32, law, cell, shard and slot, the row's place in its shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "utf-8")
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            "lang",
            F.char_length(text).cast("long").alias("n_chars"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "metadata",
    )

    @F.pandas_udf("bigint")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(curve_index([a.to_numpy(), b.to_numpy(), c.to_numpy()], bits))

    rows = rows.withColumn("cell", place(*(quantised(F.col(d), edges(rows, d, bits)) for d in DIMENSIONS)))
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    order = ["cell", "text_hash", "text_crc32", "size", "doc_id"]
    total = rows.count()
    placed = running_totals(rows, order, "one", "place")
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select(
            "doc_id",
            *DIMENSIONS,
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "cell",
            F.col("shard").cast("int").alias("shard"),
            "slot",
        )
    )


def manifest(placed: DataFrame) -> DataFrame:
    """What a reader prunes by: for each shard its rows, bytes, and the range of every dimension."""
    ranges = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for f, n in ((F.min, "least"), (F.max, "most"))]
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *ranges)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Writes the documents as one folder of Parquet files for each shard, in curve order.

    `doc_id` must tell documents apart here.
    """
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
