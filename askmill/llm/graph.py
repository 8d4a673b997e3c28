"""Connected components of a graph that is never in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.frames import stored

ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node that these links connect each with: a link for each node at most."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[one], root[two])
        before = root.copy()
        for end in (one, two):
            np.minimum.at(root, before[end], least)
            np.minimum.at(root, end, least)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(batch["u"].to_numpy(), batch["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node with a link; root is the smallest node that can be reached.

    Nodes are numbers. Every batch of links is first reduced to a link for each of its nodes at most.

    Large-star and small-star rounds: first every node sends its larger neighbours to its smallest one,
    then every node its smaller ones. Links only ever move to smaller nodes, and after a number of rounds
    that grows with the logarithm of the longest path all point at their roots. A node's neighbours are
    only reduced to their least and joined back, so a node with very many of them is no one task's work:
    least values are combined before the shuffle and the join splits such nodes. Rounds are stored, and
    the driver sees their row counts and checksums.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    given = links.where(F.col(a) != F.col(b)).select(high.cast("long").alias("u"), low.cast("long").alias("v"))
    edges = stored(given.mapInArrow(_forests, "u bigint, v bigint").distinct(), "links")
    mark = None
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "roots")
