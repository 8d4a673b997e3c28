"""Mixing sources to target weights by fitting a budget of words as a subset sum.

Documents of a source are counted by exact length. A source whose target is above its size is first taken
whole; the rest of its target is the budget for one more copy of some documents. Most of the budget is
spread over all lengths in proportion, the longest documents that still fit come next, and bounded-knapsack
dynamic programming over the lengths not used up fits what remains to the word. Documents are then drawn
by length: as many of each length as the fit says, in the order of a seeded hash.

Only counts by length reach the fit: one row for each length of a source, however many documents there
are. A length shared by very many documents is drawn in buckets of the hash, so no task sorts them all.

Nulls, empty and repeated rows: a null text has no words; documents without words are taken never, which
costs nothing. A null source is a source, last in order. Rows with a null or repeated `doc_id` count each
on their own; where such rows are alike, which of them is taken makes no difference. An empty table gives
no rows. `mixed` gives doc_id, source and the new columns; `mixed_documents` gives all columns as they were.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.frames import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 17
#: The budget that dynamic programming fits at most, in words.
KNAPSACK = 4096

_NEW = ["size", "source_size", "target", "taken"]


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of `total` by weight, none above `most` times its size; what is cut off is shared out again."""
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s]
    left = min(total, most * sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * unit > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in over]
    return out


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length make the largest sum up to `budget`.

    Sums that can be reached are the bits of one integer; counts are split into powers of two.
    """
    items, reach, steps = [], 1, []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        left, some = min(counts[i], budget // lengths[i]), 1
        while left and not reach >> budget & 1:
            some = min(some, left)
            steps.append(reach)
            items.append((i, some))
            reach = (reach | reach << lengths[i] * some) & ((1 << budget + 1) - 1)
            left -= some
            some *= 2
    out, at = [0] * len(lengths), reach.bit_length() - 1
    for (i, some), before in zip(reversed(items), reversed(steps), strict=True):
        if not before >> at & 1:
            out[i] += some
            at -= lengths[i] * some
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int = KNAPSACK) -> np.ndarray:
    """How many documents of each length (ascending) come nearest to `budget` words from below."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = max(0.0, budget - 2.0 * int(lengths.max(initial=0))) / total
    ends = np.floor(np.cumsum(counts) * share + 0.5).astype(np.int64)
    take = np.minimum(np.diff(ends, prepend=0), counts)
    left = budget - int((take * lengths).sum())
    while left < 0:
        i = int(np.flatnonzero(take)[-1])
        less = min(int(take[i]), -(left // int(lengths[i])))
        take[i] -= less
        left += less * int(lengths[i])
    for i in range(len(lengths) - 1, -1, -1):
        if left <= most:
            break
        more = min(int(counts[i] - take[i]), left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    some = np.flatnonzero((lengths <= min(left, most)) & (take < counts))
    more = knapsack(lengths[some].tolist(), (counts - take)[some].tolist(), min(left, most))
    take[some] += np.asarray(more, np.int64)
    return take


def mixed(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED
) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words the mix takes, repeats counted.

    Weights go to the sources in code point order, repeating, null last. The list of sources, one row
    each with its size, is read by the driver to share the budget out.
    """
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    sized = stored(sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    return _mixed(sized, weights, share, most).select("doc_id", "source", *_NEW)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, a document taken twice as two rows; columns as in `docs`."""
    whole = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("_row")), "documents")
    sized = whole.select("_row", "doc.doc_id", "doc.source", words(F.col("doc.text")).alias("size"))
    seed = options.get("seed", SEED)
    sized = stored(sized.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")), "sizes")
    took = _mixed(
        sized, options.get("weights", WEIGHTS), options.get("share", SHARE), options.get("most", MOST)
    )
    times = took.where("taken > 0").select("_row", (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return whole.join(times, "_row").withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("doc.*")


def _mixed(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    spark = sized.sparkSession
    lengths = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    sources.sort(key=lambda r: (r.source is None, r.source or ""))
    total = share * sum(r.words for r in sources)
    goals = targets([r.words for r in sources], [weights[i % len(weights)] for i in range(len(sources))], total, most)
    goal = spark.createDataFrame(
        [(r.source, int(r.words), g) for r, g in zip(sources, goals, strict=True)],
        "source string, source_size long, target double",
    )

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        whole, size = int(rows["target"][0] // max(1, rows["source_size"][0])), int(rows["source_size"][0])
        whole = min(whole, most)
        live = (rows["size"] > 0).to_numpy()
        more = np.zeros(len(rows), np.int64)
        if whole < most:
            budget = round(float(rows["target"][0])) - whole * size
            more[live] = fit(rows["size"].to_numpy(np.int64)[live], rows["n"].to_numpy(np.int64)[live], budget)
        return rows.assign(whole=whole, more=more)[["source", "size", "n", "source_size", "target", "whole", "more"]]

    counts = stored(
        lengths.join(goal, lengths["source"].eqNullSafe(goal["source"]))
        .drop(goal["source"])
        .groupBy("source")
        .applyInPandas(
            chosen,
            "source string, size long, n long, source_size long, target double, whole long, more long",
        ),
        "counts",
    )
    # Documents of one source and length are drawn in the order of their hash. Its top bits part them into
    # as many buckets as a bucket has documents, so neither is many; a bucket is taken whole, not at all, or (one for each length) up to a place in it.
    buckets = F.ceil(F.sqrt(F.col("n")))
    top = F.shiftrightunsigned("draw", 33)
    dealt = sized.join(
        counts.withColumnRenamed("source", "_source").withColumnRenamed("size", "_size"),
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")),
    ).withColumn("bucket", F.floor(top * buckets / F.lit(float(1 << 31))))
    dealt = stored(dealt.drop("_source", "_size", "n"), "dealt")
    some = dealt.groupBy("source", "size", "bucket", "more").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("quota", F.col("more") - F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    split = some.where((F.col("quota") > 0) & (F.col("quota") < F.col("m"))).select("source", "size", "bucket", "quota")
    whole = some.where((F.col("quota") > 0) & (F.col("quota") >= F.col("m"))).select("source", "size", "bucket")
    quotas = split.unionByName(whole.withColumn("quota", F.lit(None).cast("long"))).select(
        F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"), "quota"
    )
    at = dealt.join(
        quotas.withColumn("hit", F.lit(True)),
        F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("size") == F.col("_size"))
        & (F.col("bucket") == F.col("_bucket")),
        "left",
    ).drop("_source", "_size", "_bucket")
    key = Window.partitionBy("source", "size", "bucket").orderBy("draw", *[c for c in ("doc_id", "_row") if c in sized.columns])
    parted = at.where("quota is not null").withColumn("extra", (F.row_number().over(key) <= F.col("quota")).cast("long"))
    plain = at.where("quota is null").withColumn("extra", F.coalesce(F.col("hit"), F.lit(False)).cast("long"))
    return plain.unionByName(parted).withColumn("taken", (F.col("whole") + F.col("extra")) * F.col("size"))
