"""First pages of searches without every match: blocks of posts, best bound first.

An index keeps its postings by block of posts. For each term and block, `bounds_of` keeps how often at most a post
of the block holds the term, and the least post. So the best relevance that a block can have for a request is known
before a posting of it is read, and a block that lacks one of the terms is never read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.operators import search as se
from askmill.plans.ordered import row_number
from askmill.session import stored

PAGE_SIZE = 30  # fixed value
SLACK = 6e-10  # relevances tie to nine digits
WIDER = 8


@dataclass(frozen=True)
class PagedIndex:
    """An index with the bounds of its blocks."""

    index: se.Index
    bounds: DataFrame


def bounds_of(index: se.Index) -> PagedIndex:
    """The stored bounds of an index: bucket, term, block, top (the largest tf), least (post_id)."""
    blocks = index.postings.groupBy("bucket", "term", "block").agg(F.max("tf").alias("top"), F.min("post_id").alias("least"))
    return PagedIndex(index, stored(blocks, "bounds", "bucket"))


def _reachable(drivers: DataFrame, paged: PagedIndex) -> DataFrame:
    """request_id, block, bound, least: the blocks that hold all terms of a request, and what they can reach."""
    needs = drivers.select("request_id", F.size("needs").alias("n"), F.explode("needs").alias("need"))
    needs = needs.select("request_id", "n", F.col("need.term").alias("term"), se._bucket(F.col("need.term"), paged.index.buckets), F.col("need.idf").alias("idf"))
    met = paged.bounds.join(stored(needs, "needs"), ["bucket", "term"])
    sums = met.groupBy("request_id", "block", "n").agg(
        F.count(F.lit(1)).alias("_held"), F.sum((1 + F.ln("top")) * F.col("idf")).alias("bound"), F.max("least").alias("least")
    )
    return sums.where(F.col("_held") == F.col("n")).select("request_id", "block", "bound", "least")


def _key() -> Column:
    return -F.round("relevance", 9)


def first_pages(requests: DataFrame, paged: PagedIndex, width: int = 1) -> tuple[DataFrame, DataFrame]:
    """The page that each request asks for, and how many blocks were read for it.

    Requests have request_id, q, tags, page (from 1) and pagesize. The first table has request_id, position,
    post_id, relevance and has_more, sorted by relevance and post_id as `match_posts` would be; the second
    request_id, blocks (that hold all terms) and blocks_read.

    The first round reads the best `width` blocks of every request, the second `WIDER` times as many, and the
    third all that are left. A request keeps the posts up to the end of its page and one more. Blocks that can't
    bring one of these any more are dropped after each round, so the last reads those only that still may. The
    rounds don't grow with the blocks, and read the postings of the rarest terms alone, copied once.
    """
    asked = se._asked(requests).withColumn("last_step", F.lit(0))
    drivers = stored(se._drivers(se._needs(asked, paged.index), paged.index), "drivers")
    sizes = requests.select(
        "request_id",
        F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).cast("long").alias("page"),
        F.greatest(F.coalesce("pagesize", F.lit(PAGE_SIZE)), F.lit(0)).cast("long").alias("pagesize"),
    ).withColumn("kept", F.col("page") * F.col("pagesize") + 1)
    sizes = stored(sizes, "page-sizes")
    reachable = stored(_reachable(drivers, paged), "reachable")
    driven = se._driven(drivers, paged.index)
    waiting, best, reads = reachable, None, []
    for last in (width, WIDER * width, sys.maxsize):
        if not waiting.head(1):
            break
        placed = row_number(waiting.withColumn("_bound", -F.col("bound")), ["request_id"], ["_bound", "least", "block"], "_rank").drop("_bound")
        placed = stored(placed, "placed")
        turn = placed.where(F.col("_rank") < last).select("request_id", "block")
        reads.append(turn.groupBy("request_id").agg(F.count(F.lit(1)).alias("read")))
        found = stored(se._found(drivers, driven, turn).drop("step"), "matches")
        some = found if best is None else found.unionByName(best.select(found.columns))
        ordered = row_number(some.join(sizes, "request_id").withColumn("_key", _key()), ["request_id"], ["_key", "post_id"], "position")
        best = stored(ordered.where(F.col("position") < F.col("kept")), "best")
        worst = best.where(F.col("position") == F.col("kept") - 1).select("request_id", (-F.col("_key")).alias("_worst"), F.col("post_id").alias("_post"))
        rest = placed.where(F.col("_rank") >= last).join(worst, "request_id", "left")
        enters = (F.col("bound") > F.col("_worst") + SLACK) | ((F.col("bound") >= F.col("_worst") - SLACK) & (F.col("least") < F.col("_post")))
        waiting = stored(rest.where(F.col("_worst").isNull() | enters).drop("_rank", "_worst", "_post"), "waiting")
    if best is None:
        best = sizes.where("false").select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("post_id", dict(paged.index.forward.dtypes)["post_id"]), ("relevance", "double"), ("position", "long"))))
    counts = best.select("request_id", F.col("position").alias("_last")).groupBy("request_id").agg(F.max("_last").alias("_last"))
    start = (F.col("page") - 1) * F.col("pagesize")
    shown = best.where((F.col("position") >= start) & (F.col("position") < F.col("kept") - 1)).join(counts, "request_id")
    pages = shown.select("request_id", "position", "post_id", "relevance", (F.col("_last") >= F.col("kept") - 1).alias("has_more"))
    blocks = reachable.groupBy("request_id").agg(F.count(F.lit(1)).alias("blocks"))
    for n, read in enumerate(reads):
        blocks = blocks.join(read.withColumnRenamed("read", f"_read_{n}"), "request_id", "left")
    total = sum((F.coalesce(F.col(f"_read_{n}"), F.lit(0)) for n in range(len(reads))), F.lit(0)).cast("long")
    return pages, blocks.select("request_id", "blocks", total.alias("blocks_read"))


def backoff_pages(requests: DataFrame, paged: PagedIndex) -> tuple[DataFrame, DataFrame]:
    """The same for searches that back off: the query with the fewest words dropped that finds a post.

    The first table has the `query` used too. A request that finds nothing has no page.
    """
    found = se.search_with_backoff(requests, paged.index).where(F.col("post_id").isNotNull())
    used = stored(found.select("request_id", "query").distinct(), "used")
    asked = requests.drop("q").join(used, "request_id").withColumnRenamed("query", "q")
    pages, blocks = first_pages(asked, paged)
    return pages.join(used, "request_id"), blocks
