"""Saved search responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators.posts import clean_posts
from askmill.schemas import RESPONSE


def read_responses(spark: SparkSession, path: str, *, lines: bool = True) -> DataFrame:
    """One row per post of each response, in response order; gzip files are read as they are.

    `initial_rank` is the 0-based place in the list. A response without posts keeps one row whose
    post columns are null. `response_id` tells the responses of one read apart. A file is one response,
    however it is laid out, or one response a line (`lines`); one that is no response fails the read.
    """
    read = spark.read.schema(RESPONSE).option("mode", "FAILFAST").option("multiLine", not lines)
    responses = read.json(path).select(
        F.monotonically_increasing_id().alias("response_id"),
        F.col("_metadata.file_path").alias("file"),
        "has_more",
        "quota_max",
        "quota_remaining",
        F.posexplode_outer("items").alias("initial_rank", "_post"),
    )
    has_more = F.coalesce("has_more", F.lit(False)).alias("has_more")
    quota = [F.coalesce(c, F.lit(0)).alias(c) for c in ("quota_max", "quota_remaining")]
    flat = responses.select(
        "response_id", "file", has_more, *quota, "initial_rank",
        F.col("_post.question_id").alias("post_id"),
        *[F.col(f"_post.{c}").alias(c) for c in ("tags", "body", "excerpt", "title", "link")],
    )
    cleaned = clean_posts(flat)
    filled = ("tags", "tag_text", "body", "excerpt", "title", "link")
    there = F.col("initial_rank").isNotNull()
    return cleaned.withColumns({c: F.when(there, F.col(c)) for c in filled})
