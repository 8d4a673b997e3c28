"""A user's search history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.plans.ordered import hot_keys, last_known, running_sum


def query_history(searches: DataFrame) -> DataFrame:
    """History entries of every user: user_id, entry (0 = oldest), index (0 = newest), query, tags.

    Columns user_id, seq, query, tags (blank-separated), manual and, where there is one, replay.
    A manual search for the newest entry's query renews that entry's tags; any other search is a new
    entry. Automatic searches always are. Running an old entry again is not recorded, nor is a
    manual search without query and tags.
    """
    rows = searches.where(~F.col("replay")) if "replay" in searches.columns else searches
    hot = hot_keys(rows, ["user_id"])
    empty = F.col("manual") & (F.col("query") == "") & (F.col("tags") == "")
    newest = last_known(
        rows, ["user_id"], ["seq"], F.when(~empty, F.col("query")), "_newest", before=True, hot=hot
    )
    renews = F.col("manual") & F.coalesce(F.col("query") == F.col("_newest"), F.lit(False))
    known = newest.withColumn("_new", ~renews).where(renews | ~empty)
    numbered = running_sum(
        known, ["user_id"], ["seq"], F.col("_new").cast("long"), "_entry", hot=hot
    )
    entries = numbered.groupBy("user_id", "_entry").agg(
        F.first("query").alias("query"), F.max_by("tags", "seq").alias("tags")
    )
    totals = entries.groupBy("user_id").agg(F.max("_entry").alias("_entries"))
    return entries.join(totals, "user_id").select(
        "user_id",
        (F.col("_entry") - 1).alias("entry"),
        (F.col("_entries") - F.col("_entry")).alias("index"),
        "query",
        "tags",
    )
