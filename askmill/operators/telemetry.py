"""Bodies of the telemetry events, as columns of one nullable schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.functions.text import hash_tags
from askmill.operators.difficulty import TRANSITION
from askmill.operators.editor import settings_gate, window_gate
from askmill.plans.ordered import last_known
from askmill.schemas import SETTING_FLAGS

QUERY_TYPES = ("manual", "action", "difficulty", "compiler", "runtime")
ERROR_TYPES = ("compiler", "runtime")
RESULT_TYPES = ("expand", "contract", "browser")


def query_events(searches: DataFrame) -> DataFrame:
    """QueryEventType, hashed Tags and sort of each search: user_id, seq and the body.

    Columns query_type, tags (blank-separated), sort and visible. An error query that meets a hidden
    tool window is not run, and says only that.
    """
    hidden = F.col("query_type").isin(*ERROR_TYPES) & ~F.col("visible")
    return searches.select(
        "user_id",
        "seq",
        F.col("query_type").alias("QueryEventType"),
        F.when(~hidden, hash_tags(F.col("tags"))).alias("Tags"),
        F.when(~hidden, F.lower("sort")).alias("sort"),
        F.when(hidden, F.lit("false")).alias("Visible"),
    )


def result_events(clicks: DataFrame, queries: DataFrame) -> DataFrame:
    """Expand, contract and browser clicks with the type of the user's most recent query.

    Clicks have user_id, seq, type, index and total; queries user_id, seq and query_type. Both are
    laid in one sequence, so a click only ever looks back. Before any query the source is "-1".
    """
    none = F.lit(None)
    both = clicks.select(
        "user_id", "seq", "type", "index", "total", none.cast("string").alias("_query")
    ).unionByName(
        queries.select(
            "user_id",
            "seq",
            none.cast("string").alias("type"),
            none.cast("int").alias("index"),
            none.cast("int").alias("total"),
            F.col("query_type").alias("_query"),
        )
    )
    sourced = last_known(both, ["user_id"], ["seq"], F.col("_query"), "_source")
    return sourced.where(F.col("type").isNotNull()).select(
        "user_id",
        "seq",
        F.col("type").alias("ResultEventType"),
        F.coalesce("_source", F.lit("-1")).alias("SourceQuery"),
        F.col("index").alias("Index"),
        F.col("total").alias("Total"),
    )


def difficulty_events(
    log: DataFrame, settings: DataFrame, visible: DataFrame, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Log lines of the difficulty machine as event bodies, with the keys of the machines.

    A trigger is logged only where the tool window is open and difficulty detection is on;
    transitions always are. With a key `project`, telemetry lines have its code.
    """
    moves = log.where(F.col("event") == TRANSITION)
    triggers = log.where(F.col("event") != TRANSITION)
    shown = window_gate(triggers, visible)
    lines = moves.unionByName(settings_gate(shown, settings, "difficulty"))
    return lines.select(
        *keys,
        "ts",
        "event_id",
        F.col("event").alias("DifficultyEventType"),
        F.col("state").alias("State"),
        "scroll",
        "click",
        "insert",
        "delete",
    )


def settings_events(changes: DataFrame) -> DataFrame:
    """All five flags after each change of a user's settings."""
    flags = [F.col(flag).cast("string").alias(flag.upper()) for flag in SETTING_FLAGS]
    return changes.select(
        "user_id", F.lit("Changed").alias("SettingsEventType"), *flags
    )
