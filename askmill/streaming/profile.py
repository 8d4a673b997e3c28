"""Weighted interactions from a stream of a user's actions."""

from __future__ import annotations

from collections.abc import Generator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.operators.personal import interaction_weight
from askmill.streaming.state import LATENESS, ROCKSDB, OrderedMachine


class SelectionMachine(OrderedMachine):
    """Keeps the tags a user has selected; passes on adds of other tags, and clicks."""

    row_schema = "ts_ms long, seq long, action string, tags string"
    columns = ["ts_ms", "seq", "action", "tags"]
    out_columns = ["user_id", "seq", "action", "tags"]
    order = 2

    def fold(self, rows: list[tuple], state: dict | None, now: int) -> Generator[tuple, None, dict]:
        selected = set(state["selected"]) if state else set()
        for _, seq, action, tags in rows:
            if action == "clear":
                selected = set()
            elif action == "replay":
                selected = set((tags or "").split(","))
            elif action == "remove":
                selected.discard(tags)
            elif action in ("expand", "browser"):
                yield seq, action, tags
            elif action == "add" and tags not in selected:
                selected.add(tags)
                yield seq, action, tags
        return {"selected": sorted(selected, key=str)}


def effective_interactions_stream(actions: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The stream form of effective_interactions: user_id, seq, action, tags (array) and weight.

    Actions are ordered by (ts, seq). Sets the session's state store to RocksDB.
    """
    actions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = actions.withWatermark("ts", lateness).withColumn("ts_ms", F.unix_millis("ts"))
    made = rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=SelectionMachine(),
        outputStructType="user_id long, seq long, action string, tags string",
        outputMode="append",
        timeMode="eventtime",
    )
    return made.withColumn("tags", F.split("tags", ",")).withColumn("weight", interaction_weight(F.col("action")))
