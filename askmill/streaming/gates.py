"""Gates as of an event's instant, on streams of events and of changes."""

from __future__ import annotations

from collections.abc import Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.operators.editor import has_on
from askmill.streaming.state import LATENESS, ROCKSDB, OrderedMachine

_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class GateMachine(OrderedMachine):
    """Keeps what a user's last change has set, and passes on the events that it lets through."""

    row_schema = "ts_ms long, event int, seq long, value int, body string"
    columns = ["ts_ms", "event", "seq", "value", "body"]
    out_columns = ["user_id", "body"]
    order = 3

    def __init__(self, default: bool) -> None:
        self.default = default

    def fold(self, rows: list[tuple], state: dict | None, now: int) -> Generator[tuple, None, dict]:
        on = state["on"] if state else self.default
        for _, event, _, value, body in rows:
            if not event:
                on = bool(value)
            elif on:
                yield (body,)
        return {"on": on}


def in_force_stream(
    events: DataFrame, changes: DataFrame, value: Column, default: bool, lateness: str = LATENESS
) -> DataFrame:
    """The stream form of `in_force`; both events and changes are streams.

    Both wait until the watermark, that of the stream further behind, has passed them, and are taken
    in order; of a user only the last change is kept. Sets the session's state store to RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def laid(rows: DataFrame, event: int, seq: Column, state: Column, body: Column) -> DataFrame:
        return rows.withWatermark("ts", lateness).select(
            "user_id",
            "ts",
            F.unix_millis("ts").alias("ts_ms"),
            F.lit(event).alias("event"),
            seq.cast("long").alias("seq"),
            state.cast("int").alias("value"),
            body.alias("body"),
        )

    zero = F.lit(0)
    happened = laid(events, 1, zero, zero, F.to_json(F.struct(*events.columns), _EXACT))
    state = F.coalesce(value, F.lit(default))
    changed = laid(changes, 0, F.col("seq"), state, F.lit(None).cast("string"))
    passed = happened.unionByName(changed).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=GateMachine(default),
        outputStructType="user_id long, body string",
        outputMode="append",
        timeMode="eventtime",
    )
    return passed.select(F.from_json("body", events.schema, _EXACT).alias("_row")).select("_row.*")


def settings_gate_stream(
    events: DataFrame, changes: DataFrame, flag: str, lateness: str = LATENESS
) -> DataFrame:
    """Events whose users had both automatic queries and `flag` on at the event's instant."""
    return in_force_stream(events, changes, has_on(flag), True, lateness)


def window_gate_stream(events: DataFrame, changes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events whose users had their tool window open at the event's instant."""
    return in_force_stream(events, changes, F.col("visible"), False, lateness)
