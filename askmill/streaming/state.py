"""Keyed state machines over event time.

Rows of a key wait until the watermark has passed them and are then taken in order, so that the
stream gives what the batch over the same rows gives. Rows that come later than the watermark are
dropped by Spark. State lives in the RocksDB store and is recovered from the query's checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Generator, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from askmill.operators.difficulty import LOG_SCHEMA, fold_events, next_timer, run_timers

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 minutes"
FRAME = 10_000
#: Milliseconds of event time whose waiting rows are held, read and dropped together.
BUCKET = 60_000
#: Rows up to so many buckets ahead lie in buckets of that width; further ahead buckets are wider, by powers of two.
NEAR = 64
_LEVEL = 1 << 48


def _bucket_of(ts: int, now: int) -> int:
    """The bucket in which a row of `ts` waits: wide if far ahead of `now`, so that a key has few of them."""
    level = max(0, ((ts - now) // (NEAR * BUCKET)).bit_length())
    return level * _LEVEL + ts // (BUCKET << level)


def _is_wide(bucket: int) -> bool:
    return bucket >= _LEVEL // 2


class WaitingRows:
    """Rows of a key that wait, in a map by time bucket and part.

    A micro-batch adds a part to the buckets its rows fall in, and reads only buckets that hold a row now due.
    A bucket of `BUCKET` milliseconds is never rewritten: where the watermark stands in it, it is read again, without
    the rows already taken, and goes once the watermark is past it. Rows far ahead, as of a table that is taken in
    at once, lie in wide buckets, so that their number grows with the logarithm of the time ahead and not with the
    rows; the rest of a wide bucket that the watermark enters moves on to narrower ones. `held` says of each bucket how many
    parts it has and which of its rows is due next; it is the caller's to keep.
    """

    def __init__(self, parts: MapState, held: dict[str, list[int]] | None, taken: int) -> None:
        self.parts = parts
        self.held = {int(bucket): (n, first) for bucket, (n, first) in (held or {}).items()}
        self.taken = taken

    @property
    def first(self) -> int | None:
        return min((first for _, first in self.held.values()), default=None)

    def add(self, rows: list[tuple]) -> None:
        """Rows that come after the time of the last `due`."""
        buckets: dict[int, list[tuple]] = {}
        for row in rows:
            buckets.setdefault(_bucket_of(row[0], self.taken), []).append(row)
        for bucket, own in buckets.items():
            n, first = self.held.get(bucket, (0, own[0][0]))
            for start in range(0, len(own), FRAME):
                self.parts.updateValue((bucket, n), (own[start : start + FRAME],))
                n += 1
            self.held[bucket] = (n, min(first, min(row[0] for row in own)))

    def due(self, now: int) -> list[tuple]:
        """Rows up to `now` that have not been taken yet."""
        out: list[tuple] = []
        moved: list[tuple] = []
        for bucket in sorted(b for b, (_, first) in self.held.items() if first <= now):
            n, rest = self.held.pop(bucket)[0], []
            for part in range(n):
                for row in map(tuple, self.parts.getValue((bucket, part))[0]):
                    if row[0] > now:
                        rest.append(row)
                    elif row[0] > self.taken:
                        out.append(row)
            if rest and not _is_wide(bucket):
                self.held[bucket] = (n, min(row[0] for row in rest))
            else:
                moved += rest
                for part in range(n):
                    self.parts.removeKey((bucket, part))
        self.taken = max(now, self.taken)
        self.add(moved)
        return out


class OrderedMachine(StatefulProcessor):
    """Holds a key's rows back until the watermark, then folds them into a JSON state.

    Subclasses name the columns they need, with the ordering ones first, and define `fold`.
    """

    row_schema: str
    order: int

    def fold(self, rows: list[tuple], state: dict | None, now: int) -> Generator[tuple, None, dict]:
        """Take in rows up to the watermark `now`; yields output rows and returns the new state."""
        raise NotImplementedError

    def wake_at(self, state: dict | None) -> int | None:
        """When to run without new rows."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "json string")
        self.waiting = handle.getMapState(
            "waiting", "bucket long, part long", f"rows array<struct<{self._fields()}>>"
        )

    def _fields(self) -> str:
        return ", ".join(":".join(field.split()) for field in self.row_schema.split(","))

    def close(self) -> None:
        pass

    def handleInputRows(
        self, key: tuple, rows: Iterator[pd.DataFrame], timerValues
    ) -> Iterator[pd.DataFrame]:
        fresh: list[tuple] = []
        for batch in rows:
            fresh += batch[self.columns].itertuples(index=False, name=None)
        yield from self._advance(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, fresh: list[tuple], now: int) -> Iterator[pd.DataFrame]:
        kept = json.loads(self.machine.get()[0]) if self.machine.exists() else {}
        waiting = WaitingRows(self.waiting, kept.get("held"), kept.get("taken", -1))
        ready = waiting.due(now) + [row for row in fresh if row[0] <= now]
        waiting.add([row for row in fresh if row[0] > now])
        lines = self.fold(sorted(ready, key=lambda row: row[: self.order]), kept.get("state"), now)
        state = yield from self._frames(key, lines)
        due = waiting.first
        wake = self.wake_at(state)
        if wake is not None and (due is None or wake < due):
            due = wake
        self._set_timer(kept.get("timer"), due, now)
        kept = {"state": state, "held": waiting.held, "taken": waiting.taken, "timer": due}
        self.machine.update((json.dumps(kept),))

    def _frames(self, key: tuple, lines: Generator[tuple, None, dict]) -> Generator[pd.DataFrame, None, dict]:
        """Frames of at most `FRAME` rows; returns what the fold returns."""
        rows: list[tuple] = []
        while True:
            try:
                line = next(lines)
            except StopIteration as end:
                if rows:
                    yield pd.DataFrame(rows, columns=self.out_columns, dtype=object)
                return end.value
            rows.append(tuple(key) + line)
            if len(rows) == FRAME:
                yield pd.DataFrame(rows, columns=self.out_columns, dtype=object)
                rows = []

    def _set_timer(self, old: int | None, due: int | None, now: int) -> None:
        if old is not None and old > now and old != due:
            self.handle.deleteTimer(old)
        if due is not None and (old != due or old <= now):
            self.handle.registerTimer(due)


class DifficultyMachine(OrderedMachine):
    row_schema = "ts_ms long, event_id long, kind string"
    columns = ["ts_ms", "event_id", "kind"]
    order = 2

    def __init__(self, keys: Sequence[str]) -> None:
        self.out_columns = [
            *keys, "ts_ms", "event_id", "event", "state", "scroll", "click", "insert", "delete",
        ]

    def fold(self, rows: list[tuple], state: dict | None, now: int) -> Generator[tuple, None, dict]:
        lines, state = fold_events(rows, state)
        yield from lines
        yield from run_timers(state, now)
        return state

    def wake_at(self, state: dict | None) -> int | None:
        return next_timer(state)


def detect_difficulty_stream(
    events: DataFrame, lateness: str = LATENESS, keys: Sequence[str] = ("user_id",)
) -> DataFrame:
    """The log of the difficulty machine as a stream, timers included as they fall due.

    There is one machine for each value of `keys`, such as user and project. Sets the session's state
    store to RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.withWatermark("ts", lateness).withColumn("ts_ms", F.unix_millis("ts"))
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    log = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=DifficultyMachine(keys),
        outputStructType=f"{kinds}, {LOG_SCHEMA}",
        outputMode="append",
        timeMode="eventtime",
    )
    return log.withColumn("ts", F.timestamp_millis("ts_ms")).drop("ts_ms")
