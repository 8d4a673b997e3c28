"""Runtime errors from a stream of console output."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import timedelta
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from askmill.operators.editor import settings_gate
from askmill.streaming.state import LATENESS, ROCKSDB, OrderedMachine

_EXIT = re.compile(r"\nProcess finished with exit code [0-9]+\n")
_CATEGORY = {"ERROR_OUTPUT": "ERROR", "SYSTEM": "INFORMATION"}


class ConsoleMachine(OrderedMachine):
    row_schema = "ts_ms long, seq long, content_type string, chunk string"
    columns = ["ts_ms", "seq", "content_type", "chunk"]
    order = 2

    def __init__(self, keys: Sequence[str]) -> None:
        self.out_columns = [*keys, "run", "category", "line_no", "text"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.written = handle.getListState("written", "category string, chunk string")

    def fold(self, rows: list[tuple], state: dict | None, now: int) -> Iterator[tuple]:
        """A run stays open until its exit line, however long that takes."""
        state = state or {"run": 0, "failed": False, "held": False}
        fresh: list[tuple] = []
        for _, _, content_type, chunk in rows:
            if content_type == "SYSTEM" and _EXIT.fullmatch(chunk):
                held = state.get("held", True)
                if state["failed"]:
                    yield from self._lines(state["run"], fresh, held)
                if held:
                    self.written.clear()
                fresh = []
                state.update(run=state["run"] + 1, failed=False, held=False)
            elif content_type in _CATEGORY:
                category = _CATEGORY[content_type]
                state["failed"] = state["failed"] or category == "ERROR"
                fresh.append((category, chunk))
        if fresh:
            self.written.appendList(fresh)
            state["held"] = True
        return state

    def _lines(self, run: int, fresh: list[tuple], held: bool) -> Iterator[tuple]:
        """Lines of the run, numbered as its chunks come; only a line still open is held.

        State is asked only where it has held chunks: each call goes to the executor and back.
        """
        open_lines: dict[str, list] = {}
        for category, chunk in chain(map(tuple, self.written.get()) if held else (), fresh):
            first, *others = chunk.split("\n")
            line = open_lines.setdefault(category, [0, []])
            line[1].append(first)
            for text in others:
                yield run, category, line[0], "".join(line[1])
                line[:] = [line[0] + 1, [text]]
        for category, (number, pieces) in open_lines.items():
            yield run, category, number, "".join(pieces)


class SilentConsoleMachine(ConsoleMachine):
    """Holds little: a run that is silent for `silence` milliseconds, or long, is sent on as chunks.

    Rows are of three kinds: `line`, of runs that ended while all of theirs was held; `chunk`, numbered within
    its run; and `ended`, for a failed run some of whose chunks were sent on.
    """

    def __init__(self, keys: Sequence[str], silence: int, hold: int) -> None:
        self.out_columns = [*keys, "kind", "run", "category", "no", "text"]
        self.silence, self.hold = silence, hold

    def fold(self, rows: list[tuple], state: dict | None, now: int) -> Iterator[tuple]:
        state = state or {"run": 0, "failed": False, "sent": 0, "held": 0, "last": None}
        fresh: list[tuple] = []
        for ts, _, content_type, chunk in rows:
            if content_type == "SYSTEM" and _EXIT.fullmatch(chunk):
                if state["failed"] and state["sent"]:
                    yield from self._sent(state, fresh)
                    yield "ended", state["run"], None, None, None
                elif state["failed"]:
                    for run, category, number, text in self._lines(state["run"], fresh, bool(state["held"])):
                        yield "line", run, category, number, text
                if state["held"]:
                    self.written.clear()
                fresh = []
                state = {"run": state["run"] + 1, "failed": False, "sent": 0, "held": 0, "last": None}
            elif content_type in _CATEGORY:
                category = _CATEGORY[content_type]
                state["failed"] = state["failed"] or category == "ERROR"
                fresh.append((category, chunk))
                state["last"] = ts
                if state["held"] + len(fresh) >= self.hold:
                    yield from self._sent(state, fresh)
                    fresh = []
        if fresh:
            self.written.appendList(fresh)
            state["held"] += len(fresh)
        if state["held"] and state["last"] + self.silence <= now:
            yield from self._sent(state, [])
        return state

    def wake_at(self, state: dict | None) -> int | None:
        return state["last"] + self.silence if state and state["held"] else None

    def _sent(self, state: dict, fresh: list[tuple]) -> Iterator[tuple]:
        """The held and fresh chunks, as rows; none is held after."""
        for category, chunk in chain(map(tuple, self.written.get()) if state["held"] else (), fresh):
            yield "chunk", state["run"], category, state["sent"], chunk
            state["sent"] += 1
        if state["held"]:
            self.written.clear()
        state["held"] = 0


def _consoles(console: DataFrame, settings: DataFrame | None, lateness: str) -> DataFrame:
    console.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    allowed = console if settings is None else settings_gate(console, settings, "runtime_error")
    return allowed.withWatermark("ts", lateness).withColumn("ts_ms", F.unix_millis("ts"))


def console_rows_stream(
    console: DataFrame,
    settings: DataFrame | None = None,
    lateness: str = LATENESS,
    keys: Sequence[str] = ("console_id",),
    silence: timedelta = timedelta(hours=1),
    hold: int = 10_000,
) -> DataFrame:
    """Rows for `sinks.keep_console_lines`: lines, and chunks of runs that are silent or long.

    A run without output for `silence` of event time, or with `hold` chunks, leaves state and goes on as chunks:
    keys, kind, run, category, no, text. Sets the session's state store to RocksDB.
    """
    kinds = ", ".join(f"`{k}` {console.schema[k].dataType.simpleString()}" for k in keys)
    return _consoles(console, settings, lateness).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=SilentConsoleMachine(keys, silence // timedelta(milliseconds=1), hold),
        outputStructType=f"{kinds}, kind string, run long, category string, no long, text string",
        outputMode="append",
        timeMode="eventtime",
    )


def console_lines_stream(
    console: DataFrame,
    settings: DataFrame | None = None,
    lateness: str = LATENESS,
    keys: Sequence[str] = ("console_id",),
) -> DataFrame:
    """Lines of each console run with an error, once it has ended: the stream form of console_lines.

    Chunks are ordered by (ts, seq), and a run stays in state until its exit line. Sets the session's
    state store to RocksDB. With `settings`, users who have runtime errors off are left out. `keys` say
    what a console is; with user_id among them, lines have their user.
    """
    kinds = ", ".join(f"`{k}` {console.schema[k].dataType.simpleString()}" for k in keys)
    return _consoles(console, settings, lateness).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=ConsoleMachine(keys),
        outputStructType=f"{kinds}, run long, category string, line_no long, text string",
        outputMode="append",
        timeMode="eventtime",
    )
