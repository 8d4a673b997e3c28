import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from askmill.operators import corpus as cp
from askmill.operators import difficulty as di
from askmill.operators import errors as er
from askmill.operators import personal as pe
from askmill.operators import search as se
from askmill.operators.editor import settings_gate
from askmill.sources import streams
from askmill.sources import telemetry as tl
from askmill.streaming import sinks
from askmill.streaming.console import console_lines_stream, console_rows_stream
from askmill.streaming.profile import effective_interactions_stream
from askmill.streaming.state import detect_difficulty_stream
from askmill.workload.tables import Tables


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def in_order(df, path, parts=3):
    """Write rows as files that arrive in the order of time, the last one far ahead."""
    micros = F.unix_micros("ts")
    bounds = df.select(F.percentile_approx(micros, [i / parts for i in range(1, parts)])).first()[0]
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = df if low is None else df.where(micros > low)
        part = part if high is None else part.where(micros <= high)
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    ahead = df.limit(1).withColumn("ts", F.timestamp_seconds(F.lit(2_000_000_000)))
    return ahead


def run(stream, path, checkpoint):
    started = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    started.trigger(availableNow=True).start(path).awaitTermination()


def test_difficulty_stream_with_a_restart_equals_batch(spark, tables, tmp_path):
    events = tables.editor_events().withColumns({"project": F.lit("p"), "text": F.lit("")})
    events = events.select("user_id", "project", "event_id", "ts", "kind", "text")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    ahead = in_order(events, source)

    def log():
        stream = streams.editor_event_stream(spark, source, files_per_trigger=1)
        return detect_difficulty_stream(stream)

    run(log(), out, checkpoint)
    # the far event arrives after a restart and pushes all others past the watermark
    ahead.withColumns({"user_id": F.lit(-1).cast("long"), "event_id": F.lit(-1).cast("long")}).write.mode(
        "append"
    ).parquet(source)
    run(log(), out, checkpoint)
    batch = di.detect_difficulty(events)
    last = events.groupBy("user_id").agg(F.max(F.unix_millis("ts")).alias("last"))
    found = spark.read.parquet(out).join(last, "user_id").where(F.unix_millis("ts") <= F.col("last"))
    found = found.select(batch.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))


def test_two_projects_of_a_user_have_a_machine_each(spark, tables, tmp_path):
    keys = ["user_id", "project"]
    project = F.concat(F.lit("p"), F.col("event_id") % 2)
    events = tables.editor_events().withColumns({"project": project, "text": F.lit("")})
    events = events.select("user_id", "project", "event_id", "ts", "kind", "text")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    in_order(events, source, 2)
    run(detect_difficulty_stream(streams.editor_event_stream(spark, source, files_per_trigger=1), "0 seconds", keys), out, checkpoint)
    batch = di.detect_difficulty(events, keys)
    last = events.groupBy(*keys).agg(F.max(F.unix_millis("ts")).alias("last"))
    found = spark.read.parquet(out).join(last, keys).where(F.unix_millis("ts") <= F.col("last")).select(batch.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert found.select("project").distinct().count() == 2


def test_late_events_are_dropped(spark, tables, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "user_id long, project string, event_id long, ts timestamp, kind string, text string"

    def arrive(*rows):
        made = [(1, "p", i, ts, "Click", "") for i, ts in rows]
        typed = spark.createDataFrame(made, schema.replace("ts timestamp", "ts long"))
        typed.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)

    def step():
        run(detect_difficulty_stream(streams.editor_event_stream(spark, source)), out, checkpoint)

    arrive((0, 1_000), (1, 100_000))
    step()
    arrive((2, 2_000), (3, 200_000))
    step()
    pauses = [r["ts"].timestamp() for r in spark.read.parquet(out).where("state = 'pause'").collect()]
    # the event at 2000 was late: the only pauses are those after 1000 and 100000
    assert sorted(pauses) == [1_000 + 900, 100_000 + 900]


def test_console_stream_equals_batch(spark, tables, tmp_path):
    console = tables.console().select("console_id", "user_id", "ts", "seq", "content_type", "chunk")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    in_order(console, source, 2)
    stream = console_lines_stream(streams.console_stream(spark, source, files_per_trigger=1), tables.settings(), "0 seconds")
    run(stream, out, checkpoint)
    batch = er.console_lines(settings_gate(console, tables.settings(), "runtime_error"))
    found = spark.read.parquet(out).select(batch.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert batch.count() > 50


def test_console_stream_over_long_gaps(spark, tmp_path):
    """An exit line days later closes the run, in one micro-batch or in many."""
    schema = "console_id long, user_id long, ts long, seq long, content_type string, chunk string"
    day = 86_400
    rows = [
        (1, 1, 0, 0, "ERROR_OUTPUT", "first\nsecond "),
        (2, 2, day, 1, "ERROR_OUTPUT", "other"),
        (2, 2, 2 * day, 2, "SYSTEM", "plain"),
        (1, 1, 3 * day, 3, "ERROR_OUTPUT", "half"),
        (1, 1, 4 * day, 4, "SYSTEM", "\nProcess finished with exit code 1\n"),
        (2, 2, 9 * day, 5, "SYSTEM", "\nProcess finished with exit code 0\n"),
    ]
    console = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("ts") + day))
    batch = sorted(map(str, er.console_lines(console).collect()))
    assert len(batch) == 4
    for files in (1, 6):
        source, out, checkpoint = (str(tmp_path / f"{n}{files}") for n in ("in", "out", "state"))
        if files == 1:
            console.coalesce(1).write.parquet(source)
        else:
            in_order(console, source, files)
        run(console_lines_stream(streams.console_stream(spark, source, files_per_trigger=1), None, "0 seconds"), out, checkpoint)
        found = spark.read.parquet(out).select(er.console_lines(console).columns)
        assert sorted(map(str, found.collect())) == batch


def test_silent_and_long_runs_wait_on_disk(spark, tables, tmp_path):
    """Lines are those of the batch, whatever leaves state before its run ends, in one micro-batch or many."""
    console = tables.console().select("console_id", "user_id", "ts", "seq", "content_type", "chunk")
    batch = sorted(map(str, er.console_lines(console).collect()))
    for files, silence, hold in ((1, timedelta(days=1), 2), (4, timedelta(milliseconds=1), 10_000), (4, timedelta(minutes=5), 3)):
        source, out, checkpoint = (str(tmp_path / f"{n}{files}{hold}") for n in ("in", "out", "state"))
        if files == 1:
            console.coalesce(1).write.parquet(source)
        else:
            in_order(console, source, files)
        stream = streams.console_stream(spark, source, files_per_trigger=1)
        rows = console_rows_stream(stream, None, "0 seconds", silence=silence, hold=hold)
        sinks.keep_console_lines(rows, out, checkpoint, buckets=4, available_now=True).awaitTermination()
        found = sinks.console_lines_at(spark, out, {"console_id": "long"})
        assert sorted(map(str, found.select("console_id", "run", "category", "line_no", "text").collect())) == batch
        assert spark.read.parquet(f"{out}/fetched").count() > 0


def test_selection_stream_equals_batch(spark, tables, tmp_path):
    actions = tables.actions().select("user_id", "ts", "seq", "action", "tags")
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "profile", "state"))
    in_order(actions, source, 3)
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(source)
    weighted = effective_interactions_stream(stream, "0 seconds")
    sinks.keep_profile(weighted, path, checkpoint, available_now=True).awaitTermination()
    batch = pe.tag_profile(pe.effective_interactions(actions)).collect()
    assert {tuple(r) for r in sinks.latest_profile(spark, path).collect()} == {tuple(r) for r in batch}
    assert len(batch) > 40


def test_profile_stream_equals_batch(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / n) for n in ("in", "profile", "state"))
    schema = "user_id long, tags array<string>, weight int"
    for rows in ([(1, ["a", "b"], 2), (2, ["a"], 1)], [(1, ["a"], 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        sinks.keep_profile(stream, table, checkpoint, available_now=True).awaitTermination()
    found = {tuple(r) for r in sinks.latest_profile(spark, table).collect()}
    assert found == {tuple(r) for r in pe.tag_profile(spark.read.schema(schema).parquet(source)).collect()}


def test_searches_from_streams(spark, tables, tmp_path):
    posts = spark.createDataFrame(
        [(1, "IllegalStateException", "runtime error IllegalStateException java 5", [], 1, None, None), (2, "ring", "red ring", ["t"], 2, None, None)],
        "post_id int, title string, body string, tags array<string>, votes int, created timestamp, active timestamp",
    )
    stats, index = cp.term_stats(posts, "body").cache(), se.index_posts(posts)
    found = []

    lines = spark.createDataFrame([(1, 0, "ERROR", 0, "red: ring"), (2, 0, "ERROR", 0, "no such thing")], "console_id long, run long, category string, line_no long, text string")
    lines.write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))
    query = sinks.search_runtime_errors(stream, index, stats, lambda df, _: found.extend(df.collect()), str(tmp_path / "s1"))
    query.processAllAvailable()
    query.stop()
    assert {(r["run_id"], r["query"], r["post_id"]) for r in found} == {("1:0", "red ring", 2), ("2:0", "runtime error", 1)}

    log = spark.createDataFrame([(5, 9, di.BY_DELETES, None, 1, 1, 1, 1)], "user_id long, event_id long, event string, state string, scroll int, click int, insert int, delete int")
    log = log.withColumn("ts", F.timestamp_seconds(F.lit(0)))
    log.write.parquet(str(tmp_path / "log"))
    contexts = spark.createDataFrame([(5, 9, "red ring", 0, None)], "user_id long, event_id long, text string, caret_line int, selected string")
    profile = spark.createDataFrame([(5, "t", 10)], "user_id long, tag string, clicks long")
    tags = cp.tag_stats(posts)
    found.clear()
    query = sinks.search_when_stuck(
        spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")), contexts,
        tables.settings().limit(0), spark.createDataFrame([(5,)], "user_id long"), posts, index, stats, F.lit(2),
        profile, tags, lambda df, _: found.extend(df.collect()), str(tmp_path / "s2"),
    )
    query.processAllAvailable()
    query.stop()
    assert [(r["request_id"], r["post_id"], r["final_rank"]) for r in found] == [("5:9", 2, 0)]


def test_telemetry_stream_sink(spark, tmp_path):
    spark.createDataFrame([("a",)], "value string").write.text(str(tmp_path / "in"))
    stream = spark.readStream.text(str(tmp_path / "in"))
    query = tl.write_telemetry(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a"]
