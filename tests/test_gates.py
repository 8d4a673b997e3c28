"""Gates as of an instant, error searches, projects, envelopes and the profile's versions."""

import pytest
from pyspark.sql import functions as F

from askmill.operators import difficulty as di
from askmill.operators import errors as er
from askmill.operators import personal as pe
from askmill.operators import search as se
from askmill.operators.editor import settings_gate, window_gate
from askmill.plans import jobs
from askmill.sources import streams
from askmill.sources import telemetry as tl
from askmill.streaming import sinks
from askmill.streaming.console import console_lines_stream
from askmill.streaming.gates import settings_gate_stream, window_gate_stream
from askmill.workload.tables import Tables
from tests.test_streaming import in_order, run

EVENT = "user_id long, event_id long, at long, kind string"
CHANGE = "user_id long, at long, seq long, auto_query boolean, difficulty boolean"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def timed(spark, rows, schema):
    made = spark.createDataFrame(rows, schema)
    return made.withColumn("ts", F.timestamp_millis("at")).drop("at")


def test_gate_as_of_an_instant(spark, hot_after):
    events = timed(spark, [(u, i, 10 * i, "Click") for u in (1, 2) for i in range(10)] + [(3, 0, 5, "Click")], EVENT)
    changes = timed(
        spark,
        # off at 20 and on again at 50; of two changes of an instant the later seq counts; null is on
        [(1, 20, 1, True, False), (1, 50, 2, True, None), (2, 31, 2, False, True), (2, 31, 1, True, True), (9, 0, 0, False, False)],
        CHANGE,
    )
    expected = {(1, i) for i in (0, 1, 5, 6, 7, 8, 9)} | {(2, i) for i in range(4)} | {(3, 0)}
    for rows in (1_000, 4):  # plain, and with hot users in slices
        hot_after(rows)
        passed = settings_gate(events, changes, "difficulty")
        assert passed.columns == events.columns
        assert {(r.user_id, r.event_id) for r in passed.collect()} == expected
    windows = changes.select("user_id", "ts", "seq", F.col("difficulty").alias("visible"))
    # closed until opened, and for a null
    assert {(r.user_id, r.event_id) for r in window_gate(events, windows).collect()} == {(2, i) for i in range(4, 10)}
    assert settings_gate(events, changes.limit(0), "difficulty").count() == events.count()
    assert window_gate(events, windows.limit(0)).count() == 0


def test_gate_streams_equal_batch(spark, tables, tmp_path):
    """Over several micro-batches and a restart, with changes between events."""
    events = tables.editor_events().withColumns({"project": F.lit("p"), "text": F.lit("a \"b\"\n")})
    events = events.select("user_id", "project", "event_id", "ts", "kind", "text")
    for name, gate, changes in (
        ("settings", lambda e, c, *more: settings_gate(e, c, "difficulty"), tables.setting_changes()),
        ("window", lambda e, c, *more: window_gate(e, c), tables.window_changes()),
    ):
        source, turns, out, state = (str(tmp_path / f"{name}-{n}") for n in ("in", "changes", "out", "state"))
        ahead = [(path, in_order(df, path).withColumn("user_id", F.lit(-1).cast("long"))) for path, df in ((source, events), (turns, changes))]

        def passed():
            arriving = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(turns)
            happening = streams.editor_event_stream(spark, source, files_per_trigger=1)
            if name == "settings":
                return settings_gate_stream(happening, arriving, "difficulty", "0 seconds")
            return window_gate_stream(happening, arriving, "0 seconds")

        run(passed(), out, state)
        for path, row in ahead:
            row.write.mode("append").parquet(path)
        run(passed(), out, state)
        batch = gate(events, changes).collect()
        found = spark.read.parquet(out).where("user_id >= 0").collect()
        assert sorted(map(str, found)) == sorted(map(str, batch))
        assert 0 < len(batch) < events.count()


def test_first_line_and_keywords_in_one_pass(spark):
    rows = [
        ("r", 1, "ERROR", 1, "late: line\nx"), ("r", 1, "ERROR", 0, "early: line\nknown"), ("r", 1, "WARNING", 0, "java 1.7"),
        ("n", 2, "ERROR", 0, None), ("w", 3, "WARNING", 0, "java 1.7"), ("k", 4, "ERROR", 0, "compile error"),
    ]
    messages = spark.createDataFrame(rows, "run_id string, user_id long, category string, pos int, text string")
    stats = spark.createDataFrame([("known",), ("early line",)], "term string")
    found = er.error_queries(messages, stats, er.COMPILE, keys=["run_id", "user_id"])
    assert {tuple(r) for r in found.collect()} == {
        ("r", 1, "early line", "compile error java 7 early line known"),
        ("n", 2, None, "compile error"),
        ("k", 4, "compile error", "compile error"),
    }
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2  # messages and vocabulary, each once


def search_tables(spark, tables):
    posts = tables.error_posts()
    return posts, se.index_posts(posts), pe.tag_profile(tables.clicks_on_parts()), tables.read("part").selectExpr("'x' term", "1D idf").limit(1)


def test_error_search_keeps_to_open_windows_and_falls_back(spark, tables):
    posts, index, profile, tags = search_tables(spark, tables)
    errors = spark.createDataFrame(
        [("a", 1, "IllegalStateException java", "runtime error"), ("b", 1, "nowhere found", "compile error"),
         ("c", 2, "java", "java"), ("d", 1, None, "nowhere"), ("e", None, "java", "java")],
        "run_id string, user_id long, first_line string, keywords string",
    )
    visible = spark.createDataFrame([(1,), (1,), (3,)], "user_id long")
    found = jobs.error_results(errors, visible, posts, index, profile, tags).collect()
    assert {(r.request_id, r.query) for r in found} == {("a", "IllegalStateException java"), ("b", "compile error")}
    n = posts.count()
    for run_id in "ab":
        ranks = sorted(r.final_rank for r in found if r.request_id == run_id)
        assert ranks == list(range(n))


def test_runtime_error_search_stream_equals_batch(spark, tables, tmp_path):
    posts, index, profile, tags = search_tables(spark, tables)
    stats = spark.createDataFrame([("ring", 1, 1, 1.0, 1.0)], "term string, ctf long, df long, idf double, ictf double")
    console = tables.console().select("console_id", "user_id", "ts", "seq", "content_type", "chunk")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "state"))
    in_order(console, source, 2)
    stream = streams.console_stream(spark, source, files_per_trigger=1)
    lines = console_lines_stream(stream, tables.settings(), "0 seconds", ["console_id", "user_id"])
    sink = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    running = sinks.rank_runtime_errors(lines, tables.visible(), posts, index, stats, profile, tags, sink, checkpoint)
    running.processAllAvailable()
    running.stop()
    batch = jobs.runtime_error_search(console, tables.settings(), tables.visible(), stats, posts, index, profile, tags)
    found = spark.read.schema(batch.schema).parquet(out).select(batch.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    assert batch.count() > 0


def test_user_of_a_request_whatever_the_order_of_keys(spark, tables):
    contexts = spark.createDataFrame([("p:1", 7, 3, "import a.bolt;", 0, None)], "project string, user_id long, event_id long, text string, caret_line int, selected string")
    triggers = spark.createDataFrame([("p:1", 7, 3)], "project string, user_id long, event_id long")
    settings = spark.createDataFrame([], "user_id long, auto_query boolean, difficulty boolean")
    stats = spark.createDataFrame([("bolt", 1, 1, 1.0, 1.0)], "term string, ctf long, df long, idf double, ictf double")
    for keys in (["project", "user_id"], ["user_id", "project"]):
        stuck = di.difficulty_queries(triggers, contexts, settings, triggers.select("user_id"), keys)
        (request,) = jobs.trigger_requests(stuck, stats, F.lit(10)).collect()
        assert request.user_id == 7 and request.request_id.endswith(":3")


def test_envelopes_once_and_torn_ones_aside(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    good = ['{"Logs": [{"User": "1", "Index": 4}, {"User": "2"}]}', '{"Logs": []}', '{"Logs": [{"User": "3"}]}']
    bad = ['{"Logs": [{"User": "1"', '{"other": 1}', '{"Logs": [{"User": "9", "Index": "four"}]}', "text"]
    for i, lines in enumerate(([*good, bad[0]], [good[0], *bad], ["", good[2], good[2], bad[1]])):
        (path / f"{i}.txt").write_text("\n".join(lines))

    def told(events, letters):
        return sorted((r.User, r.Index) for r in events.collect()), sorted(r.value for r in letters.collect())

    expected = [("1", 4), ("2", None), ("3", None)], sorted(bad)
    batch = tl.read_envelopes(spark, str(path))
    assert told(tl.events_once(batch), tl.dead_letters(batch)) == expected
    stream = tl.envelope_stream(spark, str(path), files_per_trigger=1)
    for name, rows in (("events", tl.events_once(stream)), ("letters", tl.dead_letters(stream))):
        for _ in range(2):  # the second time after a restart, with a repeat
            run(rows, str(tmp_path / name), str(tmp_path / f"{name}-state"))
            (path / f"more-{name}.txt").write_text(f"{good[0]}\n{bad[0]}\n")
    out = [spark.read.parquet(str(tmp_path / n)) for n in ("events", "letters")]
    assert told(*out) == expected


def test_profile_versions_across_compaction_and_restart(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "profile", "state"))
    schema = "user_id long, tags array<string>, weight int"

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        sinks.keep_profile(stream, path, checkpoint, available_now=True, compact_every=2).awaitTermination()

    def clicks(version=None):
        return {(r.user_id, r.tag): r.clicks for r in sinks.profile_at(spark, path, version).collect()}

    for i in range(5):  # each run restarts the query
        arrive((1, ["a", "b"], 1), (2, ["a"], i))
    versions = [clicks(v) for v in range(5)]
    assert versions == [{(1, "a"): v + 1, (1, "b"): v + 1} | ({(2, "a"): v * (v + 1) // 2} if v else {}) for v in range(5)]
    assert spark.read.parquet(f"{path}/manifest").count() == 2
    fixed = sinks.latest_profile(spark, path)
    # a batch taken in once more, and compacted once more, changes nothing
    again = pe.tag_profile(spark.createDataFrame([(1, ["a", "b"], 1), (2, ["a"], 3)], schema))
    again.write.mode("overwrite").parquet(f"{path}/deltas/batch=3")
    sinks.compact_profile(spark, path, 3)
    sinks.compact_profile(spark, path, 4)
    arrive((3, ["c"], 2))
    assert {(r.user_id, r.tag): r.clicks for r in fixed.collect()} == versions[4]
    assert [clicks(v) for v in range(5)] == versions and clicks()[3, "c"] == 2
    # the sixth batch made a base, and nothing else is read
    assert all("/base-" in file for file in sinks.profile_at(spark, path).inputFiles())
