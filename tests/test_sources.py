import gzip
import json

import pytest
from pyspark.sql import functions as F

from askmill.operators import telemetry as te
from askmill.sources import responses, stats_xml, streams, telemetry

TERMS = """<?xml version="1.0"?>
<Collection termCount="200"
  docCount='300'>
  <Term name="a&amp;b" ctf="25" df="20" idf="5.5" ictf="5"/>
  <Term name="c" ctf="1" df="1" idf="2" ictf="3"/>%s
</Collection>"""


def test_term_stats(spark, tmp_path):
    path = tmp_path / "terms.xml"
    path.write_text(TERMS % "")
    rows = {r["term"]: tuple(r)[1:] for r in stats_xml.read_term_stats(spark, str(path)).collect()}
    assert rows == {"a&b": (25, 20, 5.5, 5.0), "c": (1, 1, 2.0, 3.0)}
    compat = {r["term"]: r["df"] for r in stats_xml.read_term_stats(spark, str(path), compat=True).collect()}
    assert compat == {"a&b": 25, "c": 1}
    assert tuple(stats_xml.read_totals(spark, str(path)).first()) == (200, 300)


def test_repeated_names_are_refused(spark, tmp_path):
    path = tmp_path / "terms.xml"
    path.write_text(TERMS % '<Term name="c" ctf="1" df="1" idf="2" ictf="3"/>')
    with pytest.raises(ValueError, match="'c'"):
        stats_xml.read_term_stats(spark, str(path))


def test_tag_stats(spark, tmp_path):
    path = tmp_path / "tags.xml"
    path.write_text('<Collection tagCount="7" docCount="2"><Tag name="java" ctf="3" df="2" idf="1" ictf="1"/></Collection>')
    assert tuple(stats_xml.read_tag_stats(spark, str(path)).first()) == ("java", 3, 2, 1.0, 1.0)
    assert tuple(stats_xml.read_totals(spark, str(path)).first()) == (7, 2)


def test_responses(spark, tmp_path):
    full = {"items": [{"question_id": 7, "tags": ["a"], "title": "t"}, {"question_id": 3}], "has_more": True, "quota_max": 100, "quota_remaining": 10}
    with gzip.open(tmp_path / "one.json.gz", "wt") as out:
        out.write(json.dumps(full) + "\n" + json.dumps({"items": []}) + "\n")
    rows = sorted(responses.read_responses(spark, str(tmp_path)).collect(), key=lambda r: (r["response_id"], r["initial_rank"] or 0))
    assert [(r["post_id"], r["initial_rank"]) for r in rows] == [(7, 0), (3, 1), (None, None)]
    assert rows[0]["tag_text"] == "[a] " and rows[0]["has_more"] and rows[0]["quota_remaining"] == 10
    assert rows[1]["tags"] == [] and rows[1]["link"] == "http://www.stackoverflow.com/"
    assert rows[2]["tags"] is None and not rows[2]["has_more"] and rows[2]["quota_max"] == 0


SEARCHES = "user_id int, seq int, query_type string, tags string, sort string, visible boolean"


def searches(spark):
    rows = [(1, 0, "manual", "a b", "VOTES", True), (1, 3, "runtime", "", "RELEVANCE", False), (2, 1, "action", "", "RELEVANCE", True)]
    return spark.createDataFrame(rows, SEARCHES)


def test_telemetry_round_trip(spark, tmp_path):
    events = te.query_events(searches(spark)).withColumn("project", F.lit("java"))
    off = spark.createDataFrame([(2, True, False)], "user_id int, auto_query boolean, logging boolean")
    lines = telemetry.telemetry_lines(events, "env", off)
    telemetry.write_telemetry(lines, str(tmp_path / "log"))
    raw = sorted(r[0] for r in spark.read.text(str(tmp_path / "log")).collect())
    assert raw == [
        '{"User":"1","ProjectCode":"3254818","Environment":"env","QueryEventType":"manual","Tags":[97,98],"sort":"votes"}',
        '{"User":"1","ProjectCode":"3254818","Environment":"env","QueryEventType":"runtime","Visible":"false"}',
    ]
    assert telemetry.read_telemetry(spark, str(tmp_path / "log")).count() == 2


@pytest.mark.parametrize("multi_line", [False, True])
def test_log_batches(spark, tmp_path, multi_line):
    events = [{"User": "u", "QueryEventType": "manual", "Tags": [0]}, {"User": "u", "ResultEventType": "expand", "Index": 2}]
    text = json.dumps({"Logs": events}, indent=1 if multi_line else None)
    (tmp_path / "batch.json").write_text(text + "\n")
    rows = telemetry.read_log_batches(spark, str(tmp_path), multi_line=multi_line).collect()
    assert [(r["QueryEventType"], r["ResultEventType"], r["Index"]) for r in rows] == [("manual", None, None), (None, "expand", 2)]


def test_result_events(spark):
    clicks = spark.createDataFrame(
        [(1, 1, "expand", 0, 5), (1, 4, "browser", 1, 5), (2, 0, "expand", 2, 5)],
        "user_id int, seq int, type string, index int, total int",
    )
    found = {(r["user_id"], r["seq"]): r["SourceQuery"] for r in te.result_events(clicks, searches(spark)).collect()}
    assert found == {(1, 1): "manual", (1, 4): "runtime", (2, 0): "-1"}


def test_settings_events(spark):
    flags = "auto_query boolean, runtime_error boolean, compile_error boolean, difficulty boolean, logging boolean"
    row = te.settings_events(spark.createDataFrame([(1, True, False, True, True, False)], f"user_id int, {flags}")).first()
    assert tuple(row) == (1, "Changed", "true", "false", "true", "true", "false")


def test_messages_of_a_queue(spark):
    raw = spark.createDataFrame([('{"user_id": 1, "kind": "Click"}',)], "value string")
    row = streams.from_messages(raw, "user_id long, kind string").first()
    assert tuple(row) == (1, "Click")
