"""Schemas of the tables and streams the operators read."""

POST = "post_id LONG, tags ARRAY<STRING>, body STRING, excerpt STRING, title STRING, link STRING"

RESPONSE = (
    "items ARRAY<STRUCT<question_id: LONG, tags: ARRAY<STRING>, body: STRING, excerpt: STRING, "
    "title: STRING, link: STRING>>, has_more BOOLEAN, quota_max INT, quota_remaining INT"
)

STAT = "term STRING, ctf LONG, df LONG, idf DOUBLE, ictf DOUBLE"

EDITOR_EVENT = (
    "user_id LONG, project STRING, event_id LONG, ts TIMESTAMP, kind STRING, text STRING"
)

RAW_EDIT = (
    "user_id LONG, project STRING, event_id LONG, ts TIMESTAMP, action STRING, "
    "old_text STRING, new_text STRING, old_center DOUBLE, new_center DOUBLE"
)

CONSOLE = (
    "console_id LONG, user_id LONG, ts TIMESTAMP, seq LONG, content_type STRING, chunk STRING"
)

# One nullable column per field of every telemetry body.
TELEMETRY = (
    "User STRING, ProjectCode STRING, Environment STRING, "
    "QueryEventType STRING, Tags ARRAY<INT>, sort STRING, Visible STRING, "
    "ResultEventType STRING, SourceQuery STRING, Index INT, Total INT, "
    "DifficultyEventType STRING, State STRING, scroll INT, click INT, `insert` INT, `delete` INT, "
    "SettingsEventType STRING, AUTO_QUERY STRING, RUNTIME_ERROR STRING, COMPILE_ERROR STRING, "
    "DIFFICULTY STRING, LOGGING STRING"
)

SETTING_FLAGS = ("auto_query", "runtime_error", "compile_error", "difficulty", "logging")
