"""Streams of editor actions, editor events and console output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators.editor import classify_editor_events
from askmill.schemas import CONSOLE, EDITOR_EVENT, RAW_EDIT


def _files(
    spark: SparkSession, path: str, schema: str, format: str, files_per_trigger: int | None
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(format)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def from_messages(messages: DataFrame, schema: str) -> DataFrame:
    """Rows of a schema from the JSON in the `value` column of a message queue's stream."""
    parsed = F.from_json(F.col("value").cast("string"), schema)
    return messages.select(parsed.alias("_row")).select("_row.*")


def editor_event_stream(
    spark: SparkSession, path: str, *, format: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of classified events: user_id, project, event_id, ts, kind, text."""
    return _files(spark, path, EDITOR_EVENT, format, files_per_trigger)


def raw_edit_stream(
    spark: SparkSession, path: str, *, format: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of raw changes, scrolls and clicks, classified on the way in."""
    return classify_editor_events(_files(spark, path, RAW_EDIT, format, files_per_trigger))


def console_stream(
    spark: SparkSession, path: str, *, format: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of console chunks: console_id, user_id, ts, seq, content_type, chunk."""
    return _files(spark, path, CONSOLE, format, files_per_trigger)
