"""Telemetry lines: writing them, and reading the shipped envelopes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from askmill.functions.text import string_hash
from askmill.operators.editor import settings_gate
from askmill.schemas import TELEMETRY

_BODY = [field.split()[0].strip("`") for field in TELEMETRY.split(", ")][3:]


def telemetry_lines(
    events: DataFrame, environment: str, settings: DataFrame | None = None
) -> DataFrame:
    """One JSON line (`value`) per event: user, project code and environment before the body.

    Body columns are those of the telemetry schema that `events` has; nulls are left out. A project
    column gives the project code, its string hash; without one the code is 0. With `settings`, only
    users who have logging on are written.
    """
    allowed = events if settings is None else settings_gate(events, settings, "logging")
    code = string_hash(F.col("project")) if "project" in events.columns else F.lit(0)
    body = [c for c in _BODY if c in events.columns]
    line = F.struct(
        F.col("user_id").cast("string").alias("User"),
        code.cast("string").alias("ProjectCode"),
        F.lit(environment).alias("Environment"),
        *body,
    )
    return allowed.select(F.to_json(line).alias("value"))


def write_telemetry(
    lines: DataFrame, path: str, checkpoint: str | None = None
) -> StreamingQuery | None:
    """Append lines as text files; a stream needs a checkpoint folder and gives its query."""
    if lines.isStreaming:
        return lines.writeStream.format("text").option("checkpointLocation", checkpoint).start(path)
    lines.write.mode("append").text(path)
    return None


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Lines written by `write_telemetry`, one nullable column per field."""
    return spark.read.schema(TELEMETRY).json(path)


def _events(envelopes: DataFrame) -> DataFrame:
    return envelopes.select(F.explode("Logs").alias("_event")).select("_event.*")


LATENESS = "1 day"

_ENVELOPE = f"Logs ARRAY<STRUCT<{TELEMETRY}>>"


def read_log_batches(spark: SparkSession, path: str, *, multi_line: bool = False) -> DataFrame:
    """One row per event of shipped `{"Logs": [event, ...]}` envelopes.

    An envelope is one line, so large files split; `multi_line` reads files that hold one
    pretty-printed envelope each.
    """
    reader = spark.read.schema(_ENVELOPE).option("multiLine", multi_line)
    return _events(reader.json(path))


def log_batch_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over a folder that envelopes arrive in."""
    return _events(spark.readStream.schema(_ENVELOPE).json(path))


def _envelopes(lines: DataFrame) -> DataFrame:
    read = F.from_json("value", f"{_ENVELOPE}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    sent = lines.select(
        "value",
        F.sha2("value", 256).alias("digest"),
        F.col("_metadata.file_modification_time").alias("arrived"),
        F.col("_metadata.file_path").alias("file"),
    ).where(F.trim("value") != "")
    good = F.col("_read._bad").isNull() & F.col("_read.Logs").isNotNull()
    parsed = sent.withColumn("_read", read).withColumn("Logs", F.when(good, F.col("_read.Logs")))
    return parsed.drop("_read")


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Shipped envelopes, one to a line, as they came: value, digest, arrived, file, Logs.

    Logs is null for what is no envelope: a line torn by a broken transfer, other JSON, or an event with
    a field of the wrong kind. Blank lines are nothing.
    """
    return _envelopes(spark.read.text(path))


def envelope_stream(
    spark: SparkSession, path: str, *, files_per_trigger: int | None = None
) -> DataFrame:
    """The same as a stream over a folder that envelopes arrive in."""
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _envelopes(reader.text(path))


def _once(envelopes: DataFrame, lateness: str) -> DataFrame:
    if envelopes.isStreaming:
        return envelopes.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["digest"])
    return envelopes.dropDuplicates(["digest"])


def events_once(envelopes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event of the envelopes once, however often its envelope was sent.

    Envelopes of equal text are one, as a sender that repeats itself can't be told from two that say the
    same. A stream remembers an envelope for `lateness` after it has arrived.
    """
    return _events(_once(envelopes.where(F.col("Logs").isNotNull()), lateness))


def dead_letters(envelopes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """What is no envelope, each text once: digest, arrived, file, value."""
    bad = _once(envelopes.where(F.col("Logs").isNull()), lateness)
    return bad.select("digest", "arrived", "file", "value")
