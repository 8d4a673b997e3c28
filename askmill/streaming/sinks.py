"""Streams that end in a table or a search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from askmill.operators import errors as er
from askmill.operators.difficulty import difficulty_queries, difficulty_triggers
from askmill.operators.personal import tag_profile
from askmill.operators.search import Index, error_search
from askmill.plans.jobs import USER_RUN, error_results, line_messages, personalised_search, trigger_requests
from askmill.plans.ordered import hot_keys
from askmill.session import shared_name, stored

Sink = Callable[[DataFrame, int], None]


PROFILE = "user_id LONG, tag STRING, clicks LONG"
_BASES = "upto LONG, base STRING"


def keep_profile(
    interactions: DataFrame,
    path: str,
    checkpoint: str,
    *,
    available_now: bool = False,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Keep a profile table up to date under `path`, from weighted interactions.

    Every micro-batch writes the clicks it adds to a folder of its own, so a repeated batch
    overwrites what it wrote before. `profile_at` adds them up; after every `compact_every` batches the
    sums so far become a base that later readers start from. `available_now` stops once the data there is
    has been taken in.
    """

    def write(fresh: DataFrame, batch: int) -> None:
        tag_profile(fresh).write.mode("overwrite").parquet(f"{path}/deltas/batch={batch}")
        if compact_every and (batch + 1) % compact_every == 0:
            compact_profile(fresh.sparkSession, path, batch)

    stream = interactions.writeStream
    if available_now:
        stream = stream.trigger(availableNow=True)
    return stream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been begun."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def profile_at(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The profile after micro-batch `version`, or the last one: user_id, tag, clicks.

    Reads the last base up to that batch and the deltas after it. What a version holds never changes,
    whether it is compacted or batches come in meanwhile; the last one is fixed when this is called.
    """
    deltas = _table(spark, f"{path}/deltas", f"{PROFILE}, batch LONG")
    if version is None:
        version = deltas.agg(F.max("batch")).first()[0]
    bases = _table(spark, f"{path}/manifest", _BASES).where(F.col("upto") <= F.lit(version))
    base = bases.orderBy(F.desc("upto"), "base").first()
    after = -1 if base is None else base["upto"]
    rows = deltas.where((F.col("batch") > after) & (F.col("batch") <= F.lit(version))).drop("batch")
    if base is not None:
        rows = rows.unionByName(spark.read.schema(PROFILE).parquet(f"{path}/{base['base']}"))
    return rows.groupBy("user_id", "tag").agg(F.sum("clicks").alias("clicks"))


def latest_profile(spark: SparkSession, path: str) -> DataFrame:
    return profile_at(spark, path)


def compact_profile(spark: SparkSession, path: str, version: int) -> None:
    """Make the profile after micro-batch `version` the base of later reads.

    The base is written whole to a folder of its own, and counts once the manifest names it. Done twice,
    or broken off, it changes nothing that a reader sees. Older folders stay, for readers of older versions.
    """
    base = shared_name("base")
    profile_at(spark, path, version).write.parquet(f"{path}/{base}")
    named = spark.createDataFrame([(version, base)], _BASES)
    named.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def search_when_stuck(
    log: DataFrame,
    contexts: DataFrame,
    settings: DataFrame,
    visible: DataFrame,
    posts: DataFrame,
    index: Index,
    stats: DataFrame,
    doc_count: Column,
    profile: DataFrame,
    tag_stats: DataFrame,
    sink: Sink,
    checkpoint: str,
    keys: Sequence[str] = ("user_id",),
    **marks: str,
) -> StreamingQuery:
    """Search for every trigger in the stream of `detect_difficulty_stream` and pass the ranked
    results of each micro-batch to `sink`. `keys` are those of the stream's machines."""

    def search(lines: DataFrame, batch: int) -> None:
        triggers = difficulty_triggers(lines, keys)
        stuck = difficulty_queries(triggers, contexts, settings, visible, keys)
        requests = stored(trigger_requests(stuck, stats, doc_count), "requests")
        sink(personalised_search(requests, posts, index, profile, tag_stats, **marks), batch)

    return log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(search).start()


def search_runtime_errors(
    lines: DataFrame,
    index: Index,
    stats: DataFrame,
    sink: Sink,
    checkpoint: str,
    **options: str,
) -> StreamingQuery:
    """Search for every failed run in the stream of `console_lines_stream`.

    A run's lines come out of one micro-batch, so its queries are made there.
    """

    def search(batch_lines: DataFrame, batch: int) -> None:
        queries = er.error_queries(line_messages(batch_lines), stats, er.RUNTIME, **options)
        sink(error_search(queries, index), batch)

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(search).start()


def rank_runtime_errors(
    lines: DataFrame,
    visible: DataFrame,
    posts: DataFrame,
    index: Index,
    stats: DataFrame,
    profile: DataFrame,
    tag_stats: DataFrame,
    sink: Sink,
    checkpoint: str,
    **marks: str,
) -> StreamingQuery:
    """The same for the users whose tool window is open, with ranked and excerpted results.

    `lines` have user_id: the stream's consoles are those of (console_id, user_id).
    """

    def search(batch_lines: DataFrame, batch: int) -> None:
        queries = er.error_queries(line_messages(batch_lines), stats, er.RUNTIME, keys=USER_RUN)
        sink(error_results(queries, visible, posts, index, profile, tag_stats, **marks), batch)

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(search).start()


def _console_schemas(keys: dict[str, str]) -> tuple[str, str]:
    given = ", ".join(f"`{k}` {kind}" for k, kind in keys.items())
    return (
        f"{given}, run long, category string, no long, text string, batch long, kind string, bucket int",
        f"{given}, run long, category string, line_no long, text string, batch long",
    )


def keep_console_lines(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    *,
    keys: Sequence[str] = ("console_id",),
    buckets: int = 64,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the lines of failed console runs under `path`, from `console_rows_stream`.

    A micro-batch's rows are written once, to a folder of their own that a repeated batch overwrites. Chunks of
    silent and long runs lie in folders by bucket of their console; the end of such a run, however late,
    fetches them from the buckets it needs and writes the lines. `console_lines_at` reads both.
    """
    kinds = {k: rows.schema[k].dataType.simpleString() for k in keys}
    steps, _ = _console_schemas(kinds)
    names = list(kinds)

    def write(fresh: DataFrame, batch: int) -> None:
        spark = fresh.sparkSession
        own = F.when(F.col("kind") == "chunk", F.pmod(F.hash(*names), F.lit(buckets))).otherwise(F.lit(-1))
        here = f"{path}/rows/batch={batch}"
        laid = fresh.withColumn("bucket", own)
        laid.write.mode("overwrite").partitionBy("kind", "bucket").parquet(here)
        whole = _table(spark, f"{path}/rows", steps)
        ended = whole.where((F.col("batch") == batch) & (F.col("kind") == "ended")).select(*names, "run")
        ended = stored(ended.withColumn("bucket", F.pmod(F.hash(*names), F.lit(buckets))), "ended")
        if ended.isEmpty():
            return
        # at most `buckets` numbers: they prune the folders that are read
        needed = [r["bucket"] for r in ended.select("bucket").distinct().collect()]
        chunks = whole.where((F.col("kind") == "chunk") & F.col("bucket").isin(needed) & (F.col("batch") <= batch))
        met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*names, "run")]
        told = ended.select(*(F.col(k).alias(f"_{k}") for k in (*names, "run")))
        chunks = chunks.select(*names, "run", "category", "no", F.col("text").alias("chunk")).join(told, met, "left_semi")
        made = er.chunk_lines(chunks, names, "no", hot_keys(chunks, names))
        made.write.mode("overwrite").parquet(f"{path}/fetched/batch={batch}")

    stream = rows.writeStream
    if available_now:
        stream = stream.trigger(availableNow=True)
    return stream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def console_lines_at(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """The lines kept so far: the keys, run, category, line_no, text. `keys` gives the keys' types."""
    steps, lines = _console_schemas(keys)
    kept = _table(spark, f"{path}/rows", steps).where("kind = 'line'").withColumnRenamed("no", "line_no")
    columns = [*keys, "run", "category", "line_no", "text"]
    return kept.select(columns).unionByName(_table(spark, f"{path}/fetched", lines).select(columns))
