"""Session settings the operators rely on, and reliable checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans from measured sizes: it broadcasts a side only once that side is known
# to be small, and splits the oversized partition of a hot join key.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Turn on adaptive joins with skew splitting, and fix the session clock to UTC."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    A session within one process that names none gets a temporary one; where executors are processes
    of their own that would not survive one, so it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="askmill-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write `df` once to the shared folder, in folders by the given columns, and read it back.

    Lineage ends there, a lost executor costs nothing, and the planner knows the table's size: joins
    with it are broadcast only if it has turned out to be small.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """The same in so many buckets by a key, so that joins by it shuffle their other side only."""
    spark = df.sparkSession
    table = shared_name(name).replace("-", "_")
    df.write.bucketBy(parts, key).option("path", shared_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


BROADCAST_ROWS = 200_000


def unless_long(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored table, of so many rows if known, that joins never broadcast if it has many.

    Files of long tables with few distinct values are far smaller than the rows are in a driver's memory, so
    the size of the files says too little.
    """
    rows = table.count() if rows is None else rows
    return table.hint("merge") if rows > BROADCAST_ROWS else table


def by_rows(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, broadcast by joins if it has few and never if it has many."""
    return table.hint("merge" if table.count() > BROADCAST_ROWS else "broadcast")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a small scan over the cores before costly work on its rows.

    A file of one row group is one task's work however it is split, so a scan counts as small up to
    two splits per core, and never above 64 splits; larger tables come back as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores, key) if splits < min(2 * cores, 64) else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, inside the checkpoint folder all executors share."""
    return f"{_checkpoint_folder(spark)}/{shared_name(name)}"


def shared_name(name: str) -> str:
    """A folder name of its own."""
    return f"{name}-{uuid.uuid4().hex}"
