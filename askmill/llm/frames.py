"""Helpers shared by the operators: stored tables, running totals over a global order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.session import stored

__all__ = ["add_fields", "binary", "running_totals", "stored", "table", "zero_if_empty"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def add_fields(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])


def zero_if_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def running_totals(df: DataFrame, order: list, size: str, total: str, place: str | None = None) -> DataFrame:
    """Adds the sum of `size` over all rows before this one in `order`, and the row's place from 0.

    One range shuffle of rows that should be narrow. Each task sums along its own sorted range; one row
    for each range then says where it starts, and that table is as long as there are partitions. Rows
    that tie in `order` stay in one task, so the order should end in a column that tells rows apart.
    """
    kinds = {"_part": T.IntegerType(), "_sum": T.LongType(), "_row": T.LongType()}
    schema = add_fields(df.schema, **kinds)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(size).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            n = len(sizes)
            before = ends - sizes + so_far
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(before), pa.array(np.arange(rows, rows + n))],
                names=[f.name for f in schema.fields],
            )
            rows, so_far = rows + n, so_far + int(sizes.sum())

    local = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(along, schema), "ranges")
    ranges = local.groupBy("_part").agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(
        "_part",
        zero_if_empty(F.sum("_size").over(earlier)).alias("_size_start"),
        zero_if_empty(F.sum("_rows").over(earlier)).alias("_row_start"),
    )
    out = local.join(F.broadcast(starts), "_part").withColumn(total, F.col("_sum") + F.col("_size_start"))
    if place:
        out = out.withColumn(place, F.col("_row") + F.col("_row_start"))
    return out.drop(*kinds, "_size_start", "_row_start")
