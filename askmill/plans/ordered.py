"""Ordered per-key work that stays parallel when one key holds a large part of all rows.

A window or a fold over a key runs in one task. Here the rows of every key with more than
`askmill.hotKeyRows` rows are range-partitioned by key and order into slices of bounded size; each
slice is worked on alone, and what the earlier slices pass on (a total, a last value, a few rows, a
fold state) is brought in from a table with one row per slice. Other keys take one plain window.

`order` names columns, ascending, and should order the rows of a key totally.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from askmill.session import stored

HOT_ROWS_CONF = "askmill.hotKeyRows"
HOT_ROWS = 2_000_000

SLICE = "_slice"


def _limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys with more rows than one task should sort, with their row counts, or None.

    One pass over the key columns, counted before the shuffle. At most rows / limit keys come back.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.where(F.col("_rows") > _limit(df)).collect()
    return df.sparkSession.createDataFrame(found, counts.schema) if found else None


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on columns where null equals null; the right side's copies of them are dropped."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return left.join(right, same, how).drop(*[f"_on_{c}" for c in on])


def _without(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _join(df, hot, keys, "left_anti")


def _slices(df: DataFrame, hot: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of hot keys with `_slice`, which rises with the order within each key.

    Written once: slice borders come from a sample, so all readers must see the same ones.
    """
    rows = hot.agg(F.sum("_rows")).first()[0]
    parts = max(2, math.ceil(2 * rows / _limit(df)))
    mine = _join(df, hot, keys, "left_semi")
    cut = mine.repartitionByRange(parts, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return stored(cut, "slices")


def _window(keys: Sequence[str], order: Sequence[str], first: int, last: int) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last)


_START = Window.unboundedPreceding


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    before: bool = False,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """Sum of `value` from the first row of the key up to this row, or up to the one before it."""
    if isinstance(hot, str):
        hot = hot_keys(df, keys)
    last = -1 if before else 0

    def local(rows: DataFrame, within: Sequence[str]) -> DataFrame:
        window = _window(within, order, _START, last)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(window), F.lit(0)))

    if hot is None:
        return local(df, keys)
    slices = _slices(df, hot, keys, order)
    totals = slices.groupBy(*keys, SLICE).agg(F.sum(value).alias("_total"))
    carried = totals.select(
        *keys, SLICE, F.sum("_total").over(_window(keys, [SLICE], _START, -1)).alias("_carried")
    )
    summed = _join(local(slices, [*keys, SLICE]), carried, [*keys, SLICE], "left")
    summed = summed.withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0)))
    return local(_without(df, hot, keys), keys).unionByName(summed.drop(SLICE, "_carried"))


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    *,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """0-based position within the key."""
    return running_sum(df, keys, order, F.lit(1), name, before=True, hot=hot)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    *,
    before: bool = False,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """The latest non-null `value` up to this row, or up to the one before it."""
    if isinstance(hot, str):
        hot = hot_keys(df, keys)
    last = -1 if before else 0

    def local(rows: DataFrame, within: Sequence[str]) -> DataFrame:
        window = _window(within, order, _START, last)
        return rows.withColumn(name, F.last(value, ignorenulls=True).over(window))

    if hot is None:
        return local(df, keys)
    slices = _slices(df, hot, keys, order)
    # rows whose order is null do not take part in max_by
    latest = F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))
    ends = slices.groupBy(*keys, SLICE).agg(latest.alias("_end"))
    window = _window(keys, [SLICE], _START, -1)
    carried = ends.select(*keys, SLICE, F.last("_end", ignorenulls=True).over(window).alias("_in"))
    known = _join(local(slices, [*keys, SLICE]), carried, [*keys, SLICE], "left")
    known = known.withColumn(name, F.coalesce(name, "_in"))
    return local(_without(df, hot, keys), keys).unionByName(known.drop(SLICE, "_in"))


def looking_back(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    depth: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    *,
    hot: DataFrame | None | str = "find",
) -> DataFrame:
    """Add window columns that look back at most `depth` rows.

    `columns` is given the window of a key's rows in order, without a frame. Every slice of a hot
    key starts with a copy of the `depth` rows before it, which is dropped again at the end.
    """
    if isinstance(hot, str):
        hot = hot_keys(df, keys)

    def local(rows: DataFrame, within: Sequence[str]) -> DataFrame:
        return rows.withColumns(columns(Window.partitionBy(*within).orderBy(*order)))

    if hot is None:
        return local(df, keys)
    slices = _slices(df, hot, keys, order)
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    newest = Window.partitionBy(*keys, SLICE).orderBy(*[F.desc(c) for c in order])
    tails = (
        slices.select(*keys, SLICE, row.alias("_row"), F.row_number().over(newest).alias("_n"))
        .where(F.col("_n") <= depth)
        .groupBy(*keys, SLICE)
        .agg(F.collect_list("_row").alias("_tail"))
    )
    # a slice has a row at least, so `depth` slices hold all rows that are looked back at
    earlier = F.flatten(F.collect_list("_tail").over(_window(keys, [SLICE], -depth, -1)))
    newest_first = F.slice(F.reverse(F.array_sort(earlier)), 1, depth)
    copies = tails.select(*keys, SLICE, newest_first.alias("_copy")).select(
        SLICE, F.explode("_copy").alias("_row")
    )
    copies = copies.select("_row.*", SLICE, F.lit(True).alias("_copied"))
    both = slices.withColumn("_copied", F.lit(False)).unionByName(copies)
    seen = local(both, [*keys, SLICE]).where(~F.col("_copied")).drop(SLICE, "_copied")
    return local(_without(df, hot, keys), keys).unionByName(seen)


# Takes the next rows of one key and the state left by those before (None at the start); gives
# output rows and the state it leaves.
Fold = Callable[[list[tuple], dict | None], tuple[list[tuple], dict]]

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _folding(
    fold: Fold, width: int, schema: StructType, *, has_entry: bool, exits: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: fold partition rows that are sorted by the first `width` columns and in order.

    Rows stream through in batches, so a key may be larger than memory. With `has_entry` the column
    after the key holds the state to start from; with `exits` the states left are put out.
    """
    fields = [pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema]
    arrow = pa.schema(fields)
    first = width + 1 if has_entry else width

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, fields)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            rows = list(zip(*[column.to_pylist() for column in batch.columns]))
            out: list[tuple] = []
            for this, group in groupby(rows, key=lambda row: row[:width]):
                mine = list(group)
                if this != key:
                    if exits and key is not None:
                        out.append((*key, json.dumps(state)))
                    entry = mine[0][width] if has_entry else None
                    key, state = this, json.loads(entry) if entry else None
                lines, state = fold([row[first:] for row in mine], state)
                if not exits:
                    out += [(*this, *line) for line in lines]
            yield batch_of(out)
        if exits and key is not None:
            yield batch_of([(*key, json.dumps(state))])

    return run


def fold_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, schema: str
) -> DataFrame:
    """Run a state machine over the rows of every key, in order.

    `fold` is given the columns of `df` that are not keys, as tuples; `schema` describes its output
    rows, which follow the key columns (long, int and string). States are JSON dictionaries.

    The slices of a hot key are first folded side by side, each as if it were the start. A slice
    whose incoming state turns out to be different is folded again, until the states agree; machines
    that forget their past soon agree after one more pass, and in the worst case the slices are
    folded one after the other. The result is that of one pass in order either way.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in keys]

    def sorted_by(rows: DataFrame, within: Sequence[str]) -> DataFrame:
        # a fixed number of tasks: few bytes can still be much work for a fold
        return rows.repartition(tasks, *within).sortWithinPartitions(*within, *order)

    def of(text: str) -> StructType:
        return spark.createDataFrame([], text).schema

    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    out_schema = of(f"{key_schema}, {schema}")
    plain = _folding(fold, len(keys), out_schema, has_entry=False, exits=False)

    hot = hot_keys(df, keys)
    rows = df.select(*keys, *rest)
    if hot is None:
        return sorted_by(rows, keys).mapInArrow(plain, out_schema)

    slices = _slices(rows, hot, keys, order)
    within = [*keys, SLICE]
    entry_schema = of(f"{key_schema}, {SLICE} int, _entry string")
    exit_schema = of(f"{key_schema}, {SLICE} int, _exit string")

    def with_entries(entries: dict[tuple, str | None]) -> DataFrame:
        table = spark.createDataFrame([(*k, v) for k, v in entries.items()], entry_schema)
        met = _join(slices, table, within, "inner").select(*within, "_entry", *rest)
        return sorted_by(met, within)

    entries = {tuple(r): None for r in slices.select(*within).distinct().collect()}
    chain = sorted(entries, key=lambda k: (tuple(map(str, k[:-1])), k[-1]))
    exit_of: dict[tuple, str] = {}
    leaving = _folding(fold, len(within), exit_schema, has_entry=True, exits=True)
    stale = entries
    while stale:
        done = with_entries(stale).mapInArrow(leaving, exit_schema).collect()
        exit_of.update({tuple(r)[:-1]: r["_exit"] for r in done})
        stale = {}
        for previous, this in zip(chain, chain[1:]):
            if previous[:-1] == this[:-1] and entries[this] != exit_of[previous]:
                stale[this] = entries[this] = exit_of[previous]
    sliced_schema = of(f"{key_schema}, {SLICE} int, {schema}")
    putting = _folding(fold, len(within), sliced_schema, has_entry=True, exits=False)
    folded = with_entries(entries).mapInArrow(putting, sliced_schema).drop(SLICE)
    cold = sorted_by(_without(rows, hot, keys), keys).mapInArrow(plain, out_schema)
    return cold.unionByName(folded)
