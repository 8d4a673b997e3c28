"""Near duplicates of embeddings by collision-counting projections.

Every vector is projected onto `PROJECTIONS` seeded unit directions, and its `EXTREMES` largest projections
in size are kept, with their signs: near vectors are extreme along the same directions, far ones seldom
are. Two vectors collide on a direction where both are extreme on the same side and one's value lies in the
window of `2 * window` around the other's. Pairs are looked up in sorted lists, one for each two signed
directions: a list holds the vectors extreme on both, sorted by the sum of the two values, which is their
projection onto the bisector. So of half a million one-dimensional projections a vector is only in those
where it lies in the tail, 28 lists, and each list is a small share of all vectors.

Scanning a list, a vector's window gives its partners; each row carries all its extremes, so the collisions
of a pair are counted on the spot and the pair is passed on by one list only, that of its first two
collisions. Pairs with at least the calibrated count are verified by their cosine in double precision. The
count is the largest that finds `RECALL` of pairs made at the threshold around a bounded sample of vectors
(`SAMPLE`); pairs above the threshold collide more often. In few dimensions near vectors have their extremes
along different ones of so many directions; where two collisions miss `RECALL` there, vectors of that
dimension are projected onto half as many directions, again and again, until it is reached.

Equal vectors are one node with a count. A list longer than `CELL` is split into blocks and pairs of blocks, so no
task scans a list that grows without bound.

Nulls, empty and repeated rows: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; so do vectors of other dimensions, which have no cosine
with each other. Rows that repeat a vector link with each other. A null `vec_id` names a component only
where all have none. An empty table gives no rows. Other columns, labels included, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.llm.frames import stored
from askmill.llm.graph import components

THRESHOLD = 0.95
PROJECTIONS = 512
EXTREMES = 8
RECALL = 0.99
SAMPLE = 2_000
#: Pairs that decide on the number of directions; a smaller sample is repeated.
LEAST_SAMPLE = 500
SEED = 7
#: Rows of a list that one task scans.
CELL = 4096


@cache
def directions(dimension: int, seed: int = SEED) -> np.ndarray:
    """Columns of unit length."""
    made = np.random.default_rng([seed, dimension]).standard_normal((dimension, PROJECTIONS))
    return made / np.linalg.norm(made, axis=0)


def half_window(threshold: float, dimension: int) -> float:
    """Four standard deviations of the difference that a pair at the threshold has along a direction."""
    return 4 * np.sqrt(2 - 2 * threshold) / np.sqrt(dimension)


def extremes(unit: np.ndarray, projections: int = PROJECTIONS) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors as rows: their signed extreme directions in ascending order, and the sizes there."""
    values = unit @ directions(unit.shape[1])[:, :projections]
    top = np.argpartition(-np.abs(values), EXTREMES, axis=1)[:, :EXTREMES]
    values = np.take_along_axis(values, top, 1)
    codes = top * 2 + (values > 0)
    order = np.argsort(codes, axis=1)
    return np.take_along_axis(codes, order, 1).astype(np.int16), np.take_along_axis(np.abs(values), order, 1)


def collisions(codes: np.ndarray, values: np.ndarray, a: np.ndarray, b: np.ndarray, half) -> np.ndarray:
    """For pairs of rows, which of the first one's extremes collide with one of the second's."""
    near = np.abs(values[a][:, :, None] - values[b][:, None, :]) <= half
    return ((codes[a][:, :, None] == codes[b][:, None, :]) & near).any(axis=2)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _counts(unit: np.ndarray, threshold: float, projections: int = PROJECTIONS) -> np.ndarray:
    """Collisions of a pair at the threshold around each vector."""
    turn = np.random.default_rng(SEED).standard_normal(unit.shape)
    turn -= (turn * unit).sum(axis=1, keepdims=True) * unit
    other = threshold * unit + np.sqrt(1 - threshold**2) * _unit(turn)
    n = len(unit)
    codes, values = (np.concatenate(x) for x in zip(extremes(unit, projections), extremes(other, projections), strict=True))
    return collisions(codes, values, np.arange(n), np.arange(n, 2 * n), half_window(threshold, unit.shape[1])).sum(axis=1)


def calibrated(vectors: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL, projections: int = PROJECTIONS) -> int:
    """The largest count of collisions, 2 at least, that `recall` of pairs at the threshold reach."""
    counts = _counts(_unit(vectors), threshold, projections)
    return max([2, *(c for c in range(2, EXTREMES + 1) if (counts >= c).mean() >= recall)])


def projections_for(vectors: np.ndarray, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The most directions, halved from `PROJECTIONS`, with which `recall` of pairs at the threshold collide twice.

    The number that comes nearest where none reaches it. On a line there are no pairs at the threshold.
    """
    if vectors.shape[1] < 2:
        return PROJECTIONS
    unit = _unit(np.repeat(vectors, -(-LEAST_SAMPLE // len(vectors)), axis=0))
    shares, projections = {}, PROJECTIONS
    while projections > EXTREMES:
        shares[projections] = (_counts(unit, threshold, projections) >= 2).mean()
        if shares[projections] >= recall:
            return projections
        projections //= 2
    return max(shares, key=shares.get)


_LIST = "`list` bigint, total double, node bigint, codes binary, `values` binary"


def lists(nodes: DataFrame, projections: dict[int, int] | None = None) -> DataFrame:
    """The rows of all lists for nodes(node, embedding); projections: by dimension, `PROJECTIONS` where not given."""
    used = projections or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.triu_indices(EXTREMES, 1)
        for batch in batches:
            ids = batch["node"].to_numpy()
            size = pa.compute.list_value_length(batch["embedding"]).to_numpy()
            for dimension in np.unique(size).tolist():
                at = np.flatnonzero(size == dimension)
                for some in np.array_split(at, -(-len(at) // 512)):
                    own = batch["embedding"].take(pa.array(some)).flatten().to_numpy().reshape(-1, dimension)
                    codes, values = extremes(_unit(own.astype(float)), used.get(dimension, PROJECTIONS))
                    n, k = len(some), len(first)
                    key = dimension << 22 | codes[:, first].astype(np.int64) << 11 | codes[:, second].astype(np.int64)
                    total = values[:, first] + values[:, second]
                    raw = [r.tobytes() for r in codes], [r.tobytes() for r in values]
                    pick = pa.array(np.repeat(np.arange(n), k))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.ravel()),
                            pa.array(total.ravel()),
                            pa.array(np.repeat(ids[some], k)),
                            *(pa.array(r, pa.binary()).take(pick) for r in raw),
                        ],
                        names=["list", "total", "node", "codes", "values"],
                    )

    return nodes.select("node", "embedding").mapInArrow(run, _LIST)


def _decoded(rows: pa.Table) -> tuple:
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.int16).reshape(-1, EXTREMES)
    values = np.frombuffer(b"".join(rows["values"].to_pylist()), float).reshape(-1, EXTREMES)
    return rows["list"].to_numpy(), rows["total"].to_numpy(), rows["node"].to_numpy(), codes, values


def scanned(rows: tuple, least: int, threshold: float, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes passed on by sorted lists; `apart` keeps only pairs from two different blocks."""
    keys, totals, nodes, codes, values = rows
    which, at = np.unique(keys >> 22, return_inverse=True)
    half = np.array([half_window(threshold, d) for d in which.tolist()])[at]
    out_a, out_b = [], []
    rest, shift = np.arange(len(keys)), 1
    while len(rest):
        rest = rest[rest + shift < len(keys)]
        other = rest + shift
        rest = rest[(keys[rest] == keys[other]) & (totals[other] - totals[rest] <= 2 * half[rest])]
        pairs = rest if apart is None else rest[apart[rest] != apart[rest + shift]]
        for some in np.array_split(pairs, -(-len(pairs) // 20_000)) if len(pairs) else ():
            own = codes[some]
            hit = collisions(codes, values, some, some + shift, half[some][:, None, None])
            enough = hit.sum(axis=1) >= least
            some, own, hit = some[enough], own[enough], hit[enough]
            one = hit.argmax(axis=1)
            at = np.arange(len(some))
            hit[at, one] = False
            two = hit.argmax(axis=1)
            here = own[at, one].astype(np.int64) << 11 | own[at, two].astype(np.int64)
            mine = here == (keys[some] & ((1 << 22) - 1))
            out_a.append(nodes[some[mine]])
            out_b.append(nodes[some[mine] + shift])
        shift += 1
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b)


def candidates(
    nodes: DataFrame, least: int, threshold: float = THRESHOLD, cell: int = CELL, projections: dict[int, int] | None = None
) -> DataFrame:
    """a, b: pairs of nodes with at least `least` collisions, each once."""
    kinds = f"a bigint, b bigint, {_LIST}"
    names = ["list", "total", "node", "codes", "values"]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.Table:
        void = {n: pa.nulls(len(a), t) for n, t in zip(names, (pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()), strict=True)}
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), **void})

    def long(rows: pa.Table) -> pa.Table:
        void = pa.nulls(len(rows), pa.int64())
        return pa.table({"a": void, "b": void, **{n: rows[n] for n in names}})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if large is not None:
                own = int(np.searchsorted(rows["list"].to_numpy(), large, "right"))
                yield from long(rows.slice(0, own)).to_batches()
                rows = rows.slice(own)
                if not len(rows):
                    continue
                large = None
            rows = rows if held is None else pa.concat_tables([held, rows])
            keys = rows["list"].to_numpy()
            which, counts = np.unique(keys, return_counts=True)
            too_long = which[counts > cell]
            for key in too_long.tolist():
                yield from long(rows.filter(pa.array(keys == key))).to_batches()
            if len(too_long) and too_long[-1] == keys[-1]:
                large = int(keys[-1])
            cut = len(keys) if large is not None else int(np.searchsorted(keys, keys[-1]))
            whole = rows.slice(0, cut)
            whole = whole.filter(pa.array(~np.isin(keys[:cut], too_long))) if len(too_long) else whole
            if len(whole):
                yield from pairs(*scanned(_decoded(whole), least, threshold)).to_batches()
            held = rows.slice(cut).combine_chunks() if cut < len(keys) else None
            if held is not None and held["list"][0].as_py() in set(too_long.tolist()):
                held = None
        if held is not None and len(held):
            yield from pairs(*scanned(_decoded(held), least, threshold)).to_batches()

    placed = lists(nodes, projections).repartition("list").sortWithinPartitions("list", "total", "node")
    met = stored(placed.mapInArrow(scan, kinds), "lists")
    found = met.where("a is not null").select("a", "b")

    # Long lists: blocks by the hash of the node, and a scan for each pair of blocks.
    hot = met.where("a is null").drop("a", "b")
    blocks = stored(hot.groupBy("list").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(cell)).cast("int").alias("blocks")), "long-lists")
    if blocks.isEmpty():
        return found
    dealt = hot.join(blocks, "list").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def cross(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("total", "ascending"), ("node", "ascending")])
        apart = None if rows["i"][0].as_py() == rows["j"][0].as_py() else rows["own"].to_numpy()
        a, b = scanned(_decoded(rows), least, threshold, apart)
        return pa.table({"a": a, "b": b})

    return found.unionByName(dealt.groupBy("list", "i", "j").applyInArrow(cross, "a bigint, b bigint"))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite, one at least not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def verified(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, cosine of the pairs that reach the threshold."""

    kind = "<f4" if isinstance(nodes.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, kind).tobytes() for v in batch["embedding"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(raw, pa.binary())], names=["node", "raw"])

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), -2.0)
        size = x.map(len).to_numpy()
        same = size == y.map(len).to_numpy()
        for length in np.unique(size[same]).tolist():
            at = np.flatnonzero(same & (size == length))
            a, b = (np.frombuffer(b"".join(v.to_numpy()[at]), kind).reshape(len(at), -1).astype(float) for v in (x, y))
            a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
            out[at] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
        return pd.Series(out)

    own = nodes.select("node", "embedding").mapInArrow(packed, "node bigint, raw binary")
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    return both.select("a", "b", cosine("x", "y").alias("cosine")).where(F.col("cosine") >= threshold)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding)."""
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    rows = stored(
        rows.withColumn("fit", usable(F.col("embedding")))
        .withColumn("h1", F.when(F.col("fit"), F.xxhash64("embedding")))
        .withColumn("h2", F.when(F.col("fit"), F.xxhash64(F.lit(SEED), "embedding"))),
        "vectors",
    )
    fit = rows.where("fit")
    nodes = fit.groupBy("h1", "h2").agg(
        F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    sample = nodes.select("h1", "embedding").orderBy("h1").limit(SAMPLE).toPandas()["embedding"]
    by_size = sample.groupby(sample.map(len)).apply(list) if len(sample) else []
    samples = [np.array(v, float) for v in by_size]
    # Dimensions too rare for the sample get one of their own.
    sizes = {r[0] for r in nodes.select(F.size("embedding")).distinct().collect()} - {v.shape[1] for v in samples}
    for size in sorted(sizes):
        rare = nodes.where(F.size("embedding") == size).select("h1", "embedding").orderBy("h1").limit(LEAST_SAMPLE)
        samples.append(np.array(rare.toPandas()["embedding"].tolist(), float))
    used = {v.shape[1]: projections_for(v, threshold) for v in samples}
    least = min([calibrated(v, threshold, projections=used[v.shape[1]]) for v in samples], default=2)
    links = stored(verified(candidates(nodes, least, threshold, projections=used), nodes, threshold), "links")

    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = nodes.select(F.col("node").alias("b"), "copies")
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    roots = components(links, "a", "b")
    named = nodes.select("node", "h1", "h2", "copies", "least").join(degree, F.col("node") == F.col("a"), "left")
    named = named.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    named = stored(
        named.select("h1", "h2", "root", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named"
    )
    least_id = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least_id, "root").select("h1", "h2", "n_links", "component_id")
    linked = fit.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
