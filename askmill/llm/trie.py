"""The trie of conversation prefixes, from padded matrices of turn ids.

A node of depth d stands for one sequence of first d turns (role and text); its members are the conversations
that start with it. What a serving cache or a loss mask can share is what a node's members share.

1. A turn gets its place in its conversation by a running count, and two 64-bit hashes of role, text and place as
   its id. A prefix is known by the exclusive or of its turns' ids.
2. Conversations are cut into segments of `WIDTH` turns, so that a very long one is many rows. A segment is sorted by
   its number, the prefix before it, its turn ids and its conversation, and dealt by range to shards of about
   `SHARD_ROWS` rows. Equal segments may go on over several shards.
3. A shard is one padded matrix of turn ids: numpy's lexsort orders its rows, the masks of changed columns,
   accumulated with or, say where a node starts at each depth, and reduceat sums over its rows.
4. A node that holds the first or the last row of a shard may go on in the next one. Only such nodes are shuffled,
   and their sums are added up.

What a node says of its subtree is summed over its members, so nothing is handed up from depth to depth. A first
pass finds each node's smallest member, and so for each conversation the depth from which on it is the smallest member
of its nodes. A child is then counted by its smallest member, a leaf too; and the tokens that a node's subtree
saves are those of its other members from its depth on, up to where each becomes the smallest itself.

Nulls, ties, repeated rows: a null role or text counts as empty; null turns come first; turns of one number go by the
hashes of role and text, so it does not matter in which order they were read. Rows without a conversation are
left out. An empty table has no node, not even a root. Texts are read whole, only their hashes travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.frames import running_totals, stored, zero_if_empty

WIDTH = 32
SHARD_ROWS = 50_000
#: Segments of one conversation whose ids are combined by one window.
BLOCK = 4096
NEVER = 1 << 62
NOTHING = hashlib.sha256(b"").hexdigest()

NODE = (
    "depth bigint, x bigint, y bigint, above_x bigint, above_y bigint, conv_id bigint, n_convs bigint, n_ended bigint, "
    "above bigint, edge boolean, n_children bigint, n_leaves bigint, unshared bigint, parent_conv_id bigint, "
    "first bigint, ends string, ends_sha256 string"
)


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos from 0, a and b (hashes of role and text), size (UTF-8 bytes of the text), turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.octet_length(text).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),  # tells equal rows apart, so that many of them are many tasks' work
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b", "row"]
    counted = stored(running_totals(stored(rows, "turns"), order, "size", "before", "place"), "places")
    starts = counted.groupBy("conv_id").agg(F.min("place").alias("start"))
    return counted.join(starts, "conv_id").select("conv_id", (F.col("place") - F.col("start")).alias("pos"), "a", "b", "size", "turn")


def members(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns), size (bytes of its texts) of placed turns."""
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


def segments(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """seg, x, y, above (ids and bytes before it), ids, sizes, conv_id, n: the conversations in pieces of `width` turns."""
    at = F.col("pos")
    ids = turns.select(
        "conv_id",
        F.floor(at / width).alias("seg"),
        (at % width).alias("at"),
        F.xxhash64("a", "b", "pos").alias("x"),
        F.xxhash64("pos", "b", "a").alias("y"),
        "size",
    )
    cut = ids.groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("at", "x", "y", "size"))).alias("turns"),
        F.bit_xor("x").alias("x"),
        F.bit_xor("y").alias("y"),
        F.sum("size").alias("size"),
    )
    cut = stored(cut.join(convs.select("conv_id", "n"), "conv_id"), "segments")
    # what stands before a segment: within blocks of segments, then over whole blocks
    narrow = cut.where(F.col("n") > width).select("conv_id", "seg", F.floor(F.col("seg") / BLOCK).alias("block"), "x", "y", "size")
    sums = lambda over: [F.bit_xor("x").over(over).alias("bx"), F.bit_xor("y").over(over).alias("by"), F.sum("size").over(over).alias("before")]
    inside = Window.partitionBy("conv_id", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = narrow.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = whole.select("conv_id", "block", *(c.alias(f"w{i}") for i, c in enumerate(sums(earlier))))
    before = narrow.select("conv_id", "seg", "block", *sums(inside)).join(blocks, ["conv_id", "block"])
    zero = F.lit(0).cast("long")
    each = lambda c, w: F.coalesce(c, zero).bitwiseXOR(F.coalesce(w, zero))
    before = before.select(
        "conv_id",
        "seg",
        each("bx", "w0").alias("bx"),
        each("by", "w1").alias("by"),
        (zero_if_empty(F.col("before")) + zero_if_empty(F.col("w2"))).alias("before"),
    )
    flat = [
        F.flatten(F.transform("turns", lambda t: F.array(t["x"], t["y"]))).alias("ids"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"),
        "conv_id",
        "n",
    ]
    first = cut.where("seg = 0").select("seg", zero.alias("x"), zero.alias("y"), zero.alias("above"), *flat)
    later = cut.where("seg > 0").drop("x", "y").join(before, ["conv_id", "seg"])
    return first.unionByName(later.select("seg", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("before").alias("above"), *flat))


def _padded(column: pa.Array, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the lists, shorter ones filled up, and the lists' lengths."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.diff(offsets)
    out = np.full((len(lengths), int(lengths.max(initial=0))), pad, np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]]
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out, lengths


def shard_nodes(rows: pa.Table, width: int, listed: bool) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard, a batch for each depth within the segments (columns of `NODE`).

    What ends at a node is listed on demand: digested, or as text where the node may go on in another shard.
    """
    ids, doubled = _padded(rows["ids"].combine_chunks(), np.iinfo(np.int64).min)
    sizes, _ = _padded(rows["sizes"].combine_chunks(), 0)
    plain = {c: rows[c].to_numpy() for c in ("seg", "x", "y", "above", "conv_id", "n", "since", "shared", "leaf")}
    order = np.lexsort([plain["conv_id"], *ids.T[::-1], plain["y"], plain["x"], plain["seg"]])
    ids, sizes, length = ids[order], sizes[order], doubled[order] // 2
    seg, x, y, above, conv, n, since, shared, leaf = (plain[c][order] for c in plain)

    changed = np.ones(ids.shape, bool)
    changed[1:] = ids[1:] != ids[:-1]
    changed = changed[:, 0::2] | changed[:, 1::2]
    head = (seg[1:] != seg[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    changed[1:, 0] |= head
    changed = np.logical_or.accumulate(changed, axis=1)

    before, last = None, len(conv)
    for j in range(ids.shape[1] // 2):
        on = length > j
        up_x, up_y, up = x.copy(), y.copy(), above.copy()
        x, y, above = x ^ np.where(on, ids[:, 2 * j], 0), y ^ np.where(on, ids[:, 2 * j + 1], 0), above + sizes[:, j]
        starts = np.flatnonzero(changed[:, j])
        ends = np.append(starts[1:], last)
        depth = seg * width + j + 1
        ended = on & (n == depth)
        least = np.minimum.reduceat(conv, starts)
        edge = (starts == 0) | (ends == last)
        n_ended = np.add.reduceat(ended.astype(np.int64), starts)
        parents = [None] * len(starts)
        if before is not None:
            run = np.searchsorted(before[0], starts, "right") - 1
            parents = [None if cut else p for p, cut in zip(before[1][run].tolist(), before[2][run].tolist(), strict=True)]
        firsts, texts, digests = [None] * len(starts), [None] * len(starts), [NOTHING] * len(starts)
        for i in np.flatnonzero(n_ended).tolist() if listed else ():
            run = slice(starts[i], ends[i])
            found = conv[run][ended[run]].tolist()
            text = ",".join(map(str, found))
            if edge[i]:
                firsts[i], texts[i], digests[i] = found[0], text, None
            else:
                digests[i] = hashlib.sha256(text.encode()).hexdigest()
        here = length[starts] > j
        columns = [
            depth[starts],
            x[starts],
            y[starts],
            up_x[starts],
            up_y[starts],
            least,
            ends - starts,
            n_ended,
            up[starts],
            edge,
            np.add.reduceat(((since <= depth + 1) & (n > depth)).astype(np.int64), starts),
            np.add.reduceat(leaf.astype(np.int64), starts),
            np.add.reduceat(np.where(since > depth, shared, 0), starts),
            pa.array(parents, pa.int64()),
            pa.array(firsts, pa.int64()),
            pa.array(texts, pa.string()),
            pa.array(digests, pa.string()),
        ]
        made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in NODE.split(", ")])
        yield made.filter(pa.array(here))
        before = starts, least, edge


def sharded(rows: DataFrame, width: int, shard_rows: int, listed: bool) -> DataFrame:
    """`NODE` rows of all shards of segments with since, shared, leaf; those marked `edge` may be in several shards."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-rows.count() // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if some:
            yield from shard_nodes(pa.Table.from_batches(some), width, listed)

    return rows.repartitionByRange(shards, "seg", "x", "y", "ids", "conv_id").mapInArrow(run, NODE)


KEY = ["depth", "x", "y"]


def _merged(parts: DataFrame) -> DataFrame:
    """The sums of the nodes' parts, without what ends there."""
    same = ["above_x", "above_y", "above"]
    sums = ["n_convs", "n_ended", "n_children", "n_leaves", "unshared"]
    return parts.groupBy(*KEY).agg(*(F.any_value(c).alias(c) for c in same), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))


def _digests(chunks: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256: chunks(depth, x, y, first, ends) in order of `first`, streamed through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, keys, made = None, None, [], []
        for batch in batches:
            for *new, text in zip(*(batch[c].to_pylist() for c in (*KEY, "ends")), strict=True):
                if new == key:
                    state.update(b",")
                else:
                    if key is not None:
                        keys.append(key), made.append(state.hexdigest())
                    key, state = new, hashlib.sha256()
                state.update(text.encode())
        if key is not None:
            keys.append(key), made.append(state.hexdigest())
        columns = list(zip(*keys, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(made, pa.string())], names=[*KEY, "ends_sha256"])

    dealt = chunks.select(*KEY, "first", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return dealt.mapInArrow(run, "depth bigint, x bigint, y bigint, ends_sha256 string")


def _root(convs: DataFrame) -> DataFrame:
    """The root's row: convs(conv_id, n, since, shared, leaf)."""
    zero = F.lit(0).cast("long")
    sums = convs.agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(F.col("n") == 0).alias("n_ended"),
        F.count_if((F.col("since") <= 1) & (F.col("n") > 0)).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("since") > 0, F.col("shared")).otherwise(0)).alias("unshared"),
    )
    return sums.where("n_convs > 0").select("*", *(zero.alias(c) for c in (*KEY, "above_x", "above_y", "above")))


def nodes(turns: DataFrame, convs: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of turns(conv_id, pos, a, b, size) of convs(conv_id, n, size), those without turns included.

    A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that its subtree shares) and ends_sha256 (of its members that end there).
    """
    cut = stored(segments(turns, convs, width), "padded")
    unknown = [F.lit(NEVER).alias("since"), F.lit(0).cast("long").alias("shared"), F.lit(False).alias("leaf")]
    slim = [*KEY, "conv_id", "n_convs", "n_ended", "above"]
    some = stored(sharded(cut.select("*", *unknown), width, shard_rows, False).select(*KEY, "above_x", "above_y", "above", "conv_id", "n_convs", "n_ended", "n_children", "n_leaves", "unshared", "edge"), "first-pass")
    least = some.where("NOT edge").select(*slim).unionByName(_merged(some.where("edge")).select(*slim))
    least = least.unionByName(_root(convs.select("conv_id", "n", *unknown)).select(*slim))

    # From `since` on a conversation is the smallest member of its nodes; up to there its `shared` bytes are others' too.
    firsts = least.groupBy("conv_id").agg(
        F.min("depth").alias("since"), F.min_by("above", "depth").alias("shared"), F.max(F.col("n_ended") == F.col("n_convs")).alias("leaf")
    )
    told = convs.join(firsts, "conv_id", "left").select(
        "conv_id",
        "n",
        F.coalesce("since", F.lit(NEVER)).alias("since"),
        F.coalesce("shared", "size", F.lit(0)).cast("long").alias("shared"),
        F.coalesce("leaf", F.lit(False)).alias("leaf"),
    )
    told = stored(told, "members")
    parts = stored(sharded(cut.join(told.drop("n"), "conv_id"), width, shard_rows, True), "second-pass")

    zero = F.lit(0).cast("long")
    turnless = told.where("n = 0").select("conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    chunks = parts.where("ends IS NOT NULL").select(*KEY, "first", "ends")
    chunks = chunks.unionByName(turnless.mapInArrow(_listed, "first bigint, ends string").select(*(zero.alias(c) for c in KEY), "first", "ends"))
    root = _root(told)
    crossing = _merged(parts.where("edge")).unionByName(root).join(_digests(chunks), KEY, "left")
    crossing = crossing.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).withColumn("parent_conv_id", F.lit(None).cast("long"))
    crossing = stored(crossing, "crossing")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "unshared", "above", "ends_sha256"]
    up = ["above_x", "above_y"]
    every = parts.where("NOT edge").select(*out, *up, "x", "y").unionByName(crossing.select(*out, *up, "x", "y"))

    # Parents that the shard did not see whole: the root, nodes over several shards, ends of segments.
    first = crossing.where("depth = 0").select("conv_id").scalar()
    at_cuts = parts.where("NOT edge").where(F.col("depth") % width == 0).select(*KEY, "conv_id")
    ends = crossing.where("depth > 0").select(*KEY, "conv_id").unionByName(at_cuts)
    ends = ends.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("above_x"), F.col("y").alias("above_y"), F.col("conv_id").alias("_parent"))
    unseen = F.col("parent_conv_id").isNull() & (F.col("depth") > 1)
    seen = every.where(~unseen).withColumn("parent_conv_id", F.when(F.col("depth") == 1, first).otherwise(F.col("parent_conv_id")))
    late = every.where(unseen).drop("parent_conv_id").join(ends, ["depth", *up]).withColumnRenamed("_parent", "parent_conv_id")
    saved = (F.col("unshared") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens")
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved, "ends_sha256"]
    return seen.select(*final).unionByName(late.select(*final))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids = batch["conv_id"].to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["first", "ends"])


def prefix_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of conversations(conv_id, turn, role, text) as they are."""
    turns = stored(placed(conversations), "placed")
    return nodes(turns, stored(members(turns), "convs"), width, shard_rows)


def node_texts(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes but for the root with role and text of their last turn, empty where null."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashes = {"a": F.xxhash64(F.lit(1), role, text), "b": F.xxhash64(F.lit(2), role, text)}
    own = conversations.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), *(c.alias(k) for k, c in hashes.items()))
    own = own.withColumn("turn", F.struct("turn")).groupBy("conv_id", "turn", "a", "b").agg(F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    at = placed(conversations).select("conv_id", (F.col("pos") + 1).alias("depth"), F.struct("turn").alias("turn"), "a", "b")
    return trie.join(at, ["conv_id", "depth"]).join(own, ["conv_id", "turn", "a", "b"]).drop("turn", "a", "b")
