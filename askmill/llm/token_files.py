"""Token ids in binary shard files with a minimal perfect hash index over document keys.

Shard file: the ids of its documents in a row, as little-endian unsigned integers of 2 bytes (4 where the
vocabulary needs them); then the place in ids where each document begins, and one more for the end, as
8 bytes each; then a trailer with a magic word, the number of documents and the width of an id. Documents
stand in ascending `doc_id` order over all shards.

Index file: one for each bucket of keys. A minimal perfect hash of levels: on each level every key still
open hashes to one bit of a bit array, keys alone on their bit are settled, the others go on to the next
level. The rank of its bit is a key's slot. A slot holds the key's fingerprint, the shard and place of its
first document, and the shard of its last one and the place after that. A lookup reads one bucket's file, tests a bit or two, compares the
fingerprint and has the offsets: constant time, with no key stored.

A task writes to a name of its own and only then reports it, and only reported files are read: a task
that is tried again, or twice at once, does no harm. Files go to the folder of `spark.checkpoint.dir` or one
that the caller names, through the file systems that Arrow knows (local and shared folders, HDFS, S3, GCS).

Nulls, empty and repeated rows: a null text is empty and still has its end id; a null `doc_id` is a key
of its own, first in order, in a bucket of its own. Rows of one `doc_id` stand in a row, however many shards
that takes; their order is that of the rows read, and in a shard that of their texts' hashes. An empty table gives no files and no rows. Other columns are not stored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.llm.frames import running_totals, stored
from askmill.llm.wordids import word_ids
from askmill.session import shared_folder

MAGIC = b"ASKMIDS1"
#: Keys of one index file, about.
BUCKET_KEYS = 50_000
#: Documents of one key that are read in a run.
READ_ROWS = 1024
#: Bits for each open key on a level, and levels before what is left is listed.
GAMMA, LEVELS = 2, 40
_TRAILER = "<8sQQ"
_ENTRY = np.dtype([("fingerprint", "<u4"), ("shard", "<i4"), ("first", "<i8"), ("last", "<i4"), ("end", "<i8")])


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit keys, well mixed; another salt, another hash."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Maps each of a set of distinct 64-bit keys to its own slot below their number."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray) -> None:
        self.levels, self.rest = levels, rest
        self.ranks, settled = [], 0
        for bits in levels:
            ranks = np.cumsum(bits, dtype=np.int64) - bits + settled
            settled += int(bits.sum())
            self.ranks.append(ranks)
        self.size = settled + len(rest)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys.astype(np.uint64))
        while len(left) and len(levels) < LEVELS:
            width = max(64, GAMMA * len(left))
            at = mixed(left, len(levels)) % np.uint64(width)
            alone = np.bincount(at.astype(np.int64), minlength=width) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; for a key not in the set any slot, or -1."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at].astype(bool)
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[at] == keys[open_]
            out[open_[hit]] = self.size - len(self.rest) + at[hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(len(b) for b in self.levels), len(self.rest)], "<u8")
        return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in self.levels), self.rest.astype("<u8").tobytes()])

    @classmethod
    def load(cls, data: memoryview) -> tuple[PerfectHash, int]:
        """The hash, and where its bytes end."""
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes = np.frombuffer(data, "<u8", n + 1, 8).astype(int).tolist()
        at, levels = 8 * (n + 2), []
        for size in sizes[:-1]:
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
            levels.append(np.unpackbits(packed, count=size))
            at += len(packed)
        rest = np.frombuffer(data, "<u8", sizes[-1], at).astype(np.uint64)
        return cls(levels, rest), at + 8 * sizes[-1]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _new_file(folder: str, name: str) -> tuple[str, pa.NativeFile]:
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    system, at = _open(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return path, system.open_output_stream(at)


class ShardFile:
    """One shard's documents by their number in it."""

    def __init__(self, path: str) -> None:
        system, at = _open(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        tail = struct.calcsize(_TRAILER)
        magic, rows, width = struct.unpack(_TRAILER, self.file.read_at(tail, size - tail))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard file")
        self.kind = np.dtype(f"<u{width}")
        where = size - tail - 8 * (rows + 1)
        self.starts = np.frombuffer(self.file.read_at(8 * (rows + 1), where), "<u8").astype(np.int64)

    def ids(self, row: int) -> np.ndarray:
        start, end = self.starts[row : row + 2].tolist()
        width = self.kind.itemsize
        return np.frombuffer(self.file.read_at((end - start) * width, start * width), self.kind)


@dataclass
class TokenFiles:
    """What has been written: shards(shard, file, rows, ids, start) and index(bucket, file), as tables."""

    shards: DataFrame
    index: DataFrame
    buckets: int


def key_hash(doc_id: Column) -> Column:
    """A 64-bit hash, one-to-one on numbers; null stays null."""
    return F.when(doc_id.isNotNull(), F.xxhash64(doc_id.cast("long")))


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> TokenFiles:
    """Encodes the documents, writes the shard files, and then the index files."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = word_ids(tokenizer), TaskContext.get().partitionId()
        end = np.asarray([end_id], encoder.width).tobytes()
        path, out, starts = None, None, [0]
        for batch in batches:
            for keys, texts in zip(batched(batch["key"].to_pylist(), 512), batched(batch["text"], 512), strict=True):
                if out is None:
                    path, out = _new_file(folder, f"shard-{number:05d}")
                first = len(starts) - 1
                for own in encoder.encode([t.as_py() for t in texts]):
                    out.write(own + end)
                    starts.append(starts[-1] + len(own) // encoder.width.itemsize + 1)
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(keys, pa.int64()), "shard": pa.array([number] * len(keys), pa.int32()), "row": pa.array(range(first, first + len(keys)), pa.int64()), "file": pa.nulls(len(keys), pa.string()), "ids": pa.nulls(len(keys), pa.int64())}
                )
        if out is not None:
            out.write(np.asarray(starts, "<u8").tobytes() + struct.pack(_TRAILER, MAGIC, len(starts) - 1, encoder.width.itemsize))
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"key": pa.nulls(1, pa.int64()), "shard": pa.array([number], pa.int32()), "row": pa.array([len(starts) - 1], pa.int64()), "file": [path], "ids": pa.array([starts[-1]], pa.int64())}
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    # the row's number parts rows of one key; bounds of these two are sampled without reading texts
    rows = rows.repartitionByRange(order[0], F.monotonically_increasing_id()).sortWithinPartitions(*order)
    written = stored(
        rows.select(key_hash(F.col("doc_id")).alias("key"), "text").mapInArrow(
            shard, "key bigint, shard int, row bigint, file string, ids bigint"
        ),
        "documents",
    )
    files = written.where("file is not null").select("shard", "file", F.col("row").alias("rows"), "ids")
    shards = stored(running_totals(files, ["shard"], "ids", "start"), "shards")
    entries = (
        written.where("file is null")
        .groupBy("key", "shard")
        .agg(F.min("row").alias("first"), F.max("row").alias("end"))
        .groupBy("key")
        .agg(F.min(F.struct("shard", "first")).alias("from"), F.max(F.struct("shard", "end")).alias("to"))
        .select("key", "from.shard", "from.first", F.col("to.shard").alias("last"), (F.col("to.end") + 1).alias("end"))
    )
    entries = stored(entries, "entries")
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))

    def build(rows: pa.Table) -> pa.Table:
        keys = _numbers(rows["key"])
        hash_ = PerfectHash.of(keys)
        slots = np.zeros(hash_.size, _ENTRY)
        at = hash_.slots(keys)
        slots["fingerprint"][at] = fingerprints(keys)
        for name in ("shard", "first", "last", "end"):
            slots[name][at] = rows[name].to_numpy()
        bucket = rows["bucket"][0].as_py()
        path, out = _new_file(folder, f"index-{bucket:05d}")
        out.write(hash_.dump() + slots.tobytes())
        out.close()
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "file": [path]})

    bucketed = entries.withColumn("bucket", _bucket(F.col("key"), buckets))
    index = stored(bucketed.groupBy("bucket").applyInArrow(build, "bucket bigint, file string"), "index")
    return TokenFiles(shards, index, buckets)


def _bucket(key: Column, buckets: int) -> Column:
    """A bucket from 0; null's is the one after."""
    return F.when(key.isNull(), F.lit(buckets).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets).cast("long")))


def _numbers(keys: pa.ChunkedArray) -> np.ndarray:
    """Keys of one bucket; null's has no other."""
    return keys.fill_null(0).to_numpy().view(np.uint64)


def lookup(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """keys(doc_id) with shard, first, last and end through the index; keys that are in no file are left out."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, hash_, slots = None, None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for file in rows["index_file"].unique().to_pylist():
                some = rows.filter(pa.compute.equal(rows["index_file"], file))
                if path != file:
                    system, at = _open(file)
                    with system.open_input_stream(at) as source:
                        data = memoryview(source.read())
                    hash_, end = PerfectHash.load(data)
                    slots, path = np.frombuffer(data, _ENTRY, hash_.size, end), file
                key = _numbers(some["key"])
                at = hash_.slots(key)
                known = at >= 0
                known[known] = slots["fingerprint"][at[known]] == fingerprints(key[known])
                found = slots[at[known]]
                out = some.filter(pa.array(known)).select(["doc_id"])
                for name in ("shard", "first", "last", "end"):
                    out = out.append_column(name, pa.array(found[name]))
                yield from out.to_batches()

    hashed = keys.select(F.col("doc_id").cast("long")).withColumn("key", key_hash(F.col("doc_id")))
    hashed = hashed.withColumn("bucket", _bucket(F.col("key"), files.buckets))
    located = hashed.join(files.index.withColumnRenamed("file", "index_file"), "bucket")
    located = located.repartition("bucket").sortWithinPartitions("bucket")
    return located.select("doc_id", "key", "index_file").mapInArrow(
        probe, "doc_id bigint, shard int, first bigint, last int, end bigint"
    )


def read(files: TokenFiles, found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of looked-up documents.

    start counts the ids of all documents before it.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard = None, None
        for batch in batches:
            for some in batched(batch.to_pylist(), 256):
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
                for r in some:
                    if r["file"] != path:
                        path, shard = r["file"], ShardFile(r["file"])
                    for row in range(r["first"], r["end"]):
                        ids = shard.ids(row)
                        for name, value in zip(out, (r["doc_id"], r["start"] + int(shard.starts[row]), len(ids), ids.astype("<u4").tobytes()), strict=True):
                            out[name].append(value)
                kinds = {"ids": pa.binary()}
                yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()})

    # a row for each shard that holds some of a key's documents, in runs that one task reads
    here = found.select("doc_id", F.posexplode(F.sequence("shard", "last")).alias("nth", "shard"), "first", "last", "end")
    here = here.join(files.shards.select("shard", "file", "start", F.col("rows").alias("n")), "shard")
    first = F.when(F.col("nth") == 0, F.col("first")).otherwise(F.lit(0).cast("long"))
    end = F.when(F.col("shard") == F.col("last"), F.col("end")).otherwise(F.col("n"))
    here = here.select("doc_id", "shard", "file", "start", first.alias("first"), end.alias("end")).withColumn(
        "first", F.explode(F.sequence("first", F.col("end") - 1, F.lit(READ_ROWS).cast("long")))
    )
    placed = here.withColumn("end", F.least(F.col("end"), F.col("first") + READ_ROWS))
    placed = placed.repartitionByRange("shard", "first").sortWithinPartitions("shard", "first")
    return placed.select("doc_id", "file", "first", "end", "start").mapInArrow(
        load, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the documents and reads every one back through the index."""
    files = write(docs, tokenizer, end_id)
    return read(files, lookup(files, docs.select(F.col("doc_id").cast("long")).distinct()))
