"""Near duplicates by the Jaccard similarity of word shingles, found by SimHash and min-wise hashing and checked exactly.

A text is the set of its shingles: runs of `SHINGLE` words with A-Z in lower case, all its words where it
has fewer. Two texts link where the sets' Jaccard similarity is `SIMILARITY` or more.

Candidates come from two keys. The SimHash fingerprints of the sets are linked by anchors (`simhash`), which
finds texts that are nearly equal. At similarity 0.8 fingerprints of 64 bits differ in about 10 bits and often in
17, far beyond what anchors cover, so texts that agree in one of `BANDS` bands are candidates too, each band the
smallest values of `ROWS` seeded hashes. Two texts of similarity s agree in a band with probability s ** ROWS, so
of pairs at 0.8 one in 2,800 is missed, of pairs at 0.85 one in 37,000. Candidates are compared by their whole
sets, so no link is false.

Equal sets are one node, so copies cost nothing. Texts that share a band are first compared with its `PIVOTS`
nodes that meet most others in all their bands, and what links becomes one component. Edited copies of one
text are often nearer to it than to each other, and it is such a node. So a group of near copies costs a few
comparisons for each of them, not all its pairs. Texts that many others share a passage with agree in bands and
yet do not link. So what is left, bands of more than one component, is joined by rare shingles: of two sets
that reach the similarity, the rarest shingles of the smaller, a ninth of them and one more, and of the larger, a
fifth and one more, have one in common. What all share is among nobody's rarest. Only texts in a shared band
or near by their fingerprints have their sets kept.

Nulls, empty and repeated rows: a null or empty text has the empty set, like only to itself. A null
`doc_id` never names a component unless all its documents have none. Rows of one `doc_id` count each on
their own. An empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm import simhash
from askmill.llm.frames import stored
from askmill.llm.graph import components
from askmill.llm.wordhash import mix, raw_texts, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
SEED = 42
#: Nodes of a band that all others in it are compared with first.
PIVOTS = 3
#: Shingles whose hashes are made in one go.
STRIDE = 1 << 9

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) + np.uint64(SEED << 32))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = word_hashes(np.frombuffer(text, np.uint8))
    if not len(words):
        return words
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(out)


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: what is equal there for two sets whose smallest hashes agree."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for start in range(0, len(shingles), STRIDE):
            hashed = _SEEDS[:, None] ^ shingles[start : start + STRIDE]
            hashed *= np.uint64(0xBF58476D1CE4E5B9)
            hashed ^= hashed >> np.uint64(32)
            hashed *= np.uint64(0x94D049BB133111EB)
            least = np.minimum(least, hashed.min(axis=1))
        key = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def set_bits(shingles: np.ndarray) -> int:
    """The set's SimHash fingerprint: the bits that over half of the shingles' hashes have, zero for no shingles."""
    count = np.zeros(64, np.int64)
    for start in range(0, len(shingles), STRIDE):
        own = np.unpackbits(shingles[start : start + STRIDE].view(np.uint8), bitorder="little")
        count += own.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(shingles), bitorder="little").view("<u8")[0])


def marked(docs: DataFrame) -> DataFrame:
    """The columns of `docs` but for the text, and of the set node, size, bits, bands: digest, length, fingerprint, band keys."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "node bigint, size bigint, bits bigint, bands array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bits, keys = [], [], [], [np.zeros(0, np.uint64)]
            for text in raw_texts(batch["text"]):
                own = shingle_set(text)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                bits.append(set_bits(own))
                keys.append(bands(own))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[f.name] for f in kept),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(bits, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(keys).view(np.int64))),
                ],
                names=[*(f.name for f in kept), "node", "size", "bits", "bands"],
            )

    return docs.mapInArrow(run, schema)


def sets_of(texts: DataFrame) -> DataFrame:
    """node, shingles: the sets of texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, nodes = raw_texts(batch["text"]), batch["node"]
            for start in range(0, len(texts), 512):
                sets = [shingle_set(t) for t in texts[start : start + 512]]
                ends = np.cumsum([0, *(len(s) for s in sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([nodes.slice(start, 512), lists], names=["node", "shingles"])

    return texts.mapInArrow(run, "node bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs a, b whose sets reach the similarity. Sets are compared row by row, without Python."""
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    common, sizes = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return both.where(common / (sizes - common) >= similarity).select("a", "b")


def anchored(nodes: DataFrame) -> DataFrame:
    """a, b: pairs that connect the nodes(node, bits) whose fingerprints are within the distance of `simhash`."""
    firsts = stored(nodes.groupBy("bits").agg(F.min("node").alias("first")), "fingerprints")
    equal = nodes.join(firsts, "bits").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = simhash.links(firsts.select("bits")).toDF("x", "y").distinct()
    near = met.join(firsts.toDF("x", "a"), "x").join(firsts.toDF("y", "b"), "y").where("a != b")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: links that connect all candidates among nodes(node, row, size, bits, bands) that reach the similarity.

    texts(row, text) has a node's text in its row.
    """
    placed = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(placed.join(shared, "key"), "bands")
    by_bits = stored(anchored(nodes.select("node", "bits")), "anchored")
    ends = by_bits.select(F.explode(F.array("a", "b")).alias("node"))
    wanted = nodes.select("node", "row").join(met.select("node").unionByName(ends).distinct(), "node", "left_semi")
    sets = stored(sets_of(texts.join(wanted, "row").select("node", "text")), "sets")

    weights = met.groupBy("node").agg(F.sum("n").alias("weight"))
    most = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    pivots = met.join(weights, "node").withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= PIVOTS)
    pivots = pivots.select("key", F.col("node").alias("pivot"), F.col("size").alias("pivot_size"))
    fits = F.least("size", "pivot_size") >= F.greatest("size", "pivot_size") * (similarity - 1e-9)
    by_bands = met.join(pivots, "key").where((F.col("node") != F.col("pivot")) & fits)
    by_bands = by_bands.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    pairs = stored(by_bands.unionByName(by_bits).distinct(), "pairs")
    found = stored(verified(pairs, sets, similarity), "links")

    # What is left: nodes of a band that are not in one component yet.
    roots = components(found, "a", "b")
    rooted = met.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    apart = stored(rooted.join(mixed, "key", "left_semi").select("node", "root").distinct(), "apart")
    more = candidates(apart, sets, similarity).join(pairs, ["a", "b"], "left_anti")
    return found.unionByName(stored(verified(more, sets, similarity), "more-links"))


def candidates(apart: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b: every pair of apart(node, root) with different roots whose sets can reach the similarity.

    A set of n is sorted by how many of these nodes hold a shingle, rarest first. Sets of n <= m that reach the
    similarity s have at least s / (1 + s) * (n + m) shingles in common, and all of them stand at or behind the
    first common one in both. So it is among the first n - ceil(2 s / (1 + s) * n) + 1 of the smaller set and the
    first m - ceil(s * m) + 1 of the larger. Nodes under one root that hold a shingle at the same place
    in sets of one size meet others as one, so that large groups are compared by their few sizes and places.
    """
    own = sets.join(apart, "node")
    each = own.select("node", F.explode("shingles").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    # a shingle that no other node holds comes first and joins nothing, so only their number is kept
    shared = each.join(held, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("shared"))
    sized = own.select("node", "root", F.size("shingles").alias("n")).join(shared, "node")
    ranked = sized.withColumn("single", F.col("n") - F.size("shared"))
    prefix = lambda least: (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    ranked = ranked.withColumn("prefix", prefix(similarity) - F.col("single"))
    rarest = ranked.where("prefix > 0").select("node", "root", "n", "single", F.posexplode(F.slice("shared", F.lit(1), F.col("prefix"))).alias("at", "it"))
    entries = stored(rarest.select("node", "root", "n", (F.col("single") + F.col("at")).alias("at"), F.col("it.shingle").alias("shingle")), "rarest")
    common = similarity / (1 + similarity)
    places = stored(entries.select("shingle", "root", "n", "at").distinct(), "places")
    smaller = places.where(F.col("at") < prefix(2 * common)).toDF("shingle", "r", "n", "i")
    larger = places.toDF("shingle", "s", "m", "j")
    enough = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= (F.col("n") + F.col("m")) * common - 1e-9
    in_turn = F.expr("n < m AND r != s OR n = m AND r < s") & (F.col("n") >= F.col("m") * similarity - 1e-9)
    met = smaller.join(larger, "shingle").where(in_turn & enough)
    both = met.join(entries.toDF("a", "r", "n", "i", "shingle"), ["shingle", "r", "n", "i"])
    both = both.join(entries.toDF("b", "s", "m", "j", "shingle"), ["shingle", "s", "m", "j"])
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links lead to from it, itself included."""
    numbered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row"))
    return grouped(stored(numbered, "texts"), similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def grouped(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, and first: the smallest (doc_id, row) of the component, null ids last.

    docs(row, doc_id, text) is a stored table; `row` tells its rows apart.
    """
    rows = stored(marked(docs.select("row", "doc_id", "text")), "marks")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = rows.groupBy("node").agg(F.min(key).alias("first"), *(F.any_value(c).alias(c) for c in ("size", "bits", "bands")))
    nodes = stored(nodes, "nodes")
    found = links(nodes.withColumn("row", F.col("first.row")), docs.select("row", "text"), similarity)
    roots = components(found, "a", "b")
    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = named.groupBy("root").agg(F.min("first").alias("first"))
    names = stored(named.select("node", "root").join(firsts, "root").select("node", "first"), "components")
    return rows.join(names, "node").select("row", "doc_id", "first")
