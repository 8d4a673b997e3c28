"""Spelling variants by permuterm rotations.

A word with a mark at its end, `word$`, is turned: from a split of the word into x and y comes the rotation `y$x`. Where
one letter c between them is skipped, the word x c y has the rotation `y$x` c, which begins with `y$x`. So words that
differ in that letter only share this beginning, and the word x y, which lacks it, has it as a whole rotation.
Two words are near where one letter is inserted, deleted or replaced.

1. Runs of letters are counted in each task and summed by word.
2. Each word gives its rotations: whole ones, and those with the skipped letter cut off. They are sorted over the whole
   corpus by range, and each sorted range is scanned for groups that are equal. A group holds at most one whole
   rotation and one word for each letter of the alphabet, so no group grows with the corpus.
3. Neighbours come out as pairs. A letter skipped within a run of equal ones gives one shorter word; only the
   last letter of the run counts for it, so no pair comes twice.
4. A word's form is its neighbour with the most occurrences, where those are twice its own or more. Forms at least double
   in occurrences, so chains are short; roots are found by pointer doubling.

Words longer than `LONG` letters have rotations too large to write, as many as letters: theirs are hashed from the
hashes of x and y, and the neighbours found are checked letter by letter.

Null and empty texts have no words. Rows count each on their own, with repeated ids too; a null id is written as
nothing. Very long texts are counted whole; words near to none have no form and are their own root. An empty table gives
no rows, extra columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.frames import stored
from askmill.llm.wordhash import mix

LEAST_LENGTH = 5
LEAST_COUNT = 3
RATIO = 2
LONG = 64
#: Words that a task holds before it hands on their counts.
HELD = 300_000
ROUNDS = 64

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def counted(docs: DataFrame, slips: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the runs of letters of docs(doc_id, text), A-Z in lower case, that are long and frequent enough.

    With `slips`, a document's word whose unsigned crc32 of `doc_id:word` divides by it is taken to be written without
    its letter at that number modulo its length.
    """
    run_of = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if not text:
                    continue
                own = Counter(run_of.findall(text.translate(_LOWER).decode()))
                if slips:
                    start = zlib.crc32(b":" if doc_id is None else f"{doc_id}:".encode())
                    for word in [w for w in own if not zlib.crc32(w.encode(), start) % slips]:
                        n, at = own.pop(word), zlib.crc32(word.encode(), start) % len(word)
                        if len(word) > least_length:
                            held[word[:at] + word[at + 1 :]] += n
                held.update(own)
                if len(held) > HELD:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(sums, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def rotations(words: DataFrame) -> DataFrame:
    """key, word, n, whole, counts: every rotation of words(word, n), whole or without a letter skipped before it.

    `counts` is false where the same shorter word comes from a later letter.
    """
    letters = F.length("word")
    left, right = F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 1, letters)
    whole = words.select("word", "n", F.explode(F.sequence(F.lit(0), letters)).alias("at"))
    whole = whole.select(F.concat(right, F.lit("$"), left).alias("key"), "word", "n", F.lit(True).alias("whole"), F.lit(True).alias("counts"))
    rest = F.substring(F.col("word"), F.col("at") + 2, letters)
    differs = F.substring(F.col("word"), F.col("at") + 1, F.lit(1)) != F.substring(F.col("word"), F.col("at") + 2, F.lit(1))
    cut = words.where("word != ''").select("word", "n", F.explode(F.sequence(F.lit(0), letters - 1)).alias("at"))
    cut = cut.select(F.concat(rest, F.lit("$"), left).alias("key"), "word", "n", F.lit(False).alias("whole"), differs.alias("counts"))
    return whole.unionByName(cut)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, near, near_n of each group of equal keys; the last group of a batch goes on into the next."""
    open_ = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if open_ is None else pa.concat_tables([open_, pa.Table.from_batches([batch])]).combine_chunks()
        keys = rows["key"].combine_chunks()
        new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        open_ = rows.slice(int(starts[-1]))
        yield from _near(rows, starts)
    if open_ is not None:
        yield from _near(open_, np.array([0, open_.num_rows]))


def _near(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pairs within the groups that begin at `starts`, the last of which is where they end."""
    sizes = np.diff(starts)
    size = np.repeat(sizes, sizes)
    first = np.repeat(starts[:-1], sizes)
    one = np.repeat(np.arange(starts[-1]), size)
    place = np.arange(len(one)) - np.repeat(np.cumsum(size) - size, size)
    two = np.repeat(first, size) + place
    whole, counts = (rows[c].to_numpy()[: starts[-1]] for c in ("whole", "counts"))
    kept = (one != two) & (~whole[one] | counts[two]) & (~whole[two] | counts[one])
    one, two = one[kept], two[kept]
    for at in range(0, len(one), 50_000):
        a, b = pa.array(one[at : at + 50_000]), pa.array(two[at : at + 50_000])
        made = [rows["word"].take(a), rows["word"].take(b), rows["n"].take(b)]
        yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in made], names=["word", "near", "near_n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, id, whole: rotations of long words as hashes of what stands left and right of the split."""
    base = 0x9E3779B97F4A7C15
    for batch in batches:
        for word, own in zip(batch["word"].to_pylist(), batch["id"].to_pylist(), strict=True):
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            n = len(codes)
            with np.errstate(over="ignore"):
                power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])
                # left[i] hashes the first i letters; right[i] those from i on, by their places within themselves
                left = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes) * power[:n])])
                ends = np.concatenate([[np.uint64(0)], np.cumsum((mix(codes) * power[:n][::-1])[::-1])])[::-1]
                for whole, right in ((True, ends), (False, ends[1:])):
                    x = left[: len(right)]
                    key = mix(mix(x) + right + np.arange(len(right), dtype=np.uint64))
                    for at in range(0, len(key), 100_000):
                        some = key[at : at + 100_000].view(np.int64)
                        columns = [pa.array(some), pa.array(np.full(len(some), own)), pa.array(np.full(len(some), whole))]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "whole"])


def _long_neighbours(words: DataFrame, others: DataFrame) -> DataFrame:
    """word, near, near_n for words longer than LONG, and those of `others` that are one letter shorter."""
    named = stored(words.unionByName(others.where(F.length("word") == LONG)).withColumn("id", F.xxhash64("word")), "long-words")
    keys = stored(named.select("id", "word").mapInArrow(_hashed, "key bigint, id bigint, whole boolean"), "long-rotations")
    one, two = keys.toDF("key", "a", "a_whole"), keys.toDF("key", "b", "b_whole")
    met = one.join(two, "key").where("a != b AND NOT (a_whole AND b_whole)").select("a", "b").distinct()
    ends = met.join(named.select(F.col("id").alias("a"), "word"), "a").join(named.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    longer = F.greatest(F.length("word"), F.length("near")) > LONG
    return ends.where(longer & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, near_n: both ways, each pair of words(word, n) that differ by one letter."""
    plain = words.where(F.length("word") <= LONG)
    dealt = rotations(plain).repartitionByRange("key").sortWithinPartitions("key")
    pairs = dealt.mapInArrow(_pairs, "word string, near string, near_n bigint")
    long_ = words.where(F.length("word") > LONG)
    return pairs.unionByName(_long_neighbours(long_, plain))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms(word, form): the last word that forms lead to, by pointer doubling."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(ROUNDS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        longer = stored(longer, "roots")
        steps = longer.drop("moved")
        if not longer.where("moved").head(1):
            return steps
    raise RuntimeError(f"forms did not settle in {ROUNDS} rounds")


def grouped(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words(word, n)."""
    words = stored(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rated = words.join(near, "word", "left")
    reached = -F.col("best.less") >= F.col("n") * ratio
    rated = rated.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(reached, F.col("best.form")).alias("form"),
        F.when(reached, -F.col("best.less")).alias("form_n"),
    )
    rated = stored(rated, "near")
    ends = roots(rated.where("form IS NOT NULL").select("word", "form"))
    out = rated.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
