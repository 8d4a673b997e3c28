"""The pipeline's near-duplicate stage against all pairs at five-word similarity 0.8, and its quality stage."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from askmill.llm import shingles

SMALL = "/root/testdata/sf0.01"


def shingled(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def partition(sets, least):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= least:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    texts = ["", None, "one", "One", "one two", "a b c d e f"]
    for n in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(words))
        for _ in range(5):
            edited = list(words)
            for at in rng.sample(range(len(words)), rng.randint(0, len(words) // 25)):
                edited[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(edited[: int(len(edited) * rng.choice([1, 0.85]))]))
    want = partition([shingled(t) for t in texts], shingles.SIMILARITY)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    assert len(got) == len(texts) and all(c <= i for i, c in got.items())


def test_a_passage_that_many_share_makes_few_candidates(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for _ in range(400):  # 60 shared and 20 own words: similarity 0.58, most agree in some band
        texts.append(" ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(20))]))
    for n in range(0, 400, 20):
        words = texts[n].split()
        words[rng.randrange(62, 80)] = f"x{n}"
        texts.append(" ".join(words))
    sets = [shingled(t) for t in texts]
    want = partition(sets, shingles.SIMILARITY)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values())) <= 400
    nodes = docs.select(F.col("doc_id").alias("node"), "text")
    pairs = shingles.candidates(nodes.select("node", F.col("node").alias("root")), shingles.sets_of(nodes)).collect()
    near = {(j, i) for i in range(420) for j in range(i) if similarity(sets[i], sets[j]) >= shingles.SIMILARITY}
    assert near <= {(r.a, r.b) for r in pairs} and len(pairs) <= 2 * len(near)


def test_copies_of_one_text_join_it_in_the_first_comparison(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for n in range(200):  # similarity 0.81 to 0.9 to the text, mostly below 0.8 to each other
        words = list(base)
        for at in rng.sample(range(5, 145), 3):
            words[at] = f"x{n}_{at}"
        texts.append(" ".join(words))
    left, whole = [], shingles.candidates
    monkeypatch.setattr(shingles, "candidates", lambda apart, *rest: left.append(apart.count()) or whole(apart, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    sets = [shingled(t) for t in texts]
    want = partition(sets, shingles.SIMILARITY)
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))
    assert sum(similarity(sets[0], s) >= 0.8 for s in sets) > 150 and len(left) == 1 and left[0] < 50


def test_fingerprints_near_by_anchors_are_candidates(spark):
    rng = random.Random(6)
    texts = ["", "one", "one two"]
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 400))]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join([*words, "end"])]
    sets = [shingles.shingle_set(t.encode()) for t in texts]
    bits = [shingles.set_bits(s) for s in sets]
    assert bits == [sum(1 << k for k in range(64) if 2 * sum(int(x) >> k & 1 for x in s.tolist()) > len(s)) for s in sets]
    rows = [(n, b - (1 << 64) if b >> 63 else b) for n, b in enumerate(bits)]
    near = {(i, j) for j in range(len(bits)) for i in range(j) if (bits[i] ^ bits[j]).bit_count() <= shingles.simhash.DISTANCE}
    pairs = {(r.a, r.b) for r in shingles.anchored(spark.createDataFrame(rows, "node long, bits long")).collect()}
    root = list(range(len(bits)))
    for a, b in sorted(pairs):
        root = [min(root[a], root[b]) if x in (root[a], root[b]) else x for x in root]
    assert len(near) > 20 and pairs <= near and all(root[i] == root[j] for i, j in near)


def test_stage_links_edited_copies(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 300").limit(60)
    rng, copies = random.Random(5), []
    for r in docs.collect():
        words = r.text.split(" ")
        for at in rng.sample(range(len(words)), len(words) // 60):
            words[at] = f"x{rng.randrange(10**6)}"
        copies.append((r.doc_id + 10**6, " ".join(words), r.lang, r.source, r.n_chars))
    both = docs.unionByName(spark.createDataFrame(copies, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, both, SMALL).collect()}
    own = {r.doc_id: shingled(r.text) for r in both.collect()}
    near = [i for i in own if i >= 10**6 and similarity(own[i], own[i - 10**6]) >= 0.8]
    assert len(near) > 30 and not kept & set(near)


def test_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words), (1, words), (1, words), (2, "other words " + words), (1, "a text of its own"), (3, "a text of its own")]
    rows += [(None, words), (None, "only without an id"), (None, "only without an id"), (0, None), (4, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("own")).withColumn("doc", F.lit(1))
    kept = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert kept.columns == docs.columns
    want = [(1, words), (1, "a text of its own"), (None, "only without an id"), (0, None)]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), SMALL).count() == 0


def test_quality_keeps_columns_named_like_its_own(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 200")
    docs = docs.withColumn("score", F.concat(F.lit("s"), "doc_id")).withColumn("predicted", F.col("doc_id") * 10).withColumn("doc", F.lit("d"))
    good = corpus_pipeline.quality(spark, docs, SMALL)
    assert good.schema == docs.schema
    rows = good.collect()
    assert 0 < len(rows) < 200 and all(r.score == f"s{r.doc_id}" and r.predicted == 10 * r.doc_id and r.doc == "d" for r in rows)
