"""The methods against brute force, and the pipeline's stages."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from test_shingles import partition, shingled

from askmill.llm import collisions, dom, hilbert, imatch, mixing, packing, simhash, token_files
from askmill.llm.graph import components, forest
from askmill.llm.wordhash import all_word_hashes, word_hashes

SMALL = "/root/testdata/sf0.01"


def groups(n, links):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        return a

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(a) for a in range(n)]


def test_knapsack_is_the_best_sum():
    rng = random.Random(1)
    for _ in range(100):
        lengths = sorted(rng.sample(range(1, 30), rng.randint(1, 6)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, 80)
        take = mixing.knapsack(lengths, counts, budget)
        sums = (sum(a * b for a, b in zip(lengths, k, strict=True)) for k in itertools.product(*(range(c + 1) for c in counts)))
        assert all(t <= c for t, c in zip(take, counts, strict=True))
        assert sum(a * b for a, b in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)


def test_fit_meets_large_budgets_to_the_word():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 3000)
    counts = rng.integers(1, 50, len(lengths))
    total = int((lengths * counts).sum())
    for share in (0.01, 0.3, 0.77, 0.999):
        take = mixing.fit(lengths, counts, int(total * share))
        assert (take <= counts).all() and int((take * lengths).sum()) == int(total * share)


def test_targets_share_out_what_is_cut_off():
    assert mixing.targets([100, 10, 50], [3, 1, 2], 240) == pytest.approx([132.0, 20.0, 88.0])
    assert sum(mixing.targets([5, 0, 5], [3, 1, 2], 15)) == pytest.approx(15)


def test_curve_visits_every_cell_by_single_steps():
    for bits, n in ((2, 2), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        place = hilbert.curve_index(list(cells.T), bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_differencing_fills_windows():
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 512, rng.integers(1, 200))
        sets = packing.balanced(sizes, 2048)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes)))
        assert max(sizes[s].sum() for s in sets) <= 2048


def test_perfect_hash_is_minimal_and_round_trips():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        made = token_files.PerfectHash.of(keys)
        data = made.dump()
        again, end = token_files.PerfectHash.load(memoryview(data))
        assert end == len(data) and sorted(again.slots(keys).tolist()) == list(range(len(keys)))


def test_word_hashes_tell_words_apart_and_texts_alike():
    texts = [b"a b  c\nA", b"", b"  x ", b"one two", b"\n", b"two\x0bone"] * 3
    single = [word_hashes(np.frombuffer(t, np.uint8)) for t in texts]
    joint = np.concatenate([h for _, h, _ in all_word_hashes(texts)])
    assert (joint == np.concatenate(single)).all()
    words = [w.lower() for t in texts for w in t.split()]
    assert len(set(joint.tolist())) == len(set(words))


def test_imatch_likeness():
    kept = np.ones(imatch.SLOTS, bool)
    alike, far = [], []
    for n in range(30):
        text = " ".join(f"w{n}_{i}" for i in range(300))
        half = " ".join([*(f"w{n}_{i}" for i in range(150)), *(f"v{n}_{i}" for i in range(150))])
        marks = imatch.fingerprints([t.encode() for t in (text, text, half, f"other words here {n}", "")], kept)
        same, some, none, empty, void = imatch.likeness(marks[[0, 0, 0, 4, 4]], marks[[1, 2, 3, 4, 0]])
        assert same == 1 and empty == 1 and void == 0
        alike.append(some)
        far.append(none)
    assert 0.15 < np.mean(alike) < 0.5 and np.mean(far) < 0.02


def test_anchors_meet_within_the_threshold():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**63, 3000).astype(np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            two[i] ^= np.uint64(1 << int(bit))
    own = [set() for _ in one]
    for i, k in zip(*(x.tolist() for x in simhash.replicas(one)), strict=True):
        own[i].add(k)
    met = np.zeros(len(two), bool)
    for i, k in zip(*(x.tolist() for x in simhash.replicas(two)), strict=True):
        met[i] |= k in own[i]
    assert met.all()


@pytest.mark.parametrize("cell", [simhash.CELL, 4])
def test_simhash_links_equal_brute_force(spark, cell):
    rng = np.random.default_rng(5)
    seeds = rng.integers(-(2**63), 2**63 - 1, 40)
    bits = set(seeds.tolist())
    for s in seeds[:12].tolist():
        for _ in range(25):
            other = s
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                other ^= 1 << int(bit)
            bits.add(int(np.uint64(other % 2**64).astype(np.int64)))
    bits = sorted(bits)
    unsigned = np.array(bits, np.int64).view(np.uint64)
    pairs = [(i, j) for i in range(len(bits)) for j in range(i) if np.bitwise_count(unsigned[i] ^ unsigned[j]) <= 4]
    want = groups(len(bits), pairs)
    nodes = spark.createDataFrame([(b,) for b in bits], "bits long")
    at = {b: i for i, b in enumerate(bits)}
    got = groups(len(bits), [(at[r.a], at[r.b]) for r in simhash.links(nodes, cell=cell).collect()])
    assert Counter(zip(want, got, strict=True)).keys() >= set() and len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rows = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    roots = {r.node: r.root for r in rows}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in range(100, 140)} == {100}
    assert roots[201] == roots[200] == 200 and len(rows) == len(roots)


@pytest.mark.parametrize("cell", [collisions.CELL, 8])
def test_collisions_find_pairs_at_the_threshold(spark, cell):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.standard_normal(base.shape)
    turn -= (turn * base).sum(axis=1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    other = 0.951 * base + np.sqrt(1 - 0.951**2) * turn
    crowd = base[0] + 0.02 * rng.standard_normal((40, 64))
    all_ = np.concatenate([base, other, crowd])
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "node long, embedding array<double>")
    least = collisions.calibrated(all_)
    found = collisions.verified(collisions.candidates(nodes, least, cell=cell), nodes).collect()
    unit = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))}
    got = [(r.a, r.b) for r in found]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.97 * len(want)


def test_blocks_of_malformed_pages():
    assert [b.text for b in dom.blocks("<p>a<b>b</b> c<br>d<p>e &lt;x&gt;</div>f<script>g</script><li>h<li>i")] == ["ab c d", "e <x>", "f", "h", "i"]
    for page in ("", "<", "<p a='x>y", "<!-- x", "<script>a", "</", "<a <b> c"):
        dom.blocks(page)


def test_quality_and_extraction_on_held_out_rows(spark):
    from askmill.llm.queries import QUERIES

    rows = QUERIES["op8_nbsvm"](spark, SMALL).where("held_out")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    right = rows.join(labels, "doc_id").selectExpr("avg(cast(predicted = quality as double))").first()[0]
    assert right >= 0.95
    page = spark.read.parquet(f"{SMALL}/pages.parquet").where("page_id = 1")
    text = QUERIES["op7_dom_crf"](spark, SMALL).where("page_id = 1").first().text
    body = page.first().html.partition("<article>")[2].partition("</article>")[0]
    assert text == "\n".join(b.text for b in dom.blocks(body))


def test_pipeline_stages_keep_their_promises(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL)
        made.append((name, before, docs))
    good, single, mixed, packed = (d for _, _, d in made)
    for _, before, after in made[:-1]:
        assert after.columns == before.columns
    assert good.count() < made[0][1].count()
    rows = sorted(good.select("doc_id", "text").collect())
    sets = [shingled(r.text) for r in rows]
    least = {}
    for row, root in zip(rows, partition(sets, 0.8), strict=True):
        least[root] = min(row.doc_id, least.get(root, 10**9))
    assert sorted(r.doc_id for r in single.collect()) == sorted(least.values())
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 2 and set(times) <= set(least.values())
    whole = Counter()
    for r in packed.collect():
        whole[r.doc_id] += r.length / r.doc_tokens
    assert {k: round(v) for k, v in whole.items()} == dict(times)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(8)
    for _ in range(50):
        a, b = rng.integers(0, 60, (2, rng.integers(1, 80)))
        nodes, roots = forest(a, b)
        assert len(nodes) == len(set(nodes.tolist()))
        want = groups(60, zip(a.tolist(), b.tolist(), strict=True))
        got = groups(60, zip(nodes.tolist(), roots.tolist(), strict=True))
        assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
