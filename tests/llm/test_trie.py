"""The prefix trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from askmill.llm import trie
from askmill.llm.queries import QUERIES, grafted

SCHEMA = "conv_id long, turn long, role string, text string, extra int"


def brute(convs):
    """{(conv_id, depth): row} of {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for path, who in members.items():
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
        bytes_ = (len(who) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] = saved.get(path[:d], 0) + bytes_
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
    out = {}
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        row = parent, len(who), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()
        assert out.setdefault((min(who), len(path)), row) is row
    return out


def rows_of(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.mark.parametrize("width, shard_rows", [(3, 4), (2, 10**6), (32, 5)])
def test_trie_equals_brute_force(spark, width, shard_rows):
    rng = random.Random(width)
    convs = {}
    for c in range(70):
        like = convs.get(rng.randrange(c), []) if c and rng.random() < 0.8 else []
        kept = like[: rng.randint(0, len(like))]
        convs[c] = [*kept, *((rng.choice("ua"), f"é{rng.randrange(3)}" * rng.randrange(3)) for _ in range(rng.randint(1, 5)))]
    convs[100] = convs[3] + [("u", "x" * (i % 4)) for i in range(60)]
    convs[101] = convs[100][:50] + [("u", "end")]
    convs |= {c: list(convs[100][:12]) for c in range(110, 125)}  # many that end at one node, over several shards
    rows = [(c, t, r, x, 1) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(trie.prefix_trie(conversations, width, shard_rows)) == brute(convs)


def test_odd_rows(spark):
    convs = {0: [("", ""), ("u", "a")], 1: [("", ""), ("u", "a")], 2: [("u", "")], 7: [("", ""), ("u", "b" * 100_000)]}
    rows = [(0, None, None, None, 1), (0, 3, "u", "a", 2), (1, 0, "", "", 3), (1, 2, "u", "a", 4), (2, -1, "u", None, 5)]
    rows += [(7, 5, "", "", 6), (7, 6, "u", "b" * 100_000, 7), (None, 1, "u", "z", 8)]
    given = spark.createDataFrame(rows, SCHEMA)
    made = trie.prefix_trie(given)
    assert rows_of(made) == brute(convs)
    texts = {(r.conv_id, r.depth): (r.role, r.text) for r in trie.node_texts(made, given).collect()}
    assert texts == {(c, d): convs[c][d - 1] for c, d in brute(convs) if d}
    assert trie.prefix_trie(given.where("false")).count() == 0
    repeated = spark.createDataFrame([(4, 1, "u", "same", 1)] * 5, SCHEMA)
    assert rows_of(trie.prefix_trie(repeated, 2, 1)) == brute({4: [("u", "same")] * 5})


def test_rebuilt_conversations(spark):
    rng = random.Random(4)
    convs = {c: [("u", f"t{rng.randrange(2)}") for _ in range(rng.randint(1, 12))] for c in rng.sample(range(60), 45)}
    rows = [(c, t, r, x, 1) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    turns = trie.placed(spark.createDataFrame(rows, SCHEMA))
    want = rebuild(convs)
    assert any(not turns for turns in want.values())
    assert rows_of(trie.nodes(*grafted(turns), 4, 9)) == brute(want)


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    convs = {}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn is not None, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert rows_of(QUERIES["op11_prefix_trie"](spark, folder)) == brute(rebuild(convs))
