"""Blocks in and after elements that hold fallback content."""

from __future__ import annotations

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from askmill.llm import dom, dom_crf


@pytest.mark.parametrize("tag", ["object", "noscript", "svg", "iframe", "template", "select"])
def test_text_after_an_unclosed_element_stays(tag):
    found = dom.blocks(f"<p>before</p><{tag}><p>inside</p><p>after</p>")
    assert [b.text for b in found] == ["before", "inside", "after"] and found[-1].path[0][0] == tag


def test_fallback_content_is_left_to_the_field():
    found = dom.blocks("<object><p>one</p></object><noscript><p>two</p></noscript><p>a <math><mi>x</mi><mo>=</mo>1</math> b</p>")
    assert [b.text for b in found] == ["one", "two", "a x=1 b"]
    assert [b.path[0][0] for b in found] == ["object", "noscript", "p"]


def test_raw_text_goes_on_to_its_end():
    assert [b.text for b in dom.blocks("<svg><text>s</text></svg><template>t</template><p>a<script><p>x")] == ["a"]


HARD = {
    "tags": "<a" * 500_000,
    "quote": '<a x="y>' + "<b>t</b>" * 100_000,
    "quotes": "<a x='y\">" * 100_000,
    "open": "<div>x" * 170_000,
    "classes": "".join(f"<div class=c{i}>x" for i in range(50_000)),
    "raw": "<svg>" * 200_000,
    "ends": "<div>" * 90_000 + "</li>x" * 90_000,
    "cells": "<table><td>" + "<div>" * 80_000 + "<table><td></td>x" * 30_000,
}


@pytest.mark.parametrize("kind", sorted(HARD))
def test_malformed_megabytes_take_seconds(kind):
    weights, moves = [[0.1, 0.2]] * dom_crf.SLOTS, [[0.1, 0.0], [0.0, 0.1], [0.0, 0.0]]
    begun = time.perf_counter()
    found = dom.blocks(HARD[kind])
    assert len(dom_crf.decoded(found, weights, moves)) == len(found)
    assert time.perf_counter() - begun < 30  # some 5 s and less


@pytest.mark.parametrize("kind", ["open", "classes"])
def test_malformed_megabytes_take_little_memory(kind):
    tracemalloc.start()
    dom.blocks(HARD[kind])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_scores_along_the_path_equal_those_of_each_block():
    rng = random.Random(3)
    weights = np.random.default_rng(1).normal(size=(dom_crf.SLOTS, 2))
    for _ in range(300):
        page = "".join(rng.choice(["<div class='a b'>", "<div class=a>", "<ul>", "<li>x y", "</li>", "</ul>", "</div>", "<p>some text", "<nav id=b>z", "</nav>"]) for _ in range(30))
        found = dom.blocks(page)
        scores = dom_crf.Scores(weights.tolist())
        for block in found:
            own = scores._add(scores.of(block.node), sorted(dom_crf.text_slots(block)))
            assert np.allclose(own, weights[dom_crf.block_slots(block)].sum(axis=0))


def test_pages_that_do_not_name_their_article(spark):
    """Block F1 on pages not learnt from, with names and words that stand in no list of the module."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw, moves = dom_crf.train(pages.where("page_id % 2 = 0"))
    weights = np.frombuffer(raw, "<f4").astype(float).reshape(dom_crf.SLOTS, 2).tolist()
    right = wrong = missed = 0
    for page in pages.where("page_id % 2 = 1").collect():
        found = dom.blocks(page.html)
        kept = [b.text for b, k in zip(found, dom_crf.named_article(found), strict=True) if k]
        renamed = re.sub(r"<(/?)(?:article|main)\b[^>]*>", lambda m: "</div>" if m[1] else '<div class="qz41">', page.html)
        links = "".join(f"<li><a href='#'>{w}</a></li>" for w in "Zulo Brekt Omni Vast".split())
        noise = f"<div class='kx'><ul>{links}</ul></div><div class='wv9'><p>Zum Abo</p><p>Jetzt!</p></div>"
        made = dom.blocks(renamed.replace("<body>", "<body>" + noise, 1).replace("</body>", noise + "</body>", 1))
        states = dom_crf.decoded(made, weights, moves)
        want, got = Counter(kept), Counter(b.text for b, k in zip(made, states, strict=True) if k)
        right += sum((want & got).values())
        wrong += sum((got - want).values())
        missed += sum((want - got).values())
    f1 = 2 * right / (2 * right + wrong + missed)
    print(f"block F1 {f1:.4f}: {right} right, {wrong} wrong, {missed} missed")
    assert f1 > 0.9
