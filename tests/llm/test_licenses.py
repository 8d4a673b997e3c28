"""License notices: the base against a scan word by word, the rules on written notices."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from askmill.llm import licenses
from askmill.llm.queries import LICENSE_PHRASES, QUERIES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    at = [(label, i) for p, label in LICENSE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for _, i in at), default=None), max((i for _, i in at), default=None), ",".join(sorted({x for x, _ in at}))


NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "the code is GPLv3": "gpl-3.0",
    "see https://creativecommons.org/licenses/by-sa/4.0/ for it": "cc-by-sa-4.0",
    "Creative Commons Attribution-ShareAlike 3.0 Unported": "cc-by-sa-3.0",
    "GNU Lesser General Public License v2.1": "lgpl-2.1",
    "the terms of the GNU Affero General Public License": "agpl",
    "Mozilla Public License 2.0": "mpl-2.0",
    "the new BSD licence": "bsd-3-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this": "mit",
    "We visited MIT and saw apache helicopters; cc everyone by noon": "",
    "": "",
}


def test_notices(spark):
    scanner = licenses.Scanner(LICENSE_PHRASES, licenses.rules())
    for text, label in NOTICES.items():
        *_, found = scanner.scan(text.encode())
        assert {licenses.rules()[i].label for i, *_ in found} == set(filter(None, [label])), text
    assert len(licenses.rules()) > 300 and len(set(licenses.rules())) == len(licenses.rules())


def test_every_rule_needs_its_keyword():
    """A rule's keywords gate it: whatever it matches must hold one, so no branch may lack them."""
    scanner = licenses.Scanner({}, licenses.rules())
    lines = [b" " + b" ".join(t.encode().translate(licenses._WORDS).split()) + b" " for t in NOTICES]
    for i, rule in enumerate(licenses.rules()):
        for line in lines:
            for match in scanner._pattern(i).finditer(line):
                assert {k.encode() for k in rule.keywords} & set(match.group().split()), rule


def test_containment_and_priority():
    rules = tuple(licenses.Rule(name, "x", priority, ()) for name, priority in (("tag", 0), ("named", 3), ("named2", 3), ("family", 5)))
    scanner = licenses.Scanner({}, rules)

    def brute(found):
        better = lambda a, b: rules[a[0]].priority < rules[b[0]].priority or (
            rules[a[0]].priority == rules[b[0]].priority and (a[2] - a[1] > b[2] - b[1] or (a[1:] == b[1:] and a[0] < b[0]))
        )
        return sorted(b for b in found if not any(a[1] <= b[1] and b[2] <= a[2] and better(a, b) for a in found))

    import random

    rng = random.Random(6)
    for _ in range(500):
        found = list({(rng.randrange(4), s := rng.randrange(8), s + rng.randrange(5)) for _ in range(rng.randint(0, 9))})
        assert sorted(scanner.resolved(found)) == brute(found)


def test_base_and_odd_rows(spark):
    texts = [None, "", "GNU  General-Public\nLICENSE gnu general public licenses", "cc by cc by cc by", "écc by", "mit license." * 3]
    texts += ["word " * 200_000 + "Apache License", "apache licensé", "x" * 300_000, "license mit\x7flicense 3cc by cc by"]
    rows = [(i // 2 if i % 3 else None, t, "own", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, n_words int")
    made = licenses.scanned(docs.withColumn("at", F.monotonically_increasing_id()), LICENSE_PHRASES)
    got = {r.doc.at: r for r in made.collect()}
    assert len(got) == len(texts) and all(r.doc.doc == "own" and r.doc.n_words == 7 for r in got.values())
    for r, text in zip([got[k] for k in sorted(got)], texts, strict=True):
        n, n_base, first, last, labels = base(text)
        at = [p.first for p in r.places]
        assert (r.n_words, len(at), min(at, default=None), max(at, default=None)) == (n, n_base, first, last)
        assert ",".join(sorted({p.label for p in r.places})) == labels
        assert set(filter(None, labels.split(","))) == {d.label for d in r.detections}
    assert licenses.scanned(docs.where("false"), LICENSE_PHRASES).count() == 0


def test_query_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op12_licenses"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        n, n_base, first, last, labels = base(d.text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "") and list(r.labels.split(",")) == sorted(set(r.labels.split(",")))
