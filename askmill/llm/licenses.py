"""License notices by ordered signature rules.

A text is read as its words: A-Z in lower case, runs of letters, digits and characters beyond ASCII. A rule is a
regular expression over the words joined by blanks, with a label, a priority, a weight and its keywords: words one
of which every match of the rule holds. A rule runs only on texts that hold a keyword of it, so most texts cost
one look at each word.

Rules come from hand-written tables: families of licenses with names, short names and versions, and phrases of
their texts. Each family gives a rule for each version and form: the identifier after an SPDX tag, a grant ("licensed
under the ..."), the name with its version, the address of the text, and the name without a version.

A detection is the interval of words that a rule matches. One that lies within another's interval goes if the
other's rule has the higher priority, or the same and is longer or stands first. So "gnu general public license version
2" is one detection of gpl-2.0, and a version's rule goes before its family's. The score is 1 minus the product of
(1 - weight) over the labels left, each with its greatest weight.

Null and empty texts have no words, no detection and score 0. Rows are taken each on their own, so repeated and null
ids and extra columns do not matter. An empty table gives no rows. Texts are read whole; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of words: A-Z to a-z; all other ASCII characters but digits and letters part words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

# Priorities, the first goes before the later ones.
TAG, TEXT, GRANT, NAMED, ADDRESS, FAMILY = range(6)
WEIGHTS = {TAG: 0.99, TEXT: 0.95, GRANT: 0.9, NAMED: 0.8, ADDRESS: 0.8, FAMILY: 0.6}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    keywords: tuple[str, ...]


#: label, pattern of the name, pattern of the short name, keywords, versions.
FAMILIES = [
    ("gpl", "(?:gnu )?general public licen[cs]e", "(?:gnu )?gpl", "general gpl", "1.0 2.0 3.0"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl", "general lgpl", "2.0 2.1 3.0"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl", "general agpl", "1.0 3.0"),
    ("gfdl", "(?:gnu )?free documentation licen[cs]e", "(?:gnu )?g?fdl", "documentation gfdl fdl", "1.1 1.2 1.3"),
    ("apache", "apache(?: software)? licen[cs]e", "(?:apache|asl)", "apache asl", "1.0 1.1 2.0"),
    ("mpl", "mozilla public licen[cs]e", "mpl", "mozilla mpl", "1.0 1.1 2.0"),
    ("npl", "netscape public licen[cs]e", "npl", "netscape npl", "1.0 1.1"),
    ("epl", "eclipse public licen[cs]e", "epl", "eclipse epl", "1.0 2.0"),
    ("cpl", "common public licen[cs]e", "cpl", "common cpl", "1.0"),
    ("ipl", "ibm public licen[cs]e", "ipl", "ibm ipl", "1.0"),
    ("cddl", "common development and distribution licen[cs]e", "cddl", "common cddl", "1.0 1.1"),
    ("eupl", "european union public licen[cs]e", "eupl", "european eupl", "1.0 1.1 1.2"),
    ("cecill", "cecill(?: free software)? licen[cs]e", "cecill", "cecill", "1.0 1.1 2.0 2.1"),
    ("artistic", "artistic licen[cs]e", "artistic", "artistic", "1.0 2.0"),
    ("osl", "open software licen[cs]e", "osl", "open osl", "1.0 1.1 2.0 2.1 3.0"),
    ("afl", "academic free licen[cs]e", "afl", "academic afl", "1.1 1.2 2.0 2.1 3.0"),
    ("ecl", "educational community licen[cs]e", "ecl", "educational ecl", "1.0 2.0"),
    ("zpl", "zope public licen[cs]e", "zpl", "zope zpl", "1.1 2.0 2.1"),
    ("lppl", "latex project public licen[cs]e", "lppl", "latex lppl", "1.0 1.1 1.2 1.3"),
    ("ofl", "(?:sil )?open font licen[cs]e", "ofl", "font ofl", "1.0 1.1"),
    ("php", "php licen[cs]e", "php licen[cs]e", "php", "3.0 3.01"),
    ("psf", "python software foundation licen[cs]e", "psf licen[cs]e", "python psf", "2.0"),
    ("bsl", "boost software licen[cs]e", "boost", "boost", "1.0"),
    ("upl", "universal permissive licen[cs]e", "upl", "universal upl", "1.0"),
    ("odbl", "open database licen[cs]e", "odbl", "database odbl", "1.0"),
    ("odc-by", "open data commons attribution licen[cs]e", "odc by", "commons odc", "1.0"),
    ("pddl", "open data commons public domain dedication and licen[cs]e", "pddl", "commons pddl", "1.0"),
    ("mulan-psl", "mulan permissive software licen[cs]e", "mulan psl", "mulan", "1.0 2.0"),
    ("sspl", "server side public licen[cs]e", "sspl", "server sspl", "1.0"),
    ("elastic", "elastic licen[cs]e", "elastic licen[cs]e", "elastic", "1.0 2.0"),
    ("busl", "business source licen[cs]e", "busl", "business busl", "1.0 1.1"),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", "microsoft ms", ""),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", "microsoft ms", ""),
    ("mit", "mit(?: x11| open source)? licen[cs]e", "mit", "mit", ""),
    ("x11", "x11 licen[cs]e", "x11", "x11", ""),
    ("isc", "isc licen[cs]e", "isc", "isc", ""),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "zlib", ""),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa", "ncsa", ""),
    ("postgresql", "postgresql licen[cs]e", "postgresql licen[cs]e", "postgresql", ""),
    ("ruby", "ruby licen[cs]e", "ruby licen[cs]e", "ruby", ""),
    ("openssl", "openssl licen[cs]e", "openssl licen[cs]e", "openssl", ""),
    ("vim", "vim licen[cs]e", "vim licen[cs]e", "vim", ""),
    ("w3c", "w3c software(?: notice and)? licen[cs]e", "w3c licen[cs]e", "w3c", ""),
    ("qpl", "q public licen[cs]e", "qpl", "q qpl", ""),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", "fuck wtfpl", ""),
    ("unlicense", "the unlicen[cs]e", "unlicen[cs]e", "unlicense unlicence", ""),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd 2 clause", "bsd", ""),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd 3 clause", "bsd", ""),
    ("bsd-4-clause", "(?:original|old|4 clause|four clause) bsd licen[cs]e", "bsd 4 clause", "bsd", ""),
    ("bsd", "bsd(?: style)? licen[cs]e", "bsd", "bsd", ""),
]
#: label, words of the short name, pattern of the long name; all have VERSIONS.
COMMONS = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:atives|s)?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)?"),
]
VERSIONS = "1.0 2.0 2.5 3.0 4.0"
#: label, phrase of the license's own text or dedication, keyword.
PHRASES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising"),
    ("zlib", "altered source versions must be plainly marked as such", "altered"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "redistribute"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "redistribute"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "hereby"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0-1.0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("public-domain", "(?:released|placed|dedicated|donated|is|are) (?:in|into|to|in to) the public domain", "domain"),
    ("commons-clause", "commons clause licen[cs]e condition", "clause"),
    ("all-rights-reserved", "all rights reserved", "reserved"),
]
_GRANT = "(?:(?:re)?licen[cs]ed|released|distributed|available|provided|published|covered|shared|made available|redistributed) (?:[^ ]+ ){0,3}?under(?: the)?(?: terms)?(?: and)?(?: conditions)?(?: of)?(?: the)?"
_SPDX = "spdx licen[cs]e identifier"


def _version(text: str) -> str:
    """Words that say a version: 2.0 is also written 2, v2 and version 2.0."""
    major, minor = text.split(".")
    tail = "(?: 0)?" if minor == "0" else f" {minor}"
    return f"(?: licen[cs]e)?(?: version| ver| v)? v?{major}{tail}(?: only| or later| or any later version)?"


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order: priority, then the longer pattern first."""
    made = [Rule(label, pattern, TEXT, (word,)) for label, pattern, word in PHRASES]
    for label, name, short, words, versions in FAMILIES:
        keys = tuple(words.split())
        either = f"(?:{name}|{short})"
        for v in versions.split():
            made += [
                Rule(f"{label}-{v}", f"{_SPDX} {short}{_version(v)}", TAG, ("spdx",)),
                Rule(f"{label}-{v}", f"{_GRANT} {either}{_version(v)}", GRANT, keys),
                Rule(f"{label}-{v}", f"{either}{_version(v)}", NAMED, keys),
            ]
            if v.endswith(".0"):  # in one word, as gplv3
                made.append(Rule(f"{label}-{v}", f"{label}v{v[0]}", NAMED, (f"{label}v{v[0]}",)))
        grant = f"{_GRANT} (?:{name}|{short} licen[cs]e|{short})"
        made += [Rule(label, f"{_SPDX} {short}", TAG, ("spdx",)), Rule(label, grant, GRANT, keys), Rule(label, name, FAMILY, keys)]
    for label, short, name in COMMONS:
        named = f"(?:cc {short}|creative commons {short}|(?:creative commons|cc) {name})(?: international| unported| generic)?"
        for v in VERSIONS.split():
            tail = f"(?: licen[cs]e)?(?: version| v)? v?{v.replace('.', ' ')}(?: international| unported| generic)?"
            made += [
                Rule(f"{label}-{v}", f"{_SPDX} cc {short} {v.replace('.', ' ')}", TAG, ("spdx",)),
                Rule(f"{label}-{v}", f"{_GRANT} (?:a )?{named}{tail}", GRANT, ("cc", "commons")),
                Rule(f"{label}-{v}", f"{named}{tail}", NAMED, ("cc", "commons")),
                Rule(f"{label}-{v}", f"creativecommons org licenses {short} {v.replace('.', ' ')}", ADDRESS, ("creativecommons",)),
            ]
        made += [Rule(label, f"{_GRANT} (?:a )?{named}", GRANT, ("cc", "commons")), Rule(label, named, FAMILY, ("cc", "commons"))]
    addresses = [("gpl", "gnu org licenses gpl"), ("lgpl", "gnu org licenses lgpl"), ("agpl", "gnu org licenses agpl")]
    addresses += [("apache-2.0", "apache org licenses license 2 0"), ("mpl-2.0", "mozilla org mpl 2 0"), ("mit", "opensource org licenses mit")]
    made += [Rule(label, words, ADDRESS, (words.split()[0],)) for label, words in addresses]
    return tuple(sorted(made, key=lambda r: (r.priority, -len(r.pattern))))


class Scanner:
    """Finds phrases and rules in texts."""

    def __init__(self, phrases: dict[str, str], ordered: tuple[Rule, ...]) -> None:
        self.phrases = {f" {p} ".encode(): label for p, label in phrases.items()}
        self.rules = ordered
        self.by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(ordered):
            for word in rule.keywords:
                self.by_word.setdefault(word.encode(), []).append(i)
        for phrase in self.phrases:
            self.by_word.setdefault(phrase.split()[0], [])
        self.keywords = set(self.by_word)
        self.compiled: dict[int, re.Pattern] = {}

    def _pattern(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(f" (?:{self.rules[i].pattern})(?= )".encode())
        return self.compiled[i]

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[int, int, int]]]:
        """The number of words, the phrases' labels and places, and the detections (rule, first, last word)."""
        words = text.translate(_WORDS).split()
        met = self.keywords.intersection(words)
        if not met:
            return len(words), [], []
        line = b" ".join([b"", *words, b""])
        places, found = [], []
        for phrase, label in self.phrases.items():
            if phrase.split()[0] in met:
                for first, _ in _words_at(line, _starts(line, phrase)):
                    places.append((label, first))
        for i in sorted({i for word in met for i in self.by_word[word]}):
            spans = [m.span() for m in self._pattern(i).finditer(line)]
            found += [(i, first, last) for first, last in _words_at(line, spans)]
        return len(words), places, self.resolved(found)

    def resolved(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The detections that lie within none of a rule that goes before theirs, by place.

        One pass from the left: per priority, the furthest end of what has begun.
        """
        furthest, kept = [-1] * (FAMILY + 1), []
        for i, first, last in sorted(found, key=lambda d: (d[1], -d[2], d[0])):
            priority = self.rules[i].priority
            if max(furthest[: priority + 1]) < last:
                kept.append((i, first, last))
            furthest[priority] = max(furthest[priority], last)
        return kept


def _starts(line: bytes, phrase: bytes) -> Iterator[tuple[int, int]]:
    at = line.find(phrase)
    while at >= 0:
        yield at, at + len(phrase) - 1
        at = line.find(phrase, at + 1)


def _words_at(line: bytes, spans) -> Iterator[tuple[int, int]]:
    """First and last word of each span; spans begin at the blank before a word, in order."""
    at = words = 0
    for start, end in spans:
        words += line.count(b" ", at, start)
        at = start
        yield words, words + line.count(b" ", start, end) - 1


def scanned(docs: DataFrame, phrases: dict[str, str], ordered: tuple[Rule, ...] | None = None, text: str = "text") -> DataFrame:
    """The columns of `docs` but for the text, in a struct `doc`, with what its text holds.

    n_words; `places`: label and first word of each place of a phrase; `detections`: label, rule (its number),
    first and last word, weight of what is left of the rules' matches.
    """
    ordered = ordered or rules()
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    kinds = "n_words bigint, places array<struct<label string, first bigint>>, detections array<struct<label string, rule int, first bigint, last bigint, weight double>>"
    schema = f"doc {own.schema['doc'].dataType.simpleString()}, {kinds}"
    place = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))
    detection = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, ordered)
        for batch in batches:
            counts, places, found = [], [], []
            for value in batch["text"].cast(pa.binary()).to_pylist():
                n, at, kept = scanner.scan(value or b"")
                counts.append(n)
                places.append([{"label": label, "first": first} for label, first in at])
                found.append(
                    [
                        {"label": ordered[i].label, "rule": i, "first": first, "last": last, "weight": WEIGHTS[ordered[i].priority]}
                        for i, first, last in kept
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(counts, pa.int64()), pa.array(places, place), pa.array(found, detection)],
                names=["doc", "n_words", "places", "detections"],
            )

    return own.mapInArrow(run, schema)


def score(weights: str = "detections") -> Column:
    """1 minus the product of (1 - weight) over the labels, each with its greatest weight."""
    labels = F.array_distinct(F.transform(weights, lambda d: d["label"]))
    best = lambda label: F.array_max(F.transform(F.filter(weights, lambda d: d["label"] == label), lambda d: d["weight"]))
    return 1 - F.aggregate(labels, F.lit(1.0), lambda left, label: left * (1 - best(label)))
