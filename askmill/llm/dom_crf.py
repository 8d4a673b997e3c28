"""Main text of web pages by a linear-chain conditional random field over leaf blocks of the page's tree.

A page is the chain of its blocks. A block's features are the tags and class words of its ancestors, the
nearest ones apart, its length, share of link text, punctuation, and its words if it is short; two states
(kept or not) with their transitions make the field. It is trained by maximum likelihood with forward and
backward passes over labelled pages and decoded by Viterbi; the kept blocks are joined by line feeds.

Labelled pages come from the pages themselves. Pages that name their article (`article`, `main`) label
their blocks by it. Each such page is also shown in versions where the article is a plain or differently
named container and where menus, headers, sidebars, notices, adverts, forms and reader comments with texts of
other pages have been put around and into it, labelled as what they are, so the field learns each kind
from several signs. Training takes the `SAMPLE` labelled pages with the smallest hashes of their ids, read
whole, in one task; the model is `SLOTS` * 2 weights and the transitions, and goes to all tasks.

Nulls, empty and repeated rows: a null or empty page has the text "" and 0 characters; a null `page_id` or
`url` stays null; rows that repeat each have their result. Malformed markup is read as far as it goes, in time
and memory that grow with its length. If no
page is labelled, every block outside of scripts and styles is kept. An empty table gives no rows. Other
columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.dom import Block, Node, blocks

SLOTS = 1 << 15
#: Labelled pages that training takes at most; each is shown in `VERSIONS` more versions.
SAMPLE = 300
VERSIONS = 2
#: Pages of more blocks, or of deeper ones, are not learnt from.
MOST_BLOCKS, DEEPEST = 5000, 200
SEED = 3
STEPS = 60
RATE = 0.3
PENALTY = 1e-4
#: A short block's words are features.
SHORT = 5

_ARTICLE = frozenset(["article", "main"])
_OTHER = frozenset("nav header footer aside form menu dialog".split())
_LETTERS = re.compile(r"[^\W\d_]+")

#: Markup put into training pages: kind, element, and class words it may go by.
KINDS = (
    ("menu", ("nav", "ul", "div"), ("menu", "navbar", "nav", "breadcrumb", "topnav", "navigation", "tabs", "links", "tags", "pagination")),
    ("header", ("header", "div"), ("header", "masthead", "banner", "top", "logo", "branding", "byline", "meta", "")),
    ("sidebar", ("aside", "div", "section"), ("sidebar", "side", "related", "widget", "recommended", "trending", "rail", "popular", "more", "")),
    ("notice", ("div", "section", "aside"), ("cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "cookies", "message", "disclaimer")),
    ("advert", ("div", "aside", "section"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner", "adbox")),
    ("form", ("form", "div"), ("form", "search", "login", "newsletter", "subscribe", "signup", "contact", "subscription", "")),
    ("comments", ("section", "div", "ol", "ul"), ("comments", "comment", "replies", "discussion", "disqus", "responses", "respond", "reviews", "comment list")),
    ("share", ("div", "ul"), ("share", "social", "sharing", "follow", "buttons", "toolbar", "tools")),
    ("footer", ("footer", "div"), ("footer", "copyright", "legal", "bottom", "colophon", "")),
)
CONTAINERS = ("", "content", "post", "entry", "story", "article body", "main content", "post content", "text", "page", "container", "wrapper")
PHRASES = {
    "notice": ("We use cookies to improve your experience.", "Accept all", "By using this site you agree to our terms.", "This site uses cookies."),
    "form": ("Search", "Subscribe to our newsletter", "Enter your email", "Sign up", "Log in", "Send", "Name", "Password"),
    "menu": ("Home", "About", "Contact", "News", "Next", "Previous", "Archive"),
    "share": ("Share", "Tweet", "Print", "Email", "Follow us"),
    "comments": ("Comments", "Leave a comment", "Reply", "Anonymous says:", "3 comments", "Report"),
    "sidebar": ("Related articles", "Most read", "Popular", "Recent posts", "Read more"),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Special offer"),
    "header": ("Welcome", "Menu", "Skip to content"),
    "footer": ("All rights reserved.", "Privacy policy", "Terms of use", "© 2020"),
}


@lru_cache(1 << 16)
def _known_slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name) & (SLOTS - 1)


def _slot(name: str) -> int:
    return _known_slot(name) if len(name) < 100 else _known_slot.__wrapped__(name)


def _inherited(tag: str, words: tuple) -> list[int]:
    """Slots of an element that all blocks within it have."""
    return [_slot(f"in {tag}"), *(_slot(f"named {w}") for w in words)]


def _near(path: tuple, depth: int) -> set[int]:
    """Slots of a block's depth and its two nearest elements, the nearest last."""
    found = {_slot(f"depth {min(depth, 12)}")}
    for far, (tag, words) in enumerate(reversed(path)):
        found.add(_slot(f"at {far} {tag}"))
        found.update(_slot(f"at {far} named {w}") for w in words)
    return found


@lru_cache(1 << 10)
def _path_slots(path: tuple) -> tuple[int, ...]:
    return tuple(_near(path[-2:], len(path)).union(*(_inherited(*e) for e in path)))


class Scores:
    """What the elements around a block add to its scores, for blocks in page order.

    The slots on the path are kept as elements open and close, so each element costs its own slots once,
    however many blocks stand in it and however deep it is.
    """

    def __init__(self, weights: list[list[float]]) -> None:
        self.weights = weights
        self.open: list[tuple[Node, list[int]]] = []
        self.held: Counter[int] = Counter()
        self.sums = [(0.0, 0.0)]

    def _add(self, total: tuple[float, float], slots) -> tuple[float, float]:
        a, b = total
        for slot in slots:
            x, y = self.weights[slot]
            a, b = a + x, b + y
        return a, b

    def of(self, node: Node | None) -> tuple[float, float]:
        new = []
        at = node
        while at and not (len(self.open) >= at.depth and self.open[at.depth - 1][0] is at):
            new.append(at)
            at = at.parent
        while len(self.open) > (at.depth if at else 0):
            self.held.subtract(self.open.pop()[1])
            self.sums.pop()
        for one in reversed(new):
            own = sorted(set(_inherited(one.tag, one.words)))
            self.sums.append(self._add(self.sums[-1], [s for s in own if self.held[s] <= 0]))
            self.held.update(own)
            self.open.append((one, own))
        near = [(n.tag, n.words) for n, _ in self.open[-2:]]
        return self._add(self.sums[-1], [s for s in sorted(_near(near, len(self.open))) if self.held[s] <= 0])


@dataclass(slots=True)
class Shown:
    """A block of a training page, with its path written out."""

    text: str
    path: tuple
    links: float
    start: int


def text_slots(block: Block | Shown) -> set[int]:
    """Slots of a block's own text."""
    words = block.text.split()
    n = len(words)
    found = [
        f"words {min(n, 1 << 10).bit_length()}",
        f"links {round(block.links * 4)}",
        f"ends {block.text[-1] if not block.text[-1].isalnum() else 'a'}",
        f"commas {min(3, block.text.count(','))}",
        f"both {min(n, 1 << 10).bit_length()} {round(block.links * 4)}",
    ]
    if "©" in block.text:
        found.append("copyright")
    if n <= SHORT:
        found += [f"word {w.lower()}" for w in _LETTERS.findall(block.text)]
    return {_slot(f) for f in found}


def block_slots(block: Block | Shown) -> list[int]:
    return [*_path_slots(block.path), *text_slots(block)]


def named_article(page: list[Shown]) -> list[int] | None:
    """Labels of a page that names its article; None for other pages."""
    inside = [any(tag in _ARTICLE for tag, _ in b.path) for b in page]
    if not any(inside):
        return None
    return [int(own and not any(tag in _OTHER for tag, _ in b.path)) for own, b in zip(inside, page, strict=True)]


def versions(page: list[Shown], labels: list[int], texts: list[str], rng: np.random.Generator) -> Iterator[tuple[list[Shown], list[int]]]:
    """The page with another container for its article, and with other blocks around and in it."""

    def some(options):
        return options[int(rng.integers(len(options)))]

    def extra(kind: int, base: tuple) -> list[Shown]:
        name, tags, words = KINDS[kind]
        place = (*base, (some(tags), tuple(some(words).split())))
        made = []
        for _ in range(int(rng.integers(1, 6))):
            inner = place if rng.random() < 0.3 else (*place, (some(("p", "div", "li", "span", "h3", "td")), ()))
            short = name in ("menu", "share", "form") or rng.random() < 0.4
            if short:
                text = some(PHRASES[name]) if rng.random() < 0.5 else " ".join(some(texts).split()[: int(rng.integers(1, 6))])
            else:
                text = some(texts)
            linked = 1.0 if name in ("menu", "share") or rng.random() < 0.2 else 0.0
            made.append(Shown(text or "-", inner, linked, 0))
        return made

    for number in range(VERSIONS):
        words = tuple(some(CONTAINERS).split())
        tag = some(("div", "section", "td", "article", "main"))
        wrap = ((("div", tuple(some(CONTAINERS).split())),) if rng.random() < 0.5 else ())

        def moved(path: tuple) -> tuple:
            new = tuple((tag, words or w) if t in _ARTICLE else (t, w) for t, w in path)
            return (*new[:2], *wrap, *new[2:]) if number else new

        out, marks = [], []
        base = next((moved(b.path)[:-1] for b, k in zip(page, labels, strict=True) if k), ())
        for i, (b, k) in enumerate(zip(page, labels, strict=True)):
            if i and rng.random() < 2 / len(page) + 0.02:
                inside = bool(k and labels[i - 1])
                kind = int(rng.integers(len(KINDS)))
                new = extra(kind, base if inside else base[:1])
                out += new
                marks += [0] * len(new)
            out.append(Shown(b.text, moved(b.path), b.links, b.start))
            marks.append(k)
        for where in (base[:1], base):
            new = extra(int(rng.integers(len(KINDS))), where)
            out += new
            marks += [0] * len(new)
        yield out, marks


def _sums(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(scores - top).sum(axis=axis))


def fitted(pages: list[tuple[list[Shown], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights by slot and state, and transitions (rows: from not kept, kept, start; columns: to)."""
    weights, moves = np.zeros((SLOTS, 2)), np.zeros((3, 2))
    pages = [p for p in pages if p[0]]
    if not pages:
        weights[:, 1] = 1.0
        return weights, moves
    longest, count = max(len(p) for p, _ in pages), len(pages)
    rows = [block_slots(b) for p, _ in pages for b in p]
    page_of = np.repeat(np.arange(count), [len(p) for p, _ in pages])
    place = np.concatenate([np.arange(len(p)) for p, _ in pages])
    slots, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    labels = np.concatenate([k for _, k in pages])
    last = np.array([len(p) - 1 for p, _ in pages])
    real = np.zeros((count, longest), bool)
    real[page_of, place] = True
    gold = np.zeros((count, longest), int)
    gold[page_of, place] = labels
    gold_moves = np.zeros((3, 2))
    np.add.at(gold_moves, (np.full(count, 2), gold[:, 0]), 1)
    both = real[:, 1:]
    np.add.at(gold_moves, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(STEPS):
        own = np.zeros((count, longest, 2))
        own[page_of, place] = np.add.reduceat(weights[slots], starts, axis=0)
        ahead, behind = np.zeros_like(own), np.zeros_like(own)
        ahead[:, 0] = own[:, 0] + moves[2]
        for t in range(1, longest):
            step = _sums(ahead[:, t - 1, :, None] + moves[:2], 1) + own[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _sums(moves[:2] + (own[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = _sums(ahead[np.arange(count), last], 1)
        chance = np.exp(ahead + behind - total[:, None, None])
        pair = np.exp(
            ahead[:, :-1, :, None] + moves[:2] + (own[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        )
        wrong = chance[page_of, place]
        wrong[np.arange(len(labels)), labels] -= 1
        slope = np.stack([np.bincount(slots, wrong[owner, s], SLOTS) for s in (0, 1)], axis=1) / count + PENALTY * weights
        expected = np.concatenate([pair[both].sum(axis=0), chance[:, 0].sum(axis=0)[None]])
        slope_m = (expected - gold_moves) / count
        seen_w += slope**2
        seen_m += slope_m**2
        weights -= RATE * slope / np.sqrt(seen_w)
        moves -= RATE * slope_m / np.sqrt(seen_m)
    return weights, moves


def viterbi(scores: list[tuple[float, float]], moves: list[list[float]]) -> list[int]:
    """The most likely states of a chain."""
    if not scores:
        return []
    (aa, ab), (ba, bb), (sa, sb) = moves
    a, b = scores[0][0] + sa, scores[0][1] + sb
    back = []
    for x, y in scores[1:]:
        from_a, from_b = a + aa >= b + ba, a + ab >= b + bb
        back.append((0 if from_a else 1, 0 if from_b else 1))
        a, b = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y
    state = 0 if a > b else 1
    out = [state]
    for step in reversed(back):
        state = step[state]
        out.append(state)
    return out[::-1]


def decoded(page: list[Block], weights: list[list[float]], moves: list[list[float]]) -> list[int]:
    scores, own = [], Scores(weights)
    for block in page:
        scores.append(own._add(own.of(block.node), sorted(text_slots(block))))
    return viterbi(scores, moves)


def train(pages: DataFrame, sample: int = SAMPLE) -> tuple[bytes, list[list[float]]]:
    """The model, from the labelled pages among `pages`(page_id, html)."""
    drawn = pages.select(F.xxhash64(F.lit(SEED), "page_id").alias("draw"), F.col("html").cast("string").alias("html"))
    drawn = drawn.where(F.lower("html").rlike("<(article|main)[ >]")).orderBy("draw", F.xxhash64("html")).limit(sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        known = []
        for batch in batches:
            for page in batch["html"].to_pylist():
                found = blocks(page)
                if len(found) > MOST_BLOCKS or any(b.node and b.node.depth > DEEPEST for b in found):
                    continue
                made = [Shown(b.text, b.path, b.links, b.start) for b in found]
                if labels := named_article(made):
                    known.append((made, labels))
        texts = [b.text for page, _ in known for b in page] or ["-"]
        shown = [v for page, labels in known for v in ((page, labels), *versions(page, labels, texts, rng))]
        weights, moves = fitted(shown)
        yield pa.RecordBatch.from_pydict({"weights": [np.asarray(weights, "<f4").tobytes()], "moves": pa.array([moves.ravel().tolist()], pa.list_(pa.float64()))})

    model = drawn.select("html").coalesce(1).mapInArrow(fit, "weights binary, moves array<double>").first()
    if model is None:  # no task ran: there are no pages
        weights, moves = fitted([])
        return np.asarray(weights, "<f4").tobytes(), moves.tolist()
    return model.weights, np.reshape(model.moves, (3, 2)).tolist()


def extracted(pages: DataFrame, model: tuple[bytes, list[list[float]]]) -> DataFrame:
    """page_id, url, text and n_chars, its code points."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, moves = sent.value
        weights = np.frombuffer(raw, "<f4").astype(float).reshape(SLOTS, 2).tolist()
        for batch in batches:
            texts = []
            for page in batch["html"]:
                made = blocks(page.as_py() or "")
                states = decoded(made, weights, moves)
                texts.append("\n".join(b.text for b, kept in zip(made, states, strict=True) if kept))
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch["page_id"], "url": batch["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
