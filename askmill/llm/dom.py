"""Leaf blocks of an HTML page: their texts, and where in the page's tree they stand.

One pass forward over the page. What could send it back is remembered: that no `>` or end tag is ahead, where
a tag whose attributes were read before ends, where in the open elements a tag was last opened. So time and memory
grow with the page's length, however it is malformed. A block points to its element, and that to its parent.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page; without an end tag the first ones go on to the end of the page,
#: as in HTML, and the content of the others counts.
_TO_THE_END = frozenset("script style title textarea".split())
RAW = _TO_THE_END | frozenset("template iframe svg select annotation annotation-xml head".split())
#: Elements that stand in the flow of a block's text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr input button "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover "
    "mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of these ends an open element of the same set that it can't stand in.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("ul ol dl table".split())


class Node:
    """An open element: its tag, the words of its class, id and role, and the element around it."""

    __slots__ = ("tag", "words", "parent", "depth")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.words, self.parent = tag, words, parent
        self.depth = parent.depth + 1 if parent else 1


def path_of(node: Node | None) -> tuple:
    """Tag and words of each element from the root to the node."""
    out = []
    while node:
        out.append((node.tag, node.words))
        node = node.parent
    return tuple(reversed(out))


@dataclass(slots=True)
class Block:
    text: str
    #: Its innermost open element.
    node: Node | None
    #: Share of the text's characters that stand in links.
    links: float
    start: int

    @property
    def path(self) -> tuple:
        return path_of(self.node)


@lru_cache(4096)
def _known_names(attributes: str) -> tuple[str, ...]:
    found = " ".join("".join(m) for m in _ATTRIBUTE.findall(attributes))
    return tuple(w.lower() for w in _WORD.findall(found))


def names(attributes: str) -> tuple[str, ...]:
    """Words of an element's class, id, role and item property, in lower case."""
    return _known_names(attributes) if len(attributes) < 500 else _known_names.__wrapped__(attributes)


class _Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = page.rfind(">")
        self.ends: dict[int, int] = {}
        self.unclosed: set[str] = set()
        self.no_quote: set[str] = set()

    def end(self, at: int) -> int:
        """Behind the tag whose attributes begin here: at the first `>` outside of quotes, or else at the first."""
        first, seen, found = at, [], -1
        while True:
            if at in self.ends:
                found = self.ends[at]
                break
            seen.append(at)
            mark = _SPECIAL.search(self.page, at)
            if not mark:
                break
            if mark[0] == ">":
                found = mark.end()
                break
            close = -1 if mark[0] in self.no_quote else self.page.find(mark[0], mark.end())
            if close < 0:
                self.no_quote.add(mark[0])
                break
            at = close + 1
        self.ends.update(dict.fromkeys(seen, found))
        return found if found >= 0 else self.page.find(">", first) + 1

    def close(self, tag: str, at: int) -> int:
        """Behind the next end tag of this name, or -1."""
        if tag in self.unclosed:
            return -1
        found = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(self.page, at, self.last + 1)
        if not found:
            self.unclosed.add(tag)
            return -1
        return found.end()


class _Open:
    """The open elements, and where among them each tag stands."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}

    @property
    def top(self) -> Node | None:
        return self.stack[-1] if self.stack else None

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append(Node(tag, words, self.top))

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.at[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def clean(text: str) -> str:
    """Character references decoded, white space turned into single spaces, trimmed."""
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in page order. Never fails: what can't be a tag is text."""
    out: list[Block] = []
    opened, tags = _Open(), _Tags(page)
    parts: list[str] = []
    linked, in_link, begin = 0, False, 0
    at, text, end = 0, 0, len(page)

    def flush(position: int) -> None:
        nonlocal linked, in_link, begin
        if parts and (found := clean("".join(parts))):
            out.append(Block(found, opened.top, min(1.0, linked / len(found)), begin))
        parts.clear()
        linked, in_link, begin = 0, False, position

    while True:
        start = page.find("<", at)
        name = None
        if start < 0:
            start = after = end
        elif page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            after = close + 3 if close >= 0 else end
        elif start > tags.last:  # no tag can end any more
            at = start + 1
            continue
        elif found := _NAME.match(page, start):
            name, after = found[1].lower(), tags.end(found.end())
        elif page[start + 1] in "!?/":
            after = page.find(">", start) + 1
        else:
            at = start + 1
            continue
        if start > text:
            parts.append(page[text:start])
            if in_link:
                linked += start - text
        if start == end:
            break
        at = text = after
        if not name:
            continue
        closing = page[start + 1] == "/"
        if name == "br":
            parts.append(" ")
            continue
        if name in RAW and not closing:
            if name == "head" or page.startswith("/>", after - 2):
                continue
            behind = tags.close(name, after)
            if behind >= 0 or name in _TO_THE_END:
                at = text = behind if behind >= 0 else end
                continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            continue
        flush(start)
        if closing:
            if (size := opened.last((name,))) >= 0:
                opened.cut(size)
        elif name not in VOID:
            if opened.stack and opened.top.tag == "p":
                opened.cut(len(opened.stack) - 1)
            if name in CLOSES:
                size = opened.last(CLOSES[name])
                if size > opened.last(_SCOPES):
                    opened.cut(size)
            opened.push(name, names(page[found.end() : after]))
    flush(end)
    return out
