"""Exact token ids of whole texts through a cache of words.

Both vocabularies split a text into words before they merge, and no word reaches over white space. So a
text's ids are its words' ids in a row, and only words not yet met go through the tokenizer, many of
them in one call. Texts whose white space isn't plain, and those that hold an added token such as an end mark, go to the
tokenizer whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

#: White space that words are not cut at: in any text, and besides in texts that are not ASCII.
_ODD = ("\x0b", "\x0c", *map(chr, range(0x1C, 0x20)))
_WIDE = (*"\x85\xa0\u1680\u180e", *map(chr, range(0x2000, 0x200C)), *"\u2028\u2029\u202f\u205f\u3000\ufeff")
#: White space that the byte vocabulary's words are not cut at either.
_RUNS = ("\t", "\r", "\n\n", "\n ", " \n", "  ")
_PIECES = re.compile("\n| ?[^ \n]+")
#: Words kept by one Python worker; a word and its ids take about 150 bytes.
CACHED_WORDS = 1_000_000
#: When that many are kept, words of up to so many characters stay: they come back most often.
SHORT = 9
#: Words that one text for the tokenizer joins.
RUN = 128


def _loose(text: str) -> bool:
    return any(c in text for c in _ODD) or not text.isascii() and any(c in text for c in _WIDE)


def _spaced(text: str) -> bool:
    return _loose(text) or text[:1] == " " or text[-1:] == " " or any(c in text for c in _RUNS)


def _pieces(text: str) -> list[str]:
    """Words with the blank before them, and line feeds; there may be empty pieces beside these."""
    if "\0" in text:
        return _PIECES.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


class WordIds:
    """Encodes texts with the tokenizer file at `path`, without special tokens."""

    def __init__(self, path: str, cached: int = CACHED_WORDS) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cached, self.cache = cached, {"": b""}
        self.drops = len(self._ids("a\nb")) == 2
        self.separator = " | " if self.drops else "\n"
        (self.mark,) = self._ids(self.separator)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, self.width).tobytes()

    def _words(self, text: str) -> list[str] | None:
        if self.added and self.added.search(text):
            return None
        if self.drops:
            return None if _loose(text) else text.split()
        return None if _spaced(text) else _pieces(text)

    def _learn(self, words: set[str]) -> None:
        """Caches the words; they are joined by a separator that stands in none of them."""
        if not (new := words.difference(self.cache)):
            return
        if len(self.cache) + len(new) > self.cached:
            short = {w: ids for w, ids in self.cache.items() if len(w) <= SHORT}
            self.cache = short if len(short) < self.cached // 2 else {"": b""}
            new = words.difference(self.cache)
        plain = [w for w in new if "|" not in w and w != "\n"]
        for word in new.difference(plain):
            self.cache[word] = self._pack(self._ids(word))
        size = self.width.itemsize
        for start in range(0, len(plain), 4096):
            runs = [plain[i : i + RUN] for i in range(start, min(start + 4096, len(plain)), RUN)]
            made = self.tokenizer.encode_batch_fast([self.separator.join(r) for r in runs], add_special_tokens=False)
            for run, ids in zip(runs, (np.asarray(e.ids, self.width) for e in made), strict=True):
                cuts = np.flatnonzero(ids == self.mark) * size
                packed = ids.tobytes()
                for word, a, b in zip(run, [0, *(cuts + size).tolist()], [*cuts.tolist(), len(packed)], strict=True):
                    self.cache[word] = packed[a:b]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of `width`; null counts as empty."""
        out, start = [], 0
        while start < len(texts):
            words, seen, end = [], 0, start
            while end < len(texts) and seen < 200_000:
                words.append(self._words(texts[end] or ""))
                seen += len(words[-1] or ())
                end += 1
            self._learn(set().union(*(w for w in words if w is not None)))
            for text, own in zip(texts[start:end], words, strict=True):
                out.append(self._pack(self._ids(text)) if own is None else b"".join(map(self.cache.__getitem__, own)))
            start = end
        return out


@cache
def word_ids(path: str, cached: int = CACHED_WORDS) -> WordIds:
    """One encoder for each tokenizer file and Python worker."""
    return WordIds(path, cached)
