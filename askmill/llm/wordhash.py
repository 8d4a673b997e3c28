"""Hashes of all words of many texts at once, by array operations over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed in one go; each takes about 40 bytes of memory meanwhile.
STRIDE = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _hash(data: np.ndarray) -> np.ndarray:
    """Hashes of the words between white space; each byte times a factor of its place in the word."""
    word = ~_SPACE[data]
    starts = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(word)
    lengths = np.diff(np.searchsorted(at, np.append(starts, len(data))))
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        terms = (data[at].astype(np.uint64) + np.uint64(1)) * _factors(int(lengths.max()))[place]
        return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the words of one text (UTF-8 bytes) in order; a long text is hashed in strides."""
    out, start = [], 0
    while start < len(data):
        end = min(len(data), start + STRIDE)
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[start:end]])
            if len(spaces):
                end = start + int(spaces[-1]) + 1
            else:  # a word longer than a stride
                more = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(more[0]) if len(more) else len(data)
        some = data[start:end]
        out.append(_hash(_LOWER[some] if lower else some))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def all_word_hashes(texts: list[bytes], lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first text's position, the words' hashes, and the number of words of each."""
    start = 0
    while start < len(texts):
        end, size = start + 1, len(texts[start])
        while end < len(texts) and size + len(texts[end]) < STRIDE:
            size += len(texts[end]) + 1
            end += 1
        if end == start + 1:
            hashes = word_hashes(np.frombuffer(texts[start], np.uint8), lower)
            yield start, hashes, np.array([len(hashes)])
        else:
            data = np.frombuffer(b" ".join(texts[start:end]), np.uint8)
            space = _SPACE[data]
            begins = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
            ends = np.cumsum([len(t) + 1 for t in texts[start:end]]) - 1
            yield start, _hash(_LOWER[data] if lower else data), np.diff(begins[ends], prepend=0)
        start = end


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
