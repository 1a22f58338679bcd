"""Whole batches of texts as numpy arrays: code points, tokens, token hashes.

Tokens are numbered over the batch; a hash of 64 bits stands for the token's
characters. What is worked out for a token is kept in a table of fixed size
that later batches reuse, so memory does not grow with the vocabulary.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: White space by Unicode's property.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
POWERS = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64 bits (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def classes() -> np.ndarray:
    """Class of each code point, built once in a process."""
    if "class" not in _tables:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        _tables["class"] = table
    return _tables["class"]


def lower(codes: np.ndarray) -> np.ndarray:
    """Lower case of each code point by itself, where that is one code point, so that positions stay."""
    if "lower" not in _tables:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(classes() == LETTER):
            if len(c := chr(i).lower()) == 1:
                table[i] = ord(c)
        _tables["lower"] = table
    return _tables["lower"][codes]


def salts() -> np.ndarray:
    """A random odd number for each code point."""
    if "salt" not in _tables:
        _tables["salt"] = mix(np.arange(1, 0x110001, dtype=np.uint64)) | np.uint64(1)
    return _tables["salt"]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text begins."""
    whole = "\n".join(texts) + "\n"
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return codes, np.cumsum(sizes) - sizes


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of True; the last element must be False."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    return edge[0::2], edge[1::2]


def hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of 64 bits of each token codes[begin:end]; tokens must be in text order, not overlap and not be empty."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    if (begin[1:] < end[:-1]).any():
        raise ValueError("tokens are not in text order")
    terms = salts()[codes]
    size = end - begin
    starts = np.zeros(len(codes), np.int64)
    starts[begin[0]] = begin[0]
    starts[begin[1:]] = np.diff(begin)
    at = np.arange(len(codes)) - np.cumsum(starts)
    np.clip(at, 0, None, out=at)
    terms *= POWERS[at & (len(POWERS) - 1)]
    cut = np.empty(2 * len(begin), np.int64)
    cut[0::2], cut[1::2] = begin, end
    cut = cut[:-1] if cut[-1] >= len(codes) else cut
    total = np.add.reduceat(terms, cut)[0::2]
    return mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


class Memo:
    """Rows of numbers for hashes, in a table of fixed size; a new hash takes the slot of an old one."""

    def __init__(self, width: int, bits: int = 19, kind: type = np.float32) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.zeros((1 << bits, width), kind)

    def get(self, h: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The row of each hash. make: rows for the positions in h given to it, rising, one position for each unknown hash."""
        slot = (h >> self.shift).astype(np.int64)
        out = self.rows[slot]
        lost = np.flatnonzero(self.keys[slot] != h)
        if len(lost):
            new, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            order = np.argsort(first)
            found = make(lost[first[order]])
            made = np.empty_like(found)
            made[order] = found
            out[lost] = made[back]
            to = (new >> self.shift).astype(np.int64)
            self.keys[to] = new
            self.rows[to] = made
        return out


def strings(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[str]:
    """The tokens as strings."""
    if not len(begin):
        return []
    size = end - begin
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    flat = codes[at].astype("<u4").tobytes().decode("utf-32-le")
    out, k = [], 0
    for n in size.tolist():
        out.append(flat[k : k + n])
        k += n
    return out
