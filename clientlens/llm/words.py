"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text, so
``[^\\x20\\x09-\\x0D]+`` of the text. Its hash is a polynomial over the bytes
modulo 2^64 (taken from prefix sums, so a word costs the same whatever its
length), scrambled by a bijection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: Bytes of text handled together: scratch arrays take about 60 times as much.
SLICE_BYTES = 400_000


def _chain(multiplier: int, n: int) -> np.ndarray:
    powers = np.full(n, multiplier, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_POWERS = _chain(_MULTIPLIER, 1024)
_INVERSE = _chain(pow(_MULTIPLIER, -1, 1 << 64), 1024)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 4096) if n <= SLICE_BYTES + 4096 else n
        _POWERS, _INVERSE = _chain(_MULTIPLIER, size), _chain(pow(_MULTIPLIER, -1, 1 << 64), size)
    return _POWERS, _INVERSE


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ np.uint64(salt * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix sums of a byte array: the hash of any stretch in one step."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        powers, self.inverse = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.inverse[start])


@dataclass
class Words:
    """``doc`` numbers the text of each word; ``start``/``end`` are places in
    ``buffer``, the texts with one line feed after each. ``first`` has the
    number of the first word of each text, and their count at the end."""

    buffer: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    text_start: np.ndarray


def words(texts: list[bytes], lower: bool = False) -> Words:
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    space = np.ones(len(buffer) + 1, bool)
    np.take(_SPACE, buffer, out=space[1:])
    turns = np.flatnonzero(space[1:] != space[:-1])  # the last byte is white space, so every word ends
    start, end = turns[::2], turns[1::2]
    text_start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=text_start[1:])
    first = np.searchsorted(start, text_start)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buffer, doc, start, end, Prefix(buffer).of(start, end), first, text_start)


def _weights(k: int) -> np.ndarray:
    return scramble(np.arange(1, k + 1, dtype=np.uint64), salt=7) | np.uint64(1)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of every run of k words in one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1:])
    total = np.full(len(at), k, np.uint64)
    for j, weight in enumerate(_weights(k)):
        total += w.hash[at + j] * weight
    return at, scramble(total)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text (A-Z lower-cased), as
    63-bit hashes; the whole sequence as one where a text has fewer words."""
    w = words(texts, lower=True)
    at, h = grams(w, k)
    h >>= np.uint64(1)
    cut = np.searchsorted(at, w.first)
    sets = []
    for i in range(len(texts)):
        if cut[i] < cut[i + 1]:
            s = np.sort(h[cut[i]:cut[i + 1]])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n := int(w.first[i + 1] - w.first[i]):
            own = w.hash[w.first[i]:w.first[i + 1]]
            s = scramble((own * _weights(n)).sum(keepdims=True) + np.uint64(n)) >> np.uint64(1)
        else:
            s = np.empty(0, np.uint64)
        sets.append(s)
    return sets
