"""Word n-gram sets and MinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import math
import re

import numpy as np
from xxhash import xxh3_64_intdigest

# Fixed value: words as the contracts name them.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of words with a bounded memory of words seen."""

    def __init__(self, size: int = 300_000):
        self.size, self.known = size, {}

    def __call__(self, text: str) -> np.ndarray:
        found = _WORD.findall(text.translate(_LOWER))
        known = self.known
        if len(known) > self.size:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def ngram_set(text: str | None, n: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of words.

    A text of fewer words, but not none, is one gram. A text without words is one
    gram of its own characters; null and empty texts have no gram.
    """
    if not text:
        return np.empty(0, np.uint64)
    h = hasher(text)
    if not len(h):
        return np.array([xxh3_64_intdigest("\x00" + text)], np.uint64)
    size = min(n, len(h))
    count = len(h) - size + 1
    gram = np.zeros(count, np.uint64)
    for i in range(size):
        gram = gram * _M1 + h[i:i + count]
    return np.unique(mix64(gram))


def choose_bands(threshold: float, recall: float, max_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows) with the fewest false candidates among those that reach the recall.

    A pair at the threshold s meets in some band with probability 1-(1-s^r)^b; of
    all (b, r) with b*r <= max_hashes that reach ``recall`` there, the one whose
    curve has the least area below the threshold is taken.
    """
    best = None
    grid = np.linspace(0.0, threshold, 201)
    for r in range(1, max_hashes + 1):
        hit = threshold ** r
        b = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if b * r > max_hashes:
            break
        area = float((1 - (1 - grid ** r) ** b).mean())
        if best is None or area < best[0]:
            best = (area, b, r)
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best[1], best[2]


class MinHasher:
    """Band hashes of n-gram sets: the least value under each of bands*rows hash functions."""

    CHUNK = 1024

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        k = np.arange(1, bands * rows + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)
        self.mul = (mix64(k * _STEP) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.add = (mix64(k * _STEP + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)[:, None]
        self.band_seed = mix64(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)
        self.room = np.empty((2, len(k) * self.CHUNK), np.uint32)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        value = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(value), self.CHUNK):
            v = value[s:s + self.CHUNK]
            shape = len(least), len(v)
            x, y = (room[:shape[0] * shape[1]].reshape(shape) for room in self.room)
            np.multiply(v, self.mul, out=x)
            x += self.add
            np.right_shift(x, np.uint32(16), out=y)
            x ^= y
            x *= np.uint32(0x85EBCA6B)
            np.minimum(least, x.min(axis=1), out=least)
        rows = least.astype(np.uint64).reshape(self.bands, self.rows)
        out = self.band_seed.copy()
        for i in range(self.rows):
            out = mix64(out + rows[:, i] + _STEP)
        return out.view(np.int64)
