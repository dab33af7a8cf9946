"""64-bit hashes of the words of many texts at once, in numpy.

A word's hash is a polynomial in its bytes, read off prefix sums modulo 2**64 (the base
is odd, so its powers have inverses), then mixed. Prefix sums are taken over windows of
``WINDOW`` bytes, so scratch memory is bounded however long a text or a word is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from taxolens.llm.common import mix64

WINDOW = 1 << 18
#: Texts are hashed together until they have so many bytes.
TOGETHER = 1 << 20
BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
#: What ``bytes.split()`` splits on.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    up, down = np.full(WINDOW + 1, BASE, np.uint64), np.full(WINDOW + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` in order, and where each begins."""
    a = np.frombuffer(data, np.uint8)
    if not a.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.zeros(a.size + 2, bool)
    np.logical_not(SPACE[a], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    found = np.zeros(starts.size, np.uint64)
    up, down = _powers()
    sums = np.zeros(min(a.size, WINDOW) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, a.size, WINDOW):
            own = a[at : at + WINDOW].astype(np.uint64)
            own += np.uint64(1)
            own *= up[: own.size]
            np.cumsum(own, out=sums[1 : own.size + 1])
            i, j = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + own.size)
            if i == j:
                continue
            s, e = np.maximum(starts[i:j] - at, 0), np.minimum(ends[i:j] - at, own.size)
            part = (sums[e] - sums[s]) * down[s]
            if starts[i] < at:  # the rest of a word that began in an earlier window
                part[0] *= np.uint64(pow(BASE, int(at - starts[i]), 1 << 64))
            found[i:j] += part
    return mix64(found), starts


def hashed_words(texts: list[bytes], lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each text, A-Z lower-cased first unless told otherwise."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) < TOGETHER):
            size, to = size + len(texts[to]) + 1, to + 1
        data = b"\n".join(texts[at:to])
        hashes, starts = word_hashes(data.lower() if lower else data)
        tops = np.cumsum([len(t) + 1 for t in texts[at:to]])
        edges = np.concatenate([[0], np.searchsorted(starts, tops)]).tolist()
        for a, b in zip(edges, edges[1:]):
            yield hashes[a:b]
        at = to


class Lookup:
    """Places of 64-bit keys in an array: an open-addressed table, asked in bulk."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.int64)
        self.bits = max(4, int(2 * self.keys.size).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.most = 0
        left = np.arange(self.keys.size, dtype=np.int32)
        slot = self._home(self.keys)
        while left.size:
            self.most += 1
            open_ = np.flatnonzero(self.slots[slot] < 0)[::-1]
            self.slots[slot[open_]] = left[open_]  # one key a slot: the last written, so the first
            stay = np.flatnonzero(self.slots[slot] != left)
            left, slot = left[stay], (slot[stay] + 1) & (self.slots.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        keys = np.ascontiguousarray(keys).view(np.int64)
        found = np.full(keys.size, -1, np.int32)
        if not self.keys.size:
            return found
        asked, slot = None, self._home(keys)
        for _ in range(self.most):
            own = self.slots[slot]
            want = keys if asked is None else keys[asked]
            full = own >= 0
            hit = full & (self.keys[own] == want)
            where = np.flatnonzero(hit)
            found[where if asked is None else asked[where]] = own[where]
            on = np.flatnonzero(full & ~hit)
            if not on.size:
                break
            asked, slot = on if asked is None else asked[on], (slot[on] + 1) & (self.slots.size - 1)
        return found
