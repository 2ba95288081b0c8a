"""The segment join of problem 3: evaluation strings in segments, matched by substrings of training strings at allowed positions.

An edit touches at most one of several disjoint segments. Of any ``k + 1`` segments of an evaluation string one is therefore
unchanged in every string within ``k`` edits. Of the segments of ``GRAM`` characters that the string divides into, the ``k + 1``
that are rarest in their block take part; since ``k`` is a share of the longer string, a longer partner brings in more of them.

Numbered in order from 0, among the segments that take part there is one, say the i-th, that stands in the partner with at most
``i`` edits to its left and at most ``k - i`` to its right (were it not so at the first one with at most ``i`` edits to the left,
the segments between it and the last unchanged one before would have fewer edits than there are of them). So its place in the partner, counted
from the left, is off by at most ``i``, and counted from the right by at most ``k - i``; the index keeps each segment on the side on which it has
less room, under a hash of its characters and of each stretch of ``WIDTH`` places that it may stand in.

Pairs whose bound is not less than the number of segments (very short strings, lengths at the very edge of the bound) have no
such guarantee and are all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM, WIDTH = 4, 64
#: Bits of the table of counts that ranks segments; of rows, characters and matches that are worked on at once.
COUNT_BITS, MOST_ROWS, MOST_CHARS, MOST_MATCHES = 20, 256, 1 << 17, 1 << 19
NEED_BITS = 24
LEFT, RIGHT = np.uint64(0), np.uint64(0x5851F42D4C957F2D)


def hashed(codes: np.ndarray, gram: int) -> np.ndarray:
    """A well mixed 64-bit hash of every ``gram`` characters."""
    if len(codes) < gram:
        return np.empty(0, np.uint64)
    size = len(codes) - gram + 1
    with np.errstate(over="ignore"):
        total = np.zeros(size, np.uint64)
        for i in range(gram):
            total = total * np.uint64(0x100000001B3) + codes[i : size + i] * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(31)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(29)
    return total


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def placed(hashes: np.ndarray, side: np.ndarray | np.uint64, stretch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes ^ side) + stretch.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)


def bound_of(size: np.ndarray, most_edits: float) -> np.ndarray:
    return np.floor(size * most_edits).astype(np.int64)


class SegmentIndex:
    """The segments of a block of evaluation strings."""

    def __init__(self, texts: list[str], most_edits: float):
        self.most_edits = most_edits
        codes, self.sizes = codes_of("".join(texts)), np.array([len(x) for x in texts], np.int64)
        hashes, begin = hashed(codes, GRAM), np.cumsum(self.sizes) - self.sizes
        self.segments = self.sizes // GRAM
        own = np.repeat(np.arange(len(texts)), self.segments)
        number = ramp(self.segments)
        start = number * self.sizes[own] // self.segments[own]
        gram = hashes[begin[own] + start]
        slots = (hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)
        often = np.bincount(slots, minlength=1 << COUNT_BITS)[(gram >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
        rank = np.empty(len(own), np.int64)
        rank[np.lexsort((often, own))] = number
        always = rank <= bound_of(self.sizes, most_edits)[own]
        before = np.cumsum(always) - always
        before -= before[(np.cumsum(self.segments) - self.segments)[own]]
        behind = self.segments[own] - 1 - before
        left = number <= behind
        room = np.minimum(number, behind)
        place = np.where(left, start, self.sizes[own] - start)
        low = np.maximum(place - room, 0) // WIDTH
        copies = (place + room) // WIDTH - low + 1
        entry = np.repeat(np.arange(len(own)), copies)
        key = placed(gram[entry], np.where(left, LEFT, RIGHT)[entry], low[entry] + ramp(copies))
        need = np.where(always, 0, rank)[entry]
        order = np.lexsort((need, key))
        key, entry, need = key[order], entry[order], need[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        self.keys, self.first = key[new], np.flatnonzero(new)
        #: Entries of one key are in order of the bound from which on they take part.
        self.needed = (np.cumsum(new) - 1 << NEED_BITS) | np.minimum(need, (1 << NEED_BITS) - 1)
        self.owner, self.place, self.room = (x[entry].astype(np.int32) for x in (own, place, room))

    def _matches(self, keys: np.ndarray, rows: np.ndarray, places: np.ndarray, bounds: np.ndarray, out: np.ndarray) -> None:
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys[order]
        at, order = at[hit], order[hit]
        low = np.minimum(bounds[rows[order]], (1 << NEED_BITS) - 1)
        counts = np.searchsorted(self.needed, (at << NEED_BITS) | low, "right") - self.first[at]
        ends = np.cumsum(counts)
        cuts = np.searchsorted(ends, np.arange(MOST_MATCHES, ends[-1] if len(ends) else 0, MOST_MATCHES))
        for a, b in zip((0, *cuts), (*cuts, len(counts))):
            n = counts[a:b]
            entry, gram = np.repeat(self.first[at[a:b]], n) + ramp(n), np.repeat(order[a:b], n)
            near = np.abs(places[gram] - self.place[entry]) <= self.room[entry]
            out[rows[gram[near]], self.owner[entry[near]]] = True

    def candidates(self, texts: list[str]) -> np.ndarray:
        """A matrix of flags, training strings by evaluation strings: all pairs that can be within the bound by segments and length."""
        codes, sizes = codes_of("".join(texts)), np.array([len(x) for x in texts], np.int64)
        hashes, begin = hashed(codes, GRAM), np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - GRAM + 1, 0)
        rows, start = np.repeat(np.arange(len(texts)), counts), ramp(counts)
        grams, bounds = hashes[begin[rows] + start], bound_of(sizes, self.most_edits)
        out = np.zeros((len(texts), len(self.sizes)), bool)
        if len(self.keys):
            for side, places in ((LEFT, start), (RIGHT, sizes[rows] - start)):
                self._matches(placed(grams, side, places // WIDTH), rows, places, bounds, out)
        bound = np.maximum(bounds[:, None], bound_of(self.sizes, self.most_edits)[None])
        out |= bound >= self.segments[None]
        out &= np.abs(sizes[:, None] - self.sizes[None]) <= bound
        return out

    def pairs(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The candidates as places in ``texts`` and in the block, worked out in parts of bounded size.

        Texts whose length is out of bounds for the whole block are passed over.
        """
        if not len(self.sizes):
            return
        least, most, share = int(self.sizes.min()), int(self.sizes.max()), self.most_edits
        near = lambda n: least - n <= share * max(n, least) and n - most <= share * max(n, most)
        wanted = [k for k, x in enumerate(texts) if near(len(x))]
        low = 0
        while low < len(wanted):
            high, chars = low, 0
            while high < len(wanted) and high - low < MOST_ROWS and chars < MOST_CHARS:
                chars += len(texts[wanted[high]])
                high += 1
            part = wanted[low:high]
            i, j = np.nonzero(self.candidates([texts[k] for k in part]))
            yield np.array(part)[i], j
            low = high
