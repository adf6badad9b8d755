"""Content-defined anchors: which places of two texts can hold a common run of ``length`` items.

Every run of ``length`` items holds ``length - gram + 1`` grams; the one with the least hash is
the run's anchor. Equal runs have equal anchors at equal places, so only runs whose anchor
gram occurs elsewhere can repeat, and all occurrences of a run meet where its anchor's hash
is sent. Neighbouring runs mostly share their anchor and form one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from footfall.llm.common import gram_hashes, mixed

PLACE_BITS = 31  # places inside a slice; the other bits of an anchor's rank are its hash
_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) that start at each place."""
    h, n = _BYTE_HASH[data], 1
    while n < gram:
        if len(h) <= n:
            return np.zeros(0, np.uint64)
        a = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        a ^= a >> np.uint64(29)
        h = a + h[n:]
        n *= 2
    return mixed(h)


def word_grams(words: np.ndarray, gram: int) -> np.ndarray:
    return gram_hashes(words, gram)


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values that start at each place."""
    out, n = v, 1
    while 2 * n <= width:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    if n < width:
        out = np.minimum(out[: len(out) - (width - n)], out[width - n :])
    return out


@dataclass(frozen=True)
class Segments:
    """Runs of neighbouring windows with one anchor: windows ``first`` to ``last`` (inclusive starts)."""

    key: np.ndarray      # hash of the anchor gram
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray      # index of the document in the slice

    def __len__(self) -> int:
        return len(self.key)

    def take(self, at: np.ndarray) -> "Segments":
        return Segments(self.key[at], self.first[at], self.last[at], self.doc[at])


def segments(grams: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Segments:
    """Segments of documents laid end to end; ``ends`` are the documents' ends among the items."""
    n = int(ends[-1]) if len(ends) else 0
    if n < length:
        none = np.zeros(0, np.int64)
        return Segments(none.astype(np.uint64), none, none, none)
    assert n < 1 << PLACE_BITS
    place = np.arange(len(grams), dtype=np.uint64)
    rank = (grams & ~np.uint64((1 << PLACE_BITS) - 1)) | place
    anchor = window_min(rank, length - gram + 1)[: n - length + 1] & np.uint64((1 << PLACE_BITS) - 1)
    starts = np.concatenate([[0], ends[:-1]])
    inside = np.zeros(n - length + 2, np.int32)
    has = ends - starts >= length
    inside[starts[has]] += 1
    np.subtract.at(inside, ends[has] - length + 1, 1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    stop = np.flatnonzero(inside & np.concatenate([change[1:] | ~inside[1:], [True]]))
    return Segments(grams[anchor[first].astype(np.int64)], first, stop, np.searchsorted(ends, first, side="right"))
