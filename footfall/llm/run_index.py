"""Long repeats of bytes through a run-length index.

Where texts meet (see ``repeats``), their Burrows-Wheeler transform is built and compressed to
its runs. At each run's head the text position and that of the suffix before it (the end of
the run before) are sampled. Between samples both the neighbour and the length matched with it
follow from the nearest sample to the left: one place further in the text the neighbour moves
one place too and the match is one byte shorter. So match lengths are computed at run heads
only and streamed over the rest of the text; in repetitive texts runs are few.

A byte is removed if a window of ``length`` bytes over it starts anywhere else as well.

Defined cases: null texts are empty; shorter texts lose nothing; matches never cross documents;
repeated rows remove each other wholly; overlapping occurrences count; windows are judged on
the input.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from footfall.llm.repeats import Repeats, Slice, find

WINDOW = 200
GRAM = 64  # bytes of an anchor: shorter ones stand in different texts by chance, the more the larger the corpus
BLOCK_BYTES = 1 << 20  # bytes of one index, about; groups of texts that could match stay together


class RunIndex:
    """Run-length BWT of several texts with samples at run heads. Suffixes end with their text."""

    def __init__(self, texts: list[bytes]) -> None:
        lens = np.array([len(t) for t in texts], np.int64)
        self.ends = np.repeat(np.cumsum(lens), lens)
        self.starts = np.cumsum(lens) - lens
        data = np.frombuffer(b"".join(texts), np.uint8)
        self.n = n = len(data)
        self.codes = data.astype(np.uint8) + np.uint8(1)  # UTF-8 has no byte above 0xF4; 0 is past the end
        self.levels = self._ranks(int(lens.max()) if len(lens) else 0)
        suffixes = np.argsort(self.levels[-1][1] * n + np.arange(n)) if n else np.zeros(0, np.int64)  # equal ones by place
        before = np.zeros(n, np.int32)
        before[1:] = self.codes[:-1]
        before[self.starts[lens > 0]] = -1 - np.arange(int((lens > 0).sum()))  # what precedes a text is like nothing else
        bwt = before[suffixes]
        heads = np.ones(n, bool)
        heads[1:] = bwt[1:] != bwt[:-1]
        at = np.flatnonzero(heads)
        self.runs = len(at)
        place = suffixes[at]
        neighbour = np.where(at > 0, suffixes[np.maximum(at - 1, 0)], -1)
        by = np.argsort(place)
        self.place, self.neighbour = place[by], neighbour[by]

    def _window(self, k: int) -> np.ndarray:
        """The 8 codes from each place, as far as the text goes, as one number."""
        out = np.zeros(self.n, np.uint64)
        place = np.arange(self.n)
        for j in range(k):
            at = place + j
            here = np.where(at < self.ends, self.codes[np.minimum(at, self.n - 1)], 0).astype(np.uint64)
            out = (out << np.uint64(8)) | here
        return out

    def _ranks(self, longest: int) -> list[tuple[int, np.ndarray]]:
        """(k, rank of the k codes from each place) for k = 8, 16, ... beyond the longest text."""
        key, k, out = self._window(8), 8, []
        while True:
            order = np.argsort(key)  # equal keys share their rank
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], key[order[1:]] != key[order[:-1]]])) if self.n else []
            out.append((k, rank))
            if k >= longest:
                return out
            at = np.arange(self.n) + k
            then = np.where(at < self.ends, rank[np.minimum(at, self.n - 1)], 0)
            key, k = rank.astype(np.uint64) * np.uint64(self.n + 1) + then.astype(np.uint64), 2 * k

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at ``a`` and ``b``."""
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        done = np.zeros(len(a), np.int64)
        for k, rank in reversed(self.levels):
            more = done + k <= most
            x, y = np.minimum(a + done, self.n - 1), np.minimum(b + done, self.n - 1)
            done += np.where(more & (rank[x] == rank[y]), k, 0)
        for _ in range(8):  # the rest is shorter than the lowest level
            x, y = np.minimum(a + done, self.n - 1), np.minimum(b + done, self.n - 1)
            done += (done < most) & (self.codes[x] == self.codes[y]) & (self.alive(a, b, done))
        return np.minimum(done, most)

    def alive(self, a: np.ndarray, b: np.ndarray, done: np.ndarray) -> np.ndarray:
        return (a + done < self.ends[a]) & (b + done < self.ends[b])

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For every place the suffix sorted just before it (-1: none) and the length they share."""
        has = self.neighbour >= 0
        length = np.zeros(self.runs, np.int64)
        length[has] = self.common(self.place[has], self.neighbour[has])
        place = np.arange(self.n)
        near = np.searchsorted(self.place, place, side="right") - 1
        gone = place - self.place[near]
        shared = np.maximum(length[near] - gone, 0)
        return np.where(self.neighbour[near] >= 0, self.neighbour[near] + gone, -1), shared


def repeated_windows(texts: list[bytes], window: int) -> np.ndarray:
    """Per byte of the texts laid end to end, whether the window from it also starts elsewhere in them."""
    index = RunIndex(texts)
    neighbour, shared = index.matches()
    hit = np.flatnonzero(shared >= window)
    out = np.zeros(index.n, bool)
    out[hit] = True
    out[neighbour[hit]] = True
    return out


def look_up(groups: list[list[tuple[bytes, list]]], window: int) -> None:
    """Fill in, for each text, the runs of windows that occur elsewhere."""
    block: list = []
    size = 0
    for group in groups:
        block += group
        size += sum(len(t) for t, _ in group)
        if size >= BLOCK_BYTES:
            _block(block, window)
            block, size = [], 0
    _block(block, window)


def _block(texts: list[tuple[bytes, list]], window: int) -> None:
    if not texts:
        return
    hit = repeated_windows([t for t, _ in texts], window)
    at = 0
    for t, own in texts:
        here = np.ones(len(t) - window + 1, bool) if own[1] > 1 else hit[at : at + len(t) - window + 1]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]]))).tolist()
        own[2] = [(a, b, 0) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        at += len(t)


RULE = Repeats(length=WINDOW, gram=GRAM, words=False, ordered=False)


def _edges(gone: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))


def _digest(s: Slice, i: int, gone: np.ndarray) -> tuple:
    text = s.texts[i]
    if not gone.any():
        return len(text), 0, 0, sha256(text).hexdigest()
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), len(_edges(gone)) // 2, sha256(kept).hexdigest()


def _spans(s: Slice, i: int, gone: np.ndarray) -> tuple:
    edges = _edges(gone)
    return len(s.texts[i]), edges[::2].tolist(), edges[1::2].tolist()


def removal_digests(docs: DataFrame, rule: Repeats = RULE, **names: str) -> DataFrame:
    return find(docs, rule, look_up, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", _digest, **names)


def repeated_spans(docs: DataFrame, rule: Repeats = RULE, **names: str) -> DataFrame:
    """(doc_id, n_bytes, span_starts, span_ends): maximal repeated spans in bytes."""
    return find(docs, rule, look_up, "doc_id long, n_bytes long, span_starts array<int>, span_ends array<int>", _spans, **names)
