"""Substring deduplication with suffix automata of reference shards.

The reference is the whole corpus, so its automata can't be sent to every executor: nothing
bounds them. Instead each shard's texts meet where the shard is (see ``repeats``), its
automaton is built there from the texts in order of document ids, and the documents' segments
are streamed through it: after each word the automaton's state says in which document the
last ``length`` words were first seen. A word is removed if a window over it was first seen
in a document with a smaller id.

Defined cases: null texts have no words; texts shorter than a window lose nothing; documents
with equal ids don't remove each other's words, and documents without an id come last; windows
are judged on the input. Words may hold any bytes but white space and are compared in full.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256
from itertools import count

import numpy as np
from pyspark.sql import DataFrame

from footfall.llm.repeats import Repeats, Slice, find

WINDOW = 13
GRAM = 6  # words of an anchor: shorter ones stand in different texts by chance, the more the larger the corpus
BLOCK_WORDS = 50_000  # words of one automaton, about; groups of texts that could match stay together


class SuffixAutomaton:
    """Automaton of all substrings of the texts added, with the smallest document number of each state.

    Texts must be added in ascending order of document number: then the number at a state's
    creation (for a clone, its original's) is the smallest of all places where its strings end.
    """

    def __init__(self) -> None:
        self.length, self.link, self.next, self.first = [0], [-1], [{}], [-1]

    def add(self, items: list[int], number: int) -> None:
        length, link, follow, first = self.length, self.link, self.next, self.first
        last = 0
        for x in items:
            here = follow[last]
            if x in here:
                q = here[x]
                last = q if length[q] == length[last] + 1 else self._clone(last, x, q)
                continue
            cur = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            first.append(number)
            here[x] = cur
            p = link[last]
            while p >= 0:
                here = follow[p]
                if x in here:
                    q = here[x]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, x, q)
                    break
                here[x] = cur
                p = link[p]
            last = cur

    def _clone(self, p: int, x: int, q: int) -> int:
        length, link, follow, first = self.length, self.link, self.next, self.first
        made = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        follow.append(dict(follow[q]))
        first.append(first[q])
        link[q] = made
        while p >= 0 and follow[p].get(x) == q:
            follow[p][x] = made
            p = link[p]
        return made

    def stream(self, items: list[int], window: int) -> list[int]:
        """For each window of ``items`` the smallest document number it occurs in, -1 if in none."""
        length, link, follow, first = self.length, self.link, self.next, self.first
        state, matched, out = 0, 0, []
        for x in items:
            here = follow[state]
            while state and x not in here:
                state = link[state]
                matched = length[state]
                here = follow[state]
            if x in here:
                state = here[x]
                matched += 1
                if matched > window:
                    matched = window
                    while length[link[state]] >= window:
                        state = link[state]
                out.append(first[state] if matched == window else -1)
            else:
                out.append(-1)
        return out[window - 1 :]


def _runs(values: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, value) of each stretch of equal values."""
    out, a, v = [], 0, values[0]
    for i, x in enumerate(values):
        if x != v:
            out.append((a, i, v))
            a, v = i, x
    out.append((a, len(values), v))
    return out


def look_up(groups: list[list[tuple[bytes, list]]], window: int) -> None:
    """Fill in, for each text, the runs of windows with the first document they occur in."""
    block: list = []
    size = 0
    for group in groups:
        block += group
        size += sum(t.count(b" ") + 1 for t, _ in group)
        if size >= BLOCK_WORDS:
            _block(block, window)
            block, size = [], 0
    _block(block, window)


def _block(texts: list[tuple[bytes, list]], window: int) -> None:
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    coded = [(list(map(known.__getitem__, t.split(b" "))), own) for t, own in texts]
    automaton = SuffixAutomaton()
    for items, own in sorted(coded, key=lambda x: x[1][0]):
        automaton.add(items, own[0])
    for items, own in coded:
        runs = _runs(automaton.stream(items, window))
        # what a text's only document is the first to have tells nothing
        own[2] = [r for r in runs if r[2] < own[0]] if own[1] == 1 else runs


RULE = Repeats(length=WINDOW, gram=GRAM, words=True, ordered=True)


def _digest(s: Slice, i: int, gone: np.ndarray) -> tuple:
    return s.n_items(i), int(gone.sum()), sha256(s.kept(i, gone)).hexdigest()


def _cleaned(s: Slice, i: int, gone: np.ndarray) -> tuple:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return s.kept(i, gone).decode("utf-8", "replace"), edges[::2].tolist(), edges[1::2].tolist()


def removal_digests(docs: DataFrame, rule: Repeats = RULE, **names: str) -> DataFrame:
    return find(docs, rule, look_up, "doc_id long, n_words long, n_removed long, kept_sha256 string", _digest, **names)


def without_repeats(docs: DataFrame, rule: Repeats = RULE, **names: str) -> DataFrame:
    """(doc_id, text, span_starts, span_ends): the words kept, joined by spaces, and the removed spans in words."""
    return find(docs, rule, look_up, "doc_id long, text string, span_starts array<int>, span_ends array<int>", _cleaned, **names)
