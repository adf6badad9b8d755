"""Finding runs of items (words or bytes) that repeat across a corpus, in three passes.

Documents are packed into slices of about ``SLICE`` bytes, written once, compressed; of texts
compared by words, the words are written, each followed by one space. With each
slice its segments are written: how its documents are cut around content-defined anchors (see
``anchors``), and per distinct segment two hashes, of its anchor and of its content, in the
order of the anchors' hashes. Texts are hashed and cut there only. Slices are dealt into buckets
as they are written, so that passes 2 and 3 shuffle what is sent to them, but not their texts.

1. The hashes go to the place (a range of anchor hashes) where they belong. There it shows
   which anchors occur once (nothing repeats), which always stand in the same content (all of
   it repeats), and which stand in different contents.
2. Slices send the text of the last kind only. An index over these texts (a suffix automaton
   for words, a run-length BWT for bytes) tells for every window where else it occurs.
3. Slices take the answers in, mark the repeated windows of their documents and write the
   result.

Nothing is gathered by document or by passage: a slice sends a segment once however often it
has it, so a passage that a third of all documents share arrives as one entry per slice.
An anchor with more than ``HOT`` different contents isn't indexed in one place; its windows
are sent one by one as hashes to places of their own, which gives the same answer.
Answers are positional: they follow the order of a slice's entries.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F

from footfall.llm.anchors import byte_hashes, segments, word_grams
from footfall.llm.common import mixed, slices, utf8, word_hashes
from footfall.session import materialize

SLICE = 4 << 20        # text bytes of a slice, about
PER_SHARD = 48 << 20   # text bytes whose entries meet in one shard, about
HOT = 20_000           # different contents of an anchor that one index takes
LAST = np.iinfo(np.int64).max  # place in order of documents without an id

ONCE, SAME, MIXED, SPREAD = 0, 1, 2, 3  # what is known of an entry
ASKED = "slice long, shard int, kind int, blob binary"


def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
    return zstandard.compress(out.getvalue(), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.decompress(blob)
    source, out = io.BytesIO(data), []
    while source.tell() < len(data):
        out.append(np.lib.format.read_array(source, allow_pickle=False))
    return out


def record_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["slice", "shard", "kind", "blob"])


def packed_slices(docs: DataFrame, text: str, key: str, rule: Repeats) -> tuple[DataFrame, int]:
    """Table (slice, blob, entries, cuts), and the bytes of all texts: compressed record batches
    (id, text), the hashes that meet those of other slices, and the segments."""
    seen = Observation()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        waiting, size = [], 0

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            _, order, texts = opened(table)
            items = Items.of(texts, rule.words)
            if rule.words:
                table = pa.table({"id": table.column("id"), "text": pa.array(items.documents(), pa.binary())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table)
            cuts, key, content = rule.cut_items(order, items)
            entries = rule.entries(key, content, cuts.count, cuts.least)
            blobs = [sink.getvalue().to_pybytes(), entries, cuts.packed()]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([size], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs)],
                names=["slice", "size", "blob", "entries", "cuts"],
            )

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                here = part.column("text").nbytes
                if waiting and size + here > SLICE:
                    yield packed()
                    waiting, size, number = [], 0, number + 1
                waiting.append(part)
                size += here
        if waiting:
            yield packed()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(run, "slice long, size long, blob binary, entries binary, cuts binary").observe(seen, F.sum("size").alias("bytes"))
    return materialize(made, "repeat-slices", dealt_by="slice").drop("size"), 0 if (n := seen.get["bytes"]) is None else n


def opened(table: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """Ids, their places in order, and texts of a slice's documents."""
    ids = table.column("id").to_pylist()
    return ids, np.array([LAST if i is None else i for i in ids], np.int64), utf8(table.column("text"))


@dataclass(frozen=True)
class Items:
    """Documents end to end: their bytes, where each item starts and stops among them, and the
    documents' ends among the items. A word is followed by one space, which is no part of it."""

    data: np.ndarray
    start: np.ndarray | None  # None: every byte is an item
    stop: np.ndarray | None
    ends: np.ndarray

    @staticmethod
    def of(texts: list[bytes], words: bool) -> Items:
        if not words:
            return Items(np.frombuffer(b"".join(texts), np.uint8), None, None, np.cumsum([len(t) for t in texts], dtype=np.int64))
        data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        space = (data == 32) | (data - np.uint8(9) < 5)
        stay = ~space
        stay[1:] |= ~space[:-1]  # a word's bytes, and the first space after it
        bounds = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        ends = np.searchsorted(np.flatnonzero(space & stay), bounds)
        data, space = data[stay], space[stay]
        data[space] = 32
        return Items.laid(data, ends)

    @staticmethod
    def laid(data: np.ndarray, ends: np.ndarray) -> Items:
        """Of words that already are followed by one space each."""
        stop = np.flatnonzero(data == 32)
        return Items(data, np.concatenate([[0], stop[:-1] + 1])[: len(stop)], stop, ends)

    def documents(self) -> list[bytes]:
        data, at = self.data.tobytes(), np.concatenate([[0], self.stop + 1])[np.concatenate([[0], self.ends])].tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def span(self, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of the items from ``first`` up to ``stop`` (after it) begin and end."""
        return (first, stop) if self.start is None else (self.start[first], self.stop[stop - 1])


@dataclass(frozen=True)
class Cuts:
    """Documents laid end to end as items, cut into segments; distinct segments are entries, in sending order."""

    ends: np.ndarray           # per document, among the items
    first: np.ndarray          # per segment: its first and last window
    last: np.ndarray
    doc: np.ndarray
    entry: np.ndarray          # per segment: index of its entry
    by: np.ndarray             # segments in the order of their entries
    head: np.ndarray           # per entry: its first place in ``by``
    count: np.ndarray          # per entry: its segments here
    least: np.ndarray          # per entry: smallest id of a document that has it

    @staticmethod
    def of(order: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, entry: np.ndarray, by: np.ndarray) -> Cuts:
        doc = np.searchsorted(ends, first, side="right")
        count = np.bincount(entry) if len(entry) else np.zeros(0, np.int64)
        head = np.cumsum(count) - count
        least = np.minimum.reduceat(order[doc[by]], head) if len(head) else np.zeros(0, np.int64)
        return Cuts(ends, first, last, doc, entry, by, head, count, least)

    def packed(self) -> bytes:
        """Segments follow each other, so their places are kept as small steps."""
        steps = [np.diff(a, prepend=0).astype(np.uint32) for a in (self.ends, self.first)]
        return pack(*steps, (self.last - self.first).astype(np.uint32), self.entry.astype(np.uint32))

    @staticmethod
    def unpacked(blob: bytes, order: np.ndarray) -> Cuts:
        ends, first, span, entry = (a.astype(np.int64) for a in unpack(blob))
        first = np.cumsum(first)
        return Cuts.of(order, np.cumsum(ends), first, first + span, entry, np.argsort(entry, kind="stable"))

    @property
    def sample(self) -> np.ndarray:
        """Per entry one segment that has it."""
        return self.by[self.head]


class Slice:
    """One slice's documents, as written, and their cuts."""

    def __init__(self, blob: bytes, cuts: bytes, words: bool) -> None:
        self.ids, self.order, self.texts = opened(pa.ipc.open_stream(blob).read_all())
        self.cuts = Cuts.unpacked(cuts, self.order)
        self.items = Items.laid(np.frombuffer(b"".join(self.texts), np.uint8), self.cuts.ends) if words else Items.of(self.texts, False)

    def n_items(self, doc: int) -> int:
        return int(self.cuts.ends[doc] - (self.cuts.ends[doc - 1] if doc else 0))

    def kept(self, doc: int, gone: np.ndarray) -> bytes:
        """A document's words that are not ``gone``, joined by one space."""
        if not gone.any():
            return self.texts[doc][:-1]
        end = int(self.cuts.ends[doc])
        at = slice(end - len(gone), end)
        stay = np.repeat(~gone, self.items.stop[at] - self.items.start[at] + 1)
        return np.frombuffer(self.texts[doc], np.uint8)[stay].tobytes()[:-1]


_B = 0x9E3779B97F4A7C15 | 1
_BI = pow(_B, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _running(items: np.ndarray) -> np.ndarray:
    """Running polynomial sums over the items."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * _powers(len(items), _B)[:-1], dtype=np.uint64)])


def run_hashes(prefix: np.ndarray, inverse: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of the items from ``first`` up to ``stop``."""
    return mixed((prefix[stop] - prefix[first]) * inverse[first] + (stop - first).astype(np.uint64))


@dataclass(frozen=True)
class Repeats:
    """What repeats: ``length`` items in a row. ``words``: items are words, else bytes. ``ordered``: a
    window counts only where it also starts in a document with a smaller id, else anywhere else."""

    length: int
    gram: int
    words: bool
    ordered: bool
    hot: int = HOT

    def hashed(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the items and of the grams."""
        if self.words:
            words = word_hashes(items.data, items.start)
            return words, word_grams(words, self.gram)
        return mixed(items.data.astype(np.uint64) + np.uint64(977)), byte_hashes(items.data, self.gram)

    def cut(self, ids: list, order: np.ndarray, texts: list[bytes]) -> tuple[Cuts, np.ndarray, np.ndarray]:
        """Segments of documents, and per entry the hashes of its anchor and content."""
        return self.cut_items(order, Items.of(texts, self.words))

    def cut_items(self, order: np.ndarray, laid: Items) -> tuple[Cuts, np.ndarray, np.ndarray]:
        ends = laid.ends
        items, grams = self.hashed(laid)
        found = segments(grams, ends, self.length, self.gram)
        content = run_hashes(_running(items), _powers(len(items), _BI), found.first, found.last + self.length)
        key = mixed(found.key)
        by = np.lexsort((content, key))
        new = np.ones(len(by), bool)
        new[1:] = (key[by[1:]] != key[by[:-1]]) | (content[by[1:]] != content[by[:-1]])
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        return Cuts.of(order, ends, found.first, found.last, entry, by), key[by[new]], content[by[new]]

    # -- pass 1 -------------------------------------------------------------------

    def asked(self, rows: DataFrame, shards: int) -> DataFrame:
        """Per slice and shard the entries: hashes, counts and, if ordered, smallest ids."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, blob in zip(batch.column("slice").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                    parts = unpack(blob)
                    if out := [(number, p, 0, pack(*(x[a:b] for x in parts))) for p, a, b in stretches(place_of(parts[0], shards))]:
                        yield record_rows(out)

        return rows.select("slice", "entries").mapInArrow(run, ASKED)

    def entries(self, key: np.ndarray, content: np.ndarray, count: np.ndarray, least: np.ndarray) -> bytes:
        return pack(key, content, np.minimum(count, 2).astype(np.uint8), *([least] if self.ordered else []))

    def meet(self, rows: list[tuple[int, int, bytes]], answer: int, single: bool = False) -> list[tuple]:
        """Entries of one place brought together: what is known of each, the smallest ids of SAME ones and
        the anchors' numbers (here) of MIXED ones; ``single``: contents belong to their keys (windows)."""
        if not rows:
            return []
        parts = [unpack(b) for _, _, b in rows]
        sizes = [len(p[0]) for p in parts]
        key, content, count = (np.concatenate([p[i] for p in parts]) for i in range(3))
        least = np.concatenate([p[3] for p in parts]) if self.ordered else np.zeros(len(key), np.int64)
        by = np.lexsort((content, key))
        k, c = key[by], content[by]
        new_key = np.ones(len(by), bool)
        new_key[1:] = k[1:] != k[:-1]
        new_content = new_key.copy()
        new_content[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new_content if single else new_key) - 1
        heads = np.flatnonzero(new_content if single else new_key)
        total = np.add.reduceat(count[by].astype(np.int64), heads)
        contents = np.add.reduceat(new_content.astype(np.int64), heads)
        state = np.where(total < 2, ONCE, np.where(contents == 1, SAME, np.where(contents <= self.hot, MIXED, SPREAD))).astype(np.uint8)
        first = np.minimum.reduceat(least[by], heads)
        status, earliest, anchor = np.empty(len(by), np.uint8), np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        status[by], earliest[by], anchor[by] = state[group], first[group], group
        out, at = [], 0
        for (number, shard, _), n in zip(rows, sizes, strict=True):
            st = status[at : at + n]
            out.append((number, shard, answer, pack(st, anchor[at : at + n][st == MIXED], *([earliest[at : at + n][st == SAME]] if self.ordered else []))))
            at += n
        return out

    def answered(self, asked: DataFrame, shards: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if rows := self.meet([r[:2] + r[3:] for b in batches for r in tuples(b)], 0):
                yield record_rows(rows)

        return asked.repartition(shards, "shard").mapInArrow(run, ASKED)

    # -- pass 2 -------------------------------------------------------------------

    def texts(self, rows: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
        """What needs a closer look: texts of segments (kind 1), hashes of windows of hot anchors (kind 2)."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if left.num_rows == 0 or right.num_rows == 0:
                return pa.Table.from_batches([record_rows([])])
            known = Answers.of(right, 0)
            number, out = left.column("slice")[0].as_py(), []
            if not (known.status >= MIXED).any():
                return pa.Table.from_batches([record_rows([])])
            s = Slice(left.column("blob")[0].as_py(), left.column("cuts")[0].as_py(), self.words)
            c, sample = s.cuts, s.cuts.sample
            chosen = np.flatnonzero(known.status == MIXED)
            begin, end = s.items.span(c.first[sample[chosen]], c.last[sample[chosen]] + self.length)
            for p, a, b in stretches(known.shard[chosen]):
                at, lens = chosen[a:b], end[a:b] - begin[a:b]
                data = s.items.data[np.repeat(begin[a:b] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]
                out.append((number, p, 1, pack(at, known.anchor[at], np.minimum(c.count[at], 2).astype(np.uint8), c.least[at], lens, data)))
            if (known.status == SPREAD).any():
                w = self.windows(s, known.status, shards)
                out += [(number, p, 2, self.entries(w[1][a:b], w[2][a:b], w[3][a:b], w[4][a:b])) for p, a, b in stretches(w[0])]
            return pa.Table.from_batches([record_rows(out)])

        return rows.select("slice", "blob", "cuts").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, ASKED)

    def windows(self, s: Slice, status: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
        """Distinct windows of segments with hot anchors: shard, two hashes, count, smallest id; and per window its entry and place."""
        c = s.cuts
        items, grams = self.hashed(s.items)
        anchors = segments(grams, c.ends, self.length, self.gram).key
        at = np.flatnonzero(status[c.entry] == SPREAD)
        lens = c.last[at] - c.first[at] + 1
        place = np.repeat(c.first[at] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        doc = np.repeat(c.doc[at], lens)
        h = run_hashes(_running(items), _powers(len(items), _BI), place, place + self.length)
        other = np.repeat(anchors[at], lens)
        by = np.lexsort((other, h))
        new = np.ones(len(by), bool)
        new[1:] = (h[by[1:]] != h[by[:-1]]) | (other[by[1:]] != other[by[:-1]])
        head = np.flatnonzero(new)
        entry = np.empty(len(by), np.int64)
        entry[by] = np.cumsum(new) - 1
        one = by[head]
        least = np.minimum.reduceat(s.order[doc[by]], head)
        return place_of(h[one], shards), h[one], other[one], np.diff(np.append(head, len(by))), least, entry, place, doc

    def indexed(self, texts: DataFrame, shards: int, index: Callable) -> DataFrame:
        """Answers of the index (kind 1) and of the meeting windows (kind 2)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in tuples(b)]
            if out := self.meet([r[:2] + r[3:] for r in rows if r[2] == 2], 2, single=True):
                yield record_rows(out)
            if out := self._look_up([r for r in rows if r[2] == 1], index):
                yield record_rows(out)

        return texts.repartition(shards, "shard").mapInArrow(run, ASKED)

    def _look_up(self, rows: list[tuple], index: Callable) -> list[tuple]:
        groups: dict[tuple[int, int], dict[bytes, list]] = {}  # by shard and the anchor's number there
        asked = []
        for number, shard, _, blob in rows:
            at, key, count, least, lens, data = unpack(blob)
            data, stop = data.tobytes(), np.cumsum(lens)
            here = []
            for i, k, n, low, e, z in zip(at.tolist(), key.tolist(), count.tolist(), least.tolist(), stop.tolist(), lens.tolist(), strict=True):
                known = groups.setdefault((shard, k), {})
                text = data[e - z : e]
                if (own := known.get(text)) is None:
                    known[text] = own = [low, n, None]
                else:
                    own[0], own[1] = min(own[0], low), own[1] + n
                here.append((i, own))
            asked.append((number, shard, here))
        index([list(g.items()) for g in groups.values()], self.length)
        out = []
        for number, shard, here in asked:
            flat = [(i, a, b, first) for i, own in here for a, b, first in own[2]]
            if flat:
                columns = list(zip(*flat, strict=True))
                out.append((number, shard, 1, pack(*(np.array(c, np.int64) for c in columns))))
        return out

    # -- pass 3 -------------------------------------------------------------------

    def marked(self, s: Slice, answers: pa.Table, shards: int) -> np.ndarray:
        """Per item of the slice, whether it lies in a repeated window."""
        c = s.cuts
        cover = np.zeros((int(c.ends[-1]) if len(c.ends) else 0) + 1, np.int64)
        if answers.num_rows:
            known = Answers.of(answers, 0)
            same = np.flatnonzero(known.status[c.entry] == SAME)
            if self.ordered:
                same = same[known.first[c.entry[same]] < s.order[c.doc[same]]]
            _cover(cover, c.first[same], c.last[same] + self.length)
            if runs := [unpack(b) for _, b in _blobs(answers, 1)]:
                self._mark_runs(s, cover, *(np.concatenate(x) for x in zip(*runs, strict=True)))
            if _blobs(answers, 2):
                *_, entry, place, doc = self.windows(s, known.status, shards)
                told = Answers.of(answers, 2)
                hit = told.status[entry] == SAME
                if self.ordered:
                    hit &= told.first[entry] < s.order[doc]
                _cover(cover, place[hit], place[hit] + self.length)
        return np.cumsum(cover)[:-1] > 0

    def _mark_runs(self, s: Slice, cover: np.ndarray, entry: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> None:
        """Windows a to b (exclusive) of every segment with that entry, if its document comes after ``first``."""
        c = s.cuts
        n = c.count[entry]
        each = np.repeat(np.arange(len(entry)), n)
        seg = c.by[np.repeat(c.head[entry] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        if self.ordered:
            late = first[each] < s.order[c.doc[seg]]
            each, seg = each[late], seg[late]
        _cover(cover, c.first[seg] + a[each], c.first[seg] + b[each] - 1 + self.length)

    def finish(self, rows: DataFrame, answers: DataFrame, shards: int, schema: str, result: Callable) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            names = [f.split()[0] for f in schema.split(", ")]
            out = [[] for _ in names]
            for blob, cuts in zip(left.column("blob").to_pylist(), left.column("cuts").to_pylist(), strict=True):
                s = Slice(blob, cuts, self.words)
                gone = self.marked(s, right, shards)
                for i, key in enumerate(s.ids):
                    b = s.cuts.ends[i]
                    a = b - s.n_items(i)
                    for column, v in zip(out, (key, *result(s, i, gone[a:b])), strict=True):
                        column.append(v)
            kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            return pa.Table.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(out, schema.split(", "), strict=True)], names=names)

        return rows.select("slice", "blob", "cuts").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, schema)


def tuples(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in batch.columns), strict=True))


def stretches(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each stretch of equal values."""
    if not len(shard):
        return []
    cuts = np.flatnonzero(np.diff(shard)) + 1
    return [(int(shard[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True)]


def _cover(cover: np.ndarray, first: np.ndarray, stop: np.ndarray) -> None:
    np.add.at(cover, first, 1)
    np.subtract.at(cover, stop, 1)


def place_of(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash: hashes in ascending order have ascending shards, however many there are."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _blobs(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(shard, blob) of the answers of a kind, by shard: the order of the entries they answer."""
    at = np.flatnonzero(answers.column("kind").to_numpy() == kind)
    shard, blob = answers.column("shard").take(at).to_pylist(), answers.column("blob").take(at).to_pylist()
    return sorted(zip(shard, blob, strict=True), key=lambda x: x[0])


@dataclass(frozen=True)
class Answers:
    """What is known of a slice's entries."""

    shard: np.ndarray
    status: np.ndarray
    anchor: np.ndarray  # of MIXED ones, its number in the shard
    first: np.ndarray   # of SAME ones, the smallest id (if ordered)

    @staticmethod
    def of(answers: pa.Table, kind: int) -> Answers:
        parts = [(p, *unpack(b)) for p, b in _blobs(answers, kind)]
        status = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0, np.uint8)
        anchor, first = np.full(len(status), -1, np.int64), np.full(len(status), LAST, np.int64)
        if parts:
            anchor[status == MIXED] = np.concatenate([x[2] for x in parts])
            if len(parts[0]) > 3:
                first[status == SAME] = np.concatenate([x[3] for x in parts])
        shard = np.repeat(np.array([x[0] for x in parts], np.int64), [len(x[1]) for x in parts])
        return Answers(shard, status, anchor, first)


def find(docs: DataFrame, rule: Repeats, index: Callable, schema: str, result: Callable, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Run the three passes; ``result`` turns a slice, a document's place and its marks into a row after the id."""
    rows, size = packed_slices(docs, text, key, rule)
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PER_SHARD))
    answers = materialize(rule.answered(rule.asked(rows, shards), shards), "repeat-answers")
    looked = materialize(rule.indexed(rule.texts(rows, answers, shards), shards, index), "repeat-index")
    return rule.finish(rows, answers.unionByName(looked), shards, schema, result)
