"""Near-duplicates by an inverted join of MinHash signature coordinates.

A document is the set of its distinct shingles of ``words`` words (A-Z lower-cased; 2 if not given). Documents with equal
sets become one class. Each class has a signature of ``COORDINATES`` minima; it is posted under
(coordinate, value) pairs, classes that meet there are counted over the whole signature, and
pairs that agree in at least ``MATCHES`` coordinates are confirmed on the full sets.

* Prefix: two signatures that agree in T of K places share one of the K - T + 1 places that
  come first in any order common to all. The order is rarest first, so values that many
  documents share are hardly ever posted, and a class with K - T + 1 values of its own
  posts nothing.
* Lists with the same smallest class are merged together: a class is sent once to each such
  unit, with its set. Units of more than ``BLOCK`` classes are merged block against block.
* Skip: inside a merge, classes that are already linked to each other, however indirectly,
  are skipped, and only the links that join something are passed on (a spanning forest).
  Large groups of near copies so cost few comparisons and yield one link per class.
* At similarity 0.8 or more a pair agrees in fewer than 38 of 64 coordinates with probability
  below 5e-5. Sets travel as 48-bit hashes of their shingles.

Defined cases: texts without words (and null texts) have empty sets, are linked with nothing
and kept; a text of fewer words than a shingle has all of them as its only shingle; rows that share an id are one
document; rows without an id are linked by content and never name a component.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.common import WordHashes, gram_hashes, lower_words, mixed, slices, utf8
from footfall.llm.components import components
from footfall.session import materialize

COORDINATES = 64
MATCHES = 38
SLACK = 6                    # coordinates fewer that suffice inside a unit, whose signatures are other ones
SIMILAR = 80                 # per cent
BLOCK = 1024                 # classes of one side of a merge
BROADCAST_CLASSES = 1 << 20  # up to so many classes' units (some tens of bytes each) are broadcast, beyond that both sides are shuffled
_NO_ID = 1 << 62             # ids from here on stand for rows without an id

_TURNS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(texts: list[bytes], known: WordHashes, words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted distinct shingle hashes end to end, and the documents' ends."""
    found = [lower_words(t) for t in texts]
    counts = np.array([len(w) for w in found], np.int64)
    ends = np.cumsum(counts)
    h = known.of([x for w in found for x in w])
    doc = np.repeat(np.arange(len(texts)), counts)
    g = gram_hashes(h, words)
    first = doc[: len(g)]
    whole = first == doc[words - 1 :][: len(g)]
    g, d = [g[whole]], [first[whole]]
    for n in range(1, words):  # texts of n words
        short = np.flatnonzero(counts == n)
        at = (ends[short] - n)[:, None] + np.arange(n)
        own = h[at[:, 0]] if len(short) else np.zeros(0, np.uint64)
        for k in range(1, n):
            own = mixed(own) + h[at[:, k]]
        g.append(mixed(own ^ np.uint64(0x5851F42D4C957F2D) * np.uint64(n)))
        d.append(short)
    g, d = np.concatenate(g), np.concatenate(d)
    by = np.lexsort((g, d))
    g, d = g[by], d[by]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(len(texts)), side="right")


def profiles(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 2) -> DataFrame:
    """(doc_id, n_shingles, hi, lo: hashes of the set, signature) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                g, ends = shingle_sets(utf8(part.column("text")), known, words)
                n = np.diff(np.concatenate([[0], ends]))
                has = n > 0
                starts = (ends - n)[has]
                hi, lo = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                signatures = [None] * len(n)
                if has.any():
                    hi[has] = np.add.reduceat(mixed(g ^ np.uint64(0x2545F4914F6CDD1D)), starts).view(np.int64)
                    lo[has] = np.add.reduceat(mixed(g + np.uint64(0x632BE59BD9B4E019)), starts).view(np.int64)
                    for i, s in zip(np.flatnonzero(has), _signatures(g, starts), strict=True):
                        signatures[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi), pa.array(lo), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "hi", "lo", "signature"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, signature binary")


def posts(classes: DataFrame) -> DataFrame:
    """(token, node) for every signature coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            node = np.repeat(batch.column("node").to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array((values + place).ravel()), pa.array(node)], names=["token", "node"])

    return classes.select("node", "signature").mapInArrow(run, "token long, node long")


def prefix_posts(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Posts of each class's rarest K - T + 1 coordinates, as far as another class has them too."""
    every = posts(classes)
    shared = materialize(every.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-tokens")
    ranked = every.join(shared, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    # a class's own values come first in the order; at most COORDINATES entries a class
    most = F.greatest(F.lit(0), F.size("t") - (matches - 1))
    return materialize(ranked.select("node", F.explode(F.slice("t", F.lit(1), most)).alias("x")).select("x.token", "node"), "near-posts")


def units(posted: DataFrame) -> DataFrame:
    """(node, leaders): the smallest classes of the lists that a class is on, itself included where it is one."""
    first = posted.groupBy("token").agg(F.min("node").alias("leader"))
    met = posted.join(materialize(first, "near-firsts"), "token").select("node", "leader").distinct()
    return materialize(met.groupBy("node").agg(F.collect_list("leader").alias("leaders")), "near-units")  # at most one leader a coordinate


def packed_set(g: np.ndarray) -> bytes:
    """Six bytes a shingle, sorted."""
    low = np.sort(g & np.uint64((1 << 48) - 1))
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _signatures(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum.reduceat(g * t, starts) >> np.uint64(32) for t in _TURNS], axis=1).astype(np.uint32)


def block_pairs(met: DataFrame, block: int) -> DataFrame:
    """(leader, p, q, part, node): each class of a unit for every pair of blocks that its own block is in."""
    each = met.select("node", F.explode("leaders").alias("leader"))
    sizes = each.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    big = materialize(sizes.select("leader", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts")), "near-large")
    each = each.join(big, "leader", "left").fillna({"parts": 1})
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return each.withColumn("part", part).withColumn("_q", other).select(
        "leader", F.least("part", "_q").alias("p"), F.greatest("part", "_q").alias("q"), "part", "node"
    )


def _units_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (leader, p, q) in turn, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_unit(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "leader", "p", "q").sortWithinPartitions("leader", "p", "q", "node")


def partnered(rows: list[tuple], matches: int) -> np.ndarray:
    """Which of a unit's rows (.., part, node, signature) agree in enough coordinates with one of the other block."""
    p, q = rows[0][1], rows[0][2]
    part = np.array([r[3] for r in rows])
    sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(-1, COORDINATES)
    left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
    out = np.zeros(len(rows), bool)
    for a in range(0, len(left), 128):
        at = left[a : a + 128]
        agree = (sig[at][:, None, :] == sig[right][None, :, :]).sum(axis=2) >= matches
        agree &= at[:, None] != right[None, :]
        out[at] |= agree.any(axis=1)
        out[right] |= agree.any(axis=0)
    return out


def agreeing(pairs: DataFrame, classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The rows of ``block_pairs`` whose signature agrees with another's of the unit; only their sets are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        for rows in _units_of(batches):
            kept = [r for r, good in zip(rows, partnered(rows, matches), strict=True) if good]
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], k) for i, k in enumerate(kinds)], names=["leader", "p", "q", "part", "node"])

    rows = pairs.join(classes.select("node", "signature"), "node").select("leader", "p", "q", "part", "node", "signature")
    return _by_unit(rows).mapInArrow(run, "leader long, p int, q int, part int, node long")


def members(docs: DataFrame, pairs: DataFrame, text: str, key: str, words: int = 2) -> DataFrame:
    """``pairs`` with each class's set, made from the text that names the class."""
    to = pairs.groupBy("node").agg(F.collect_list(F.struct("leader", "p", "q", "part")).alias("to"))  # block pairs of one class's units
    to = materialize(to, "near-to")
    few = to.count() <= BROADCAST_CLASSES
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("text"))
    rows = texts.join(F.broadcast(to) if few else to, "node")
    return rows.mapInArrow(functools.partial(_members, words=words), "leader long, p int, q int, part int, node long, shingles binary")


def _members(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    names = ["leader", "p", "q", "part", "node", "shingles"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    for batch in batches:
        for piece in slices(batch, "text"):
            g, ends = shingle_sets(utf8(piece.column("text")), known, words)
            starts = np.concatenate([[0], ends[:-1]])
            out = []
            for node, to, a, b in zip(piece.column("node").to_pylist(), piece.column("to").to_pylist(), starts, ends, strict=True):
                packed = packed_set(g[a:b])
                out += [(x["leader"], x["p"], x["q"], x["part"], node, packed) for x in to]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


class Unit:
    """Classes that are merged together: their sets as one inverted index, and what is linked so far."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)
        values, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        by = np.argsort(self.ids, kind="stable")
        self.owners = self.owner[by]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=len(values)))])
        self.ends = np.cumsum(self.sizes)
        self.label = np.arange(len(sets))
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        self.signature = _signatures(mixed(flat), self.ends - self.sizes)

    def shared(self, i: int) -> np.ndarray:
        """Common shingles of class i with every class."""
        own = self.ids[self.ends[i] - self.sizes[i] : self.ends[i]]
        n = self.starts[own + 1] - self.starts[own]
        at = np.repeat(self.starts[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.owners[at], minlength=len(self.sizes))

    def link(self, i: int, others: np.ndarray, matches: int) -> list[int]:
        """Those of ``others`` that a link to class i joins to something new."""
        may = others[self.label[others] != self.label[i]]
        n = self.sizes
        may = may[np.minimum(n[may], n[i]) * 100 >= np.maximum(n[may], n[i]) * SIMILAR]
        may = may[(self.signature[may] == self.signature[i]).sum(axis=1) >= matches]
        if not len(may):
            return []
        both = self.shared(i)[may]
        out = []
        for j in may[100 * both >= SIMILAR * (n[may] + n[i] - both)]:
            if self.label[j] != self.label[i]:
                self.label[self.label == self.label[j]] = self.label[i]
                out.append(int(j))
        return out


def merge(rows: list[tuple], matches: int = MATCHES) -> list[tuple[int, int]]:
    """Links of one unit's two blocks (or of a block with itself) that join something."""
    p, q = rows[0][1], rows[0][2]
    node, part = [r[4] for r in rows], np.array([r[3] for r in rows])
    unit = Unit([unpacked_set(r[5]) for r in rows])
    left, right = np.flatnonzero(part == p), np.flatnonzero(part == q)
    return [(min(node[i], node[j]), max(node[i], node[j])) for i in left for j in unit.link(i, right[right > i] if p == q else right, matches)]


def links(sent: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Links (a, b) of all units: at most one less than it has classes for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _units_of(batches):
            if len(rows) > 1 and (found := merge(rows, matches - SLACK)):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_unit(sent).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", matches: int = MATCHES, block: int = BLOCK, words: int = 2
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    rows = materialize(profiles(docs, text, key, words), "near-profiles")
    node = F.coalesce("doc_id", F.lit(_NO_ID) + F.pmod(F.col("hi"), F.lit(1 << 61)))
    sets = rows.where("n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(F.min(node).alias("node"), F.min("signature").alias("signature"))
    sets = materialize(sets, "near-classes")
    classes = sets.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")) if _repeats(sets) else sets
    met = units(prefix_posts(classes, matches))
    sent = members(docs, agreeing(block_pairs(met, block), classes, matches), text, key, words)
    labels = components(materialize(links(sent, matches), "near-links"))
    member = sets.select("hi", "lo", F.col("n_shingles").alias("_n"), "node").join(labels, "node", "left").select(
        F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "_n", F.coalesce("component", "node").alias("_component")
    )
    out = rows.join(member, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")) & (F.col("n_shingles") == F.col("_n")), "left")
    found = F.coalesce(F.when(F.col("_component") < _NO_ID, F.col("_component")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), _kept(found).alias("kept"))


def _kept(component: Column) -> Column:
    return component.eqNullSafe(F.col("doc_id"))


def _repeats(sets: DataFrame) -> bool:
    """Whether one id names several sets (rows that share an id)."""
    return bool(sets.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count())


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 2) -> DataFrame:
    """One document of each component (the one with the smallest id), one row of rows that repeat; columns as in ``docs``."""
    kept = near_duplicates(docs, text, key, words=words).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    left = docs.join(kept, F.col(key).cast("long").eqNullSafe(F.col("_kept"))).drop("_kept")
    again = left.withColumn("_same", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("#"), F.xxhash64(text).cast("string"))))
    return again.dropDuplicates(["_same"]).drop("_same")
