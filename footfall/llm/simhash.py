"""Near-duplicates by SimHash fingerprints, found with the generalised pigeonhole principle.

A fingerprint bit is 1 if more than half of a text's shingle hashes have it. Equal fingerprints are one
class; classes whose fingerprints differ in at most ``DISTANCE`` bits are linked.

* Layout: bits whose values go together over all fingerprints (largest correlation) become one of 2 to 4
  parts; the number of parts is the one that promises least work at this number of fingerprints.
* Thresholds: two fingerprints within distance D agree within t_i bits in some part i whenever the sum of
  all t_i + 1 is D + 1 (a part with t_i = -1 is not looked at). Each fingerprint takes the thresholds that
  a dynamic program over parts finds to be cheapest by its estimated numbers of candidates; these come
  from how often each half of a part's value occurs.
* Probing: every fingerprint stands in the bucket of each of its parts, and asks in those buckets that lie
  within its thresholds. What meets is verified on all bits.
* A bucket of more than ``LARGE`` fingerprints is dropped if none asks there, else it is parted again by the bits that it doesn't fix (pigeonhole
  on these, recursively), so that groups of very many close fingerprints don't meet all at once. When
  11 bits are left, no more than 2,048 different fingerprints can meet.
* Inside a bucket links are passed on as a spanning forest, at most one a fingerprint.

Defined cases: a text of one or two words is one shingle; null, empty and wordless texts have fingerprint
zero and are linked like any other; rows that share an id are linked through their own fingerprints and
named alike by their smallest id; rows without an id take part in links and never name a component (null
if no row of it has an id).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from footfall.llm.common import lower_words, mixed, slices, utf8
from footfall.llm.components import components
from footfall.operators.keyed import attach, settle
from footfall.session import materialize

DISTANCE = 3
WORDS = 3
SEED = 42
LARGE = 2048  # fingerprints that meet in one bucket without being parted again
SMALL = 16    # buckets up to this size are compared row against row, many at once
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _hashes(words: list[bytes], n: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(b" ".join(words), SEED)] if words else []
    whole = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    return [digest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprint(words: list[bytes], n: int = WORDS, most: int = 1 << 18) -> int:
    h = np.array(_hashes(words, n), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), most):
        ones += np.unpackbits(h[a : a + most].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(BITS[2 * ones > len(h)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint: 64 bits as a signed long) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([fingerprint(lower_words(t), words) for t in utf8(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def _both_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, as one row of 64 x 64 counts a task."""
    both = np.zeros((64, 64), np.int64)
    for batch in batches:
        f = batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64)
        bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        both += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(range(4096), pa.int32()), pa.array(both.ravel())], names=["cell", "n"])


def parts_of(correlation: np.ndarray, parts: int) -> list[np.uint64]:
    """Masks of ``parts`` groups of bits; each starts with the bit most correlated to others and takes those closest to it."""
    free, masks = list(range(64)), []
    for p in range(parts):
        size = len(free) // (parts - p)
        strength = correlation[np.ix_(free, free)]
        group = [free[int(strength.sum(axis=1).argmax())]]
        free.remove(group[0])
        while len(group) < size:
            near = free[int(correlation[np.ix_(free, group)].sum(axis=1).argmax())]
            group.append(near)
            free.remove(near)
        masks.append(BITS[group].sum(dtype=np.uint64))
    return masks


def part_count(n: int) -> int:
    """Number of parts with the least expected probes and candidates for ``n`` fingerprints with even bits."""
    work = {4: 4 * (1 + n / 2**16), 3: 24 * (1 + n / 2**21.33), 2: 66 * (1 + n / 2**32)}
    return min(work, key=work.get)


def bits_of(mask: np.uint64) -> np.ndarray:
    return np.flatnonzero(BITS & mask)


def halves(mask: np.uint64) -> tuple[np.uint64, np.uint64]:
    own = BITS[bits_of(mask)]
    return own[: len(own) // 2].sum(dtype=np.uint64), own[len(own) // 2 :].sum(dtype=np.uint64)


class Estimate:
    """Expected number of fingerprints with a part's value, from the counts of its two halves' values."""

    def __init__(self, n: int, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.n, self.counts = max(n, 1), counts  # by half mask: values ascending, counts

    def of(self, masked: np.ndarray, mask: np.uint64) -> np.ndarray:
        out = np.full(len(masked), 1.0 / self.n)
        for half in halves(mask):
            values, n = self.counts[int(half)]
            at = np.minimum(np.searchsorted(values, masked & half), len(values) - 1)
            out *= np.where(values[at] == masked & half, n[at], 0)
        return out


def thresholds(costs: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Cheapest thresholds t (rows x parts) with the sum of t + 1 equal to ``distance`` + 1.

    ``costs[:, i, t]`` is the cost of t + 1 = 0, 1, .. in part i. Ties go to smaller thresholds in earlier parts.
    """
    rows, parts, kinds = costs.shape
    slots = distance + 1
    best = np.full((parts + 1, rows, slots + 1), np.inf)
    best[parts, :, 0] = 0
    choice = np.zeros((parts, rows, slots + 1), np.int64)
    for i in range(parts - 1, -1, -1):
        for s in range(slots + 1):
            options = np.stack([costs[:, i, t] + best[i + 1, :, s - t] if t <= s else np.full(rows, np.inf) for t in range(kinds)], axis=1)
            choice[i, :, s] = options.argmin(axis=1)
            best[i, :, s] = options.min(axis=1)
    out, left = np.zeros((rows, parts), np.int64), np.full(rows, slots)
    for i in range(parts):
        out[:, i] = choice[i, np.arange(rows), left]
        left -= out[:, i]
    return out - 1


def bucket_key(masked: np.ndarray, mask: np.ndarray | np.uint64, above: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    """Name of a bucket; names that collide only bring more together, which verification sorts out."""
    return mixed(mixed(masked) ^ mixed(np.atleast_1d(mask)) * np.uint64(3) ^ above)


def _probe(batches: Iterator[pa.RecordBatch], masks: list[np.uint64], estimate: Estimate) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1 << 12):
            f = batch.column("fingerprint").slice(a, 1 << 12).to_numpy(zero_copy_only=False).view(np.uint64)
            costs = np.zeros((len(f), len(masks), 3))
            for i, mask in enumerate(masks):
                own = f & mask
                costs[:, i, 1] = 1 + estimate.of(own, mask)
                costs[:, i, 2] = costs[:, i, 1] + sum(1 + estimate.of(own ^ BITS[b], mask) for b in bits_of(mask))
            t = thresholds(costs)
            out = []  # key, fingerprint, mask, asks, stands
            for i, mask in enumerate(masks):
                own, wide = f & mask, f[t[:, i] == 1]
                out.append((bucket_key(own, mask), f, mask, t[:, i] >= 0, np.ones(len(f), bool)))
                for b in bits_of(mask) if len(wide) else ():
                    out.append((bucket_key((wide & mask) ^ BITS[b], mask), wide, mask, np.ones(len(wide), bool), np.zeros(len(wide), bool)))
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    key, f, _, asks, stands = (np.concatenate([r[i] for r in out]) if i != 2 else None for i in range(5))
    mask = np.concatenate([np.full(len(r[1]), r[2], np.uint64) for r in out])
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(f.view(np.int64)), pa.array(mask.view(np.int64)), pa.array(asks), pa.array(stands)],
        names=["key", "fingerprint", "mask", "asks", "stands"],
    )


BUCKETS = "key long, fingerprint long, mask long, asks boolean, stands boolean"


def _part_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets, once for each of four parts of the bits that their bucket leaves open."""
    for batch in batches:
        key, f, mask = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fingerprint", "mask"))
        asks, stands = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "stands"))
        out = []
        for m in np.unique(mask):
            at = np.flatnonzero(mask == m)
            free = bits_of(~m)
            for p in range(DISTANCE + 1):
                part = BITS[free[p :: DISTANCE + 1]].sum(dtype=np.uint64)
                out.append((bucket_key(f[at] & part, part, key[at]), f[at], m | part, asks[at], stands[at]))
        if out:
            yield _rows(out)


def _forest(f: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of different fingerprints as a spanning forest: each newly reached one is compared with those not yet reached."""
    left, out = np.unique(f), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                out += [(x, y) for y in left[near]]
                queue += list(left[near])
                left = left[~near]
    return out


def _pairs(f: np.ndarray, key: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Links between rows of the same key (rows are sorted by it): small buckets by shifted comparison, others by search."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    rank = np.repeat(sizes, sizes) <= SMALL
    for shift in range(1, min(SMALL, len(key))):
        near = (key[shift:] == key[:-shift]) & rank[shift:] & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= distance) & (f[shift:] != f[:-shift])
        if near.any():
            yield np.stack([f[:-shift][near], f[shift:][near]])
    for a, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        if links := _forest(f[a : a + n], distance):
            yield np.array(links, np.uint64).T


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets from rows sorted by key; the bucket at a batch's end waits for the next batch."""

    def of(key: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for pair in _pairs(f, key, distance):
            a, b = pair.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    key, f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.append(key, batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64))
        f = np.append(f, batch.column("fingerprint").to_numpy(zero_copy_only=False).view(np.uint64))
        whole = int((key == key[-1]).argmax()) if len(key) else 0
        yield from of(key[:whole], f[:whole])
        key, f = key[whole:], f[whole:]
    yield from of(key, f)


def _buckets(classes: DataFrame, n: int, parts: int | None) -> DataFrame:
    """Each fingerprint's rows in the buckets where it stands or asks."""
    cells = classes.select("fingerprint").mapInArrow(_both_set, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    both = np.zeros(4096)
    for row in cells.collect():  # 64 x 64 counts
        both[row.cell] = row.n
    both = both.reshape(64, 64) / max(n, 1)
    mean = both.diagonal()
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    masks = parts_of(np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread)), parts or part_count(n))
    half = [int(h) for mask in masks for h in halves(mask)]
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("half"), F.col("fingerprint").bitwiseAND(F.lit(_signed(h))).alias("value")) for k, h in enumerate(half)]))
    counts: dict[int, list] = {h: [] for h in half}
    for row in classes.select(value.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).collect():  # 2^16 values at most in each half
        counts[half[row.x.half]].append((row.x.value & 0xFFFFFFFFFFFFFFFF, row.n))
    sorted_counts = {h: tuple(np.array(x, np.uint64) for x in zip(*sorted(rows), strict=True)) for h, rows in counts.items() if rows}
    run = functools.partial(_probe, masks=masks, estimate=Estimate(n, {h: (v, c.astype(np.float64)) for h, (v, c) in sorted_counts.items()}))
    return classes.select("fingerprint").mapInArrow(run, BUCKETS)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(classes: DataFrame, n: int, parts: int | None = None, large: int = LARGE, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that join every two of ``n`` different fingerprints within ``distance`` bits, directly or through others."""
    shuffles = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, found = materialize(_buckets(classes, n, parts), "simhash-buckets"), []
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("a"), F.max("stands").alias("s"))
        big = settle(sizes.where(F.col("n") > large).select("key", (F.col("a") & F.col("s")).alias("asked")), "simhash-large")
        marked = attach(rows, big, ["key"], "left") if big.rows else rows.withColumn("asked", F.lit(None).cast("boolean"))
        again = F.coalesce("asked", F.lit(False)) & (F.bit_count("mask") < 64 - 11)
        sent = marked.where(F.coalesce("asked", F.lit(True)) & ~again).select("key", "fingerprint").repartition(shuffles, "key").sortWithinPartitions("key")
        found.append(materialize(sent.mapInArrow(functools.partial(_links, distance=distance), "a long, b long"), "simhash-links"))
        if not big.rows:
            return functools.reduce(DataFrame.union, found)
        rows = materialize(marked.where(again).drop("asked").mapInArrow(_part_again, BUCKETS), "simhash-buckets")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, parts: int | None = None, large: int = LARGE
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``."""
    rows = materialize(fingerprints(docs, text, key, words), "simhash-prints")
    same = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = settle(same, "simhash-classes")
    labels = components(materialize(links(classes.df, classes.rows, parts, large), "simhash-links"))
    named = classes.df.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = materialize(named, "simhash-named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    first = settle(first, "simhash-first").with_hot("classes", ("component",))
    whole = attach(named, first.of(first.df.drop("classes")), ["component"], spread=["fingerprint"]).select("fingerprint", "component_id", "n")
    whole = settle(whole, "simhash-whole").with_hot("n", ("fingerprint",))
    out = attach(rows, whole.of(whole.df.drop("n")), ["fingerprint"], spread=["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
