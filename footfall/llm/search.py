"""Ranked lexical search over an inverted index in segments, term- and document-at-a-time combined.

* ``index``: every text becomes part of a segment of about ``SEGMENT_BYTES`` of text. A segment has one
  row for its documents (term null) and one a term, with its documents (numbered in id order) and counts.
* ``search``: queries are taken in blocks of bounded size. The lists of a block's terms meet by
  segment, and each segment gives each query's ``k`` best documents:

  - a query's short lists are summed term-at-a-time into accumulators, which from then on are one
    iterator with a known largest value, beside the iterators of the long lists;
  - windows of documents are visited in order, all iterators together. A window whose largest values
    don't reach the k-th score so far is skipped. In any other, documents come from those iterators
    without which that score can't be reached; the rest is only looked up where it still matters.

  The k best of all segments are ranked at the end, after a top k in each task.

Bounds are sums of true maxima, and only documents strictly below the k-th score are left out, so
results are exact. Scores are whole numbers.

Defined cases: null and termless texts have no terms, count as no document and are never found, and such
queries find nothing; each row is a document or query of its own, rows that repeat included; of equal
scores the smaller id is first, rows without an id last; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from footfall.llm.common import SLICE_BYTES, slices, utf8
from footfall.session import materialize

BEST = 50
SEGMENT_BYTES = 32 << 20  # text of one segment
BLOCK_BYTES = 1 << 20     # terms of the queries of one block
WINDOW = 2048             # documents visited together
SHORT = 8                 # a list is short if no more than one document in so many is on it
FIELDS = ("segment", "term", "holding", "total", "docs", "counts")
INDEX = "segment long, term string, holding long, total long, docs binary, counts binary"

_TERM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII; A-Z lower-cased."""
    return text.translate(_TERM).split()


def _binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Binary values that end where the next one starts."""
    ends = np.append(starts, len(values)).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class Segment:
    """Documents taken in piece by piece; ``rows`` are their part of the index."""

    def __init__(self) -> None:
        self.bytes, self.known = 0, {}
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []  # term << 32 | document, count

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        found = [terms(t) for t in texts]
        sizes = np.array([len(w) for w in found], np.int64)
        known = self.known
        numbers = np.fromiter((known.setdefault(w, len(known)) for words in found for w in words), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)) + len(self.ids), sizes)
        self.pairs.append(np.unique(numbers << 32 | doc, return_counts=True))
        self.sizes.append(sizes)
        self.ids += ids
        self.bytes += sum(map(len, texts))

    def rows(self, segment: int) -> Iterator[pa.RecordBatch]:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.concatenate(self.sizes)[order]
        ids = np.array([self.ids[i] for i in order if self.ids[i] is not None], np.int64)  # those without an id are last
        pair, count = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
        pair = pair >> 32 << 32 | place[pair & 0xFFFFFFFF]
        by = np.argsort(pair)
        term, docs, count = pair[by] >> 32, (pair[by] & 0xFFFFFFFF).astype(np.int32), count[by].astype(np.int32)
        starts = np.searchsorted(term, np.arange(len(self.known)))
        yield pa.RecordBatch.from_arrays([
            pa.array([segment]), pa.array([None], pa.string()), pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())]),
            pa.array([ids.tobytes()], pa.binary()), pa.array([sizes.tobytes()], pa.binary()),
        ], names=list(FIELDS))
        if len(starts):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(starts), segment)), pa.array(list(self.known), pa.binary()).cast(pa.string()),
                pa.array(np.diff(np.append(starts, len(term)))), pa.array(np.add.reduceat(count.astype(np.int64), starts)),
                _binary(docs, starts), _binary(count, starts),
            ], names=list(FIELDS))


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number, own = TaskContext.get().partitionId() << 32, Segment()
    for batch in batches:
        for part in slices(batch, "text", min(SLICE_BYTES, most)):
            own.add(part.column("doc_id").to_pylist(), utf8(part.column("text")))
            if own.bytes >= most:
                yield from own.rows(number)
                number, own = number + 1, Segment()
    if own.ids:
        yield from own.rows(number)


def index(docs: DataFrame, text: str = "text", key: str = "doc_id", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The inverted index of ``docs`` (columns of ``INDEX``), written."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInArrow(functools.partial(_segments, most=segment_bytes), INDEX), "search-index")


def best(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``k`` highest sums over ``lists`` (documents ascending, gains above 0) of ``size`` documents."""
    short = [x for x in lists if len(x[0]) * SHORT <= size]
    runs = [x for x in lists if len(x[0]) * SHORT > size]
    if short:
        docs, gains = (np.concatenate(x) for x in zip(*short, strict=True))
        by = np.argsort(docs, kind="stable")
        docs, gains = docs[by], gains[by]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        runs.append((docs[first], np.add.reduceat(gains, first)))
    runs.sort(key=lambda x: int(x[1].max()))
    floor = max([1, *(int(np.partition(g, len(g) - k)[len(g) - k]) for _, g in runs if len(g) >= k)])
    edges = np.arange(0, size + window, window)
    cuts = [np.searchsorted(d, edges) for d, _ in runs]
    most = np.zeros((len(runs), len(edges) - 1), np.int64)  # by iterator and window
    for i, ((_, g), cut) in enumerate(zip(runs, cuts, strict=True)):
        full = cut[1:] > cut[:-1]
        most[i, full] = np.maximum.reduceat(g, cut[:-1][full])
    upto = np.cumsum(most, axis=0)  # what the first iterators together can give
    found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for w in range(len(edges) - 1):
        if upto[-1, w] < floor:
            continue
        needed = int(np.searchsorted(upto[:, w], floor))  # those before it can't reach the k-th score
        sums = np.zeros(window, np.int64)
        for (d, g), cut in zip(runs[needed:], cuts[needed:], strict=True):
            own = slice(cut[w], cut[w + 1])
            sums[d[own] - edges[w]] += g[own]
        hit = np.flatnonzero(sums)
        for i in range(needed - 1, -1, -1):
            hit = hit[sums[hit] + upto[i, w] >= floor]
            if not len(hit):
                break
            (d, g), a, b = runs[i], cuts[i][w], cuts[i][w + 1]
            if a < b:
                at = np.minimum(a + np.searchsorted(d[a:b], hit + edges[w]), b - 1)
                there = d[at] == hit + edges[w]
                sums[hit[there]] += g[at[there]]
        hit = hit[sums[hit] >= floor]
        found, scores = np.append(found, hit + edges[w]), np.append(scores, sums[hit])
        if len(found) >= k:
            top = np.lexsort((found, -scores))[:k]
            found, scores = found[top], scores[top]
            floor = max(floor, int(scores[-1]))
    top = np.lexsort((found, -scores))[:k]
    return found[top], scores[top]


def _of_segment(table: pa.Table, asked: list[list[str]], n: int, length: int, k: int) -> pa.Table:
    """Each query's best documents of one segment."""
    rows = table.select(["term", "w", "docs", "counts"]).to_pylist()
    own = next(r for r in rows if r["term"] is None)
    ids, sizes = np.frombuffer(own["docs"], np.int64), np.frombuffer(own["counts"], np.int64)
    slow = 20 * (50 + 50 * sizes * n // length)
    lists = {}
    for r in rows:
        if r["term"] is not None and r["w"] > 0:
            docs, tf = np.frombuffer(r["docs"], np.int32).astype(np.int64), np.frombuffer(r["counts"], np.int32).astype(np.int64)
            gains = r["w"] * (1_000_000_000 * tf // (1000 * tf + slow[docs]))
            lists[r["term"]] = docs[gains > 0], gains[gains > 0]
    query, doc, score = [], [], []
    for q, names in enumerate(asked):
        if have := [lists[t] for t in names if t in lists and len(lists[t][0])]:
            d, s = best(have, len(sizes), k)
            query += [q] * len(d)
            doc += [int(ids[x]) if x < len(ids) else None for x in d]
            score += s.tolist()
    return pa.table({"query": pa.array(query, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})


def _blocks(queries: DataFrame, key: str, text: str, most: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and terms of the queries, in blocks of bounded size; the driver holds one of them."""
    ids, asked, held = [], [], 0
    for row in queries.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).toLocalIterator():
        ids.append(row.id)
        asked.append(sorted({t.decode() for t in terms((row.text or "").encode())}))
        held += 64 + sum(map(len, asked[-1]))
        if held >= most:
            yield ids, asked
            ids, asked, held = [], [], 0
    if ids:
        yield ids, asked


def weight(n: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (2.0 * df + 1))).cast("long")


def _search_block(spark: SparkSession, table: DataFrame, asked: list[list[str]], n: int, length: int, k: int) -> DataFrame:
    words = sorted(set().union(*asked))
    lists = table.join(F.broadcast(spark.createDataFrame([(w,) for w in words], "term string")), "term")  # bounded by the block
    df = lists.groupBy("term").agg(weight(n, F.sum("holding")).alias("w"))
    lists = lists.join(F.broadcast(df), "term").select("segment", "term", "w", "docs", "counts")
    both = lists.union(table.where("term IS NULL").select("segment", "term", F.lit(0).cast("long"), "docs", "counts"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def found(rows: pa.Table) -> pa.Table:
        return _of_segment(rows, asked, n, length, k)

    return both.repartition(parts, "segment").groupBy("segment").applyInArrow(found, "query int, doc_id long, score long")


def search(
    table: DataFrame, queries: DataFrame, k: int = BEST, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(``key``, rank, doc_id, score): the ``k`` best documents of the index ``table`` for each row of ``queries``."""
    spark = table.sparkSession
    kind = queries.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    whole = table.where("term IS NULL").agg(F.sum("holding").alias("n"), F.sum("total").alias("length")).first()
    out = []
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    for ids, asked in _blocks(queries, key, text, block_bytes) if whole.n else ():
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query", T.IntegerType()), schema[key]]))
        if any(asked):
            found = _search_block(spark, table, asked, whole.n, whole.length, k)
            ranked = found.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "query")
            out.append(materialize(ranked.select(key, "rank", "doc_id", "score"), "search-found"))
    return functools.reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema)
