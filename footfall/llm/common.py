"""Small helpers shared by the training-data operators.

Words are maximal runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``). That is what
``bytes.split()`` yields on UTF-8, so Python code splits encoded texts and SQL uses ``WORD``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 8 << 20  # text handled at once inside a task
KNOWN_WORDS = 400_000  # entries of a worker's word tables; a full table is emptied

_T = TypeVar("_T")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(data: bytes) -> bytes:
    return data.translate(_LOWER)


def lower_words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as bytes; null counts as the empty text."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts together hold about ``most`` bytes, one text at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


_tables: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], _T]) -> _T:
    """What a worker keeps under ``name`` between tasks. Workers outlive a step of a job, so what others kept there goes."""
    for other in [k for k in _tables if k != name]:
        del _tables[other]
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


class WordHashes:
    """64-bit hashes of words, with a table so that each frequent word is hashed once."""

    def __init__(self, most: int = KNOWN_WORDS) -> None:
        self.most, self.known = most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.most:
            known.clear()
        out = list(map(known.get, words))
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    w = words[i]
                    h = known.get(w)
                    if h is None:
                        known[w] = h = digest(w)
                    out[i] = h
        return np.array(out, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (bijective)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


LONG = 4096           # bytes of a word (with its space) that is hashed by itself
HASHED = 1 << 18      # bytes of words hashed at once
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = mixed(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """64-bit hash of each word of ``data``, in which every word (they begin at ``start``) is followed by one space:
    sums of random values of its bytes and of the space, each times an odd random factor of its place in the word."""
    out, size = np.empty(len(start), np.uint64), np.diff(start, append=len(data))
    long = np.flatnonzero(size > LONG)
    cuts = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), HASHED)), long, long + 1, [0, len(start)]])).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        at, n = int(start[a]), size[a:b]
        part = data[at : at + int(n.sum())]
        if n[0] > LONG:
            out[a] = xxhash.xxh3_64_intdigest(part)
            continue
        h = _PLACE[np.arange(len(part)) - np.repeat(start[a:b] - at, n)]
        h *= _BYTE[part]
        out[a:b] = np.add.reduceat(h, start[a:b] - at)
    return mixed(out)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` items that start at each place; shorter than ``h`` by n - 1 (none if too short)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out += h[k : k + len(out)]
    return mixed(out)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(fn, schema)
