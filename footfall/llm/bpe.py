"""Byte-pair encoding by forced boundaries.

A merge joins two neighbouring bytes into one token, so a pair of neighbouring bytes that
occurs inside no vocabulary token can never be joined: every such place is a certain cut.
Texts are cut at white space (which occurs in no token), then at all forced boundaries;
the fragments are encoded independently of each other, each distinct one once per worker,
and the results are concatenated. No fragment's result depends on its neighbours, so the
outcome equals that of encoding the text as a whole.

Defined cases: a null text counts as empty; the empty text has no tokens and decodes to the
empty text; special tokens written in a text are encoded as such, as the tokenizers library
does; runs of any length without white space are encoded in O(n log n); repeated rows are
encoded each; further columns are passed through where the caller names them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from footfall.llm.common import slices, utf8, worker_table

KNOWN_CHUNKS = 300_000   # entries of each table of a worker; a full table is emptied
ENCODED_BYTES = 2 << 20  # text whose tokens are held as lists at once
SHORT = 48               # fragments up to this length are merged by rescanning
LATIN = 0x250            # texts below this code point are split here, others by the library's own splitter

_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_LATIN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files of byte-level tokenizers."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


class ForcedBoundaryBpe:
    """Encoder and decoder for one vocabulary file (its text, as the tokenizers library stores it)."""

    def __init__(self, spec: str) -> None:
        model = json.loads(spec)["model"]
        self.library = Tokenizer.from_str(spec)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.ranks = {tuple(pair): k for k, pair in enumerate(model["merges"])}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile(b"(" + b"|".join(re.escape(t.encode()) for t in self.special) + b")") if self.special else None
        inside = set()
        for token in self.ids:
            body = token.removesuffix(self.suffix) if self.suffix else token
            inside.update(zip(body, body[1:]))
        self.inside = inside
        self.alphabet = byte_alphabet()
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.coded: dict[bytes, tuple[int, ...]] = {}            # runs without white space, for ``encode``
        self.chunks: dict[bytes, tuple[int, str, str]] = {}      # the same with their spellings, for ``parts``

    def boundaries(self, piece: str) -> list[int]:
        """Places of ``piece`` that are certain cuts."""
        inside = self.inside
        return [k for k, pair in enumerate(zip(piece, piece[1:]), 1) if pair not in inside]

    def merge(self, symbols: list[str]) -> list[str]:
        if len(symbols) <= SHORT:
            rank, none = self.ranks.get, 1 << 60
            order = [rank(p, none) for p in zip(symbols, symbols[1:])]
            while order and (best := min(order)) < none:
                k = order.index(best)
                symbols[k] += symbols.pop(k + 1)
                del order[k]
                if k:
                    order[k - 1] = rank((symbols[k - 1], symbols[k]), none)
                if k < len(order):
                    order[k] = rank((symbols[k], symbols[k + 1]), none)
            return symbols
        return self._merge_long(symbols)

    def _merge_long(self, symbols: list[str]) -> list[str]:
        n, ranks = len(symbols), self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        live: list[str | None] = list(symbols)
        queue = [(ranks[p], k, p) for k, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        heapq.heapify(queue)
        while queue:
            _, k, pair = heapq.heappop(queue)
            j = right[k] if live[k] is not None else -1
            if j < 0 or (live[k], live[j]) != pair:
                continue
            live[k], live[j] = pair[0] + pair[1], None
            right[k] = right[j]
            if right[k] >= 0:
                left[right[k]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b >= 0 and (p := (live[a], live[b])) in ranks:
                    heapq.heappush(queue, (ranks[p], a, p))
        return [s for s in live if s is not None]

    def fragment(self, text: str, last: bool) -> tuple[int, ...]:
        """Tokens of a fragment; ``last`` if it ends a piece and so carries the end mark."""
        found = self.fragments.get((text, last))
        if found is None:
            symbols = list(text)
            if last:
                symbols[-1] += self.suffix
            found = tuple(self.ids[s] for s in self.merge(symbols))
            if len(self.fragments) > KNOWN_CHUNKS:
                self.fragments.clear()
            self.fragments[text, last] = found
        return found

    def piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of one piece (a run of letters, a digit, ...), written in the byte alphabet."""
        found = self.pieces.get(piece)
        if found is None:
            ends = [*self.boundaries(piece), len(piece)]
            found = sum((self.fragment(piece[a:b], b == len(piece)) for a, b in zip([0, *ends], ends)), ())
            if len(self.pieces) > KNOWN_CHUNKS:
                self.pieces.clear()
            self.pieces[piece] = found
        return found

    def split(self, chunk: bytes) -> Iterable[str]:
        """Pieces of a run without white space, normalised and in the byte alphabet."""
        text = chunk.decode("utf-8", "replace")
        if text.isascii():
            return _ASCII.findall(text.lower()) if text.isprintable() else self._split_by_library(text)
        if ord(max(text)) < LATIN and "İ" not in text and text.isprintable() and unicodedata.is_normalized("NFC", text):
            letters = self.alphabet
            return ["".join([letters[b] for b in p.encode()]) for p in _LATIN.findall(text.lower())]
        return self._split_by_library(text)

    def _split_by_library(self, text: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def code(self, chunk: bytes) -> tuple[int, ...]:
        """Tokens of a run without white space."""
        found = tuple(i for p in self.split(chunk) for i in self.piece(p))
        if len(self.coded) > KNOWN_CHUNKS:
            self.coded.clear()
        self.coded[chunk] = found
        return found

    def chunk(self, chunk: bytes) -> tuple[int, str, str]:
        """Token count, ids as text and decoded text of a run without white space."""
        ids = [i for p in self.split(chunk) for i in self.piece(p)]
        found = len(ids), " ".join(map(str, ids)), self.decode(ids)
        if len(self.chunks) > KNOWN_CHUNKS:
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding for a file without a decoder: tokens joined by one space."""
        return " ".join([self.tokens[i] for i in ids])

    def stretches(self, text: bytes) -> list[tuple[bytes, int | None]]:
        """The text between special tokens, and the special tokens (with their ids), in order."""
        if b"<|" not in text or not self.split_special:
            return [(text, None)]
        return [(part, self.special[part.decode()] if k % 2 else None) for k, part in enumerate(self.split_special.split(text))]

    def parts(self, text: bytes) -> list[tuple[int, str, str]]:
        """What ``chunk`` gives for each run of the text and each special token in it, in order."""
        get, new, out = self.chunks.get, self.chunk, []
        for part, special in self.stretches(text):
            if special is None:
                out += [p for p in [get(c) or new(c) for c in part.split()] if p[0]]
            else:
                out.append((1, str(special), self.decode([special])))
        return out

    def encode(self, text: bytes) -> list[int]:
        get, new, out = self.coded.get, self.code, []
        for part, special in self.stretches(text):
            if special is None:
                out += chain.from_iterable([get(c) or new(c) for c in part.split()])
            else:
                out.append(special)
        return out


def _encoder(spec: str) -> ForcedBoundaryBpe:
    """A worker keeps its encoder and the tables of it between tasks."""
    return worker_table("bpe " + sha256(spec.encode()).hexdigest(), lambda: ForcedBoundaryBpe(spec))


def _shared(df: DataFrame, path: str):
    """The vocabulary file goes to the executors once; its size is fixed (1.7 MB here)."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """``df`` with the tokens of ``text`` as array ``to``, which replaces a column of that name."""
    rest = [c for c in df.columns if c != to]
    schema = df.select(*rest).withColumn(to, F.array(F.lit(0))).schema
    spec = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for batch in batches:
            for part in slices(batch, text, ENCODED_BYTES):
                ids = [np.array(bpe.encode(t), np.int32) for t in utf8(part.column(text))]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, to])

    return df.select(*rest).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``df`` with the text of the token array ``ids`` as ``to`` (null where ``ids`` is null)."""
    rest = [c for c in df.columns if c != to]
    schema = df.select(*rest).withColumn(to, F.lit("").cast("string")).schema
    spec = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, to])

    return df.select(*rest).mapInArrow(run, schema)


def token_digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: token count and SHA-256 of the ids and of the decoded text, encoding and decoding in one pass."""
    spec = _shared(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(spec.value)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for part in slices(batch, "_text"):
                for t in utf8(part.column("_text")):
                    parts = bpe.parts(t)
                    n, i, d = zip(*parts) if parts else ((), (), ())
                    counts.append(sum(n))
                    ids.append(sha256(" ".join(i).encode()).hexdigest())
                    decoded.append(sha256(" ".join(d).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
