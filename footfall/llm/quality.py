"""Cross-document line frequency: hash normalised lines, count distinct documents per host,
remove lines above the limits, and reject documents that this depletes.

A line is normalised by lower-casing A-Z and joining its words by single spaces; lines
without a word don't count. For each host (column ``source``) and line the distinct
documents that have it are counted, and the host's size is counted in the same unit.

Documents are told apart by the set of all their lines, so exact copies are one. So that near
copies of one document don't turn its own text into boilerplate either, texts that have a
recurring line (in more than ``min_documents`` texts of the host) are compared in a second
look: a line that isn't recurring itself, but equals another line of such texts except within
a quarter of its words, stands for that line (for the most frequent recurring one, if there
are several, otherwise for the one with the smallest hash). A text takes part in this only if
the lines that others stand for hold at most ``own_share`` of its words: copies with a word
exchanged here and there become one document, while pages of one form (a template and a line
of their own, however alike these lines are) stay different documents and count each. Lines of
fewer than ``OWN_WORDS`` words always stand for themselves.

A line is removed where its count exceeds both ``min_documents`` and ``share`` of the
host's documents. A document is depleted if fewer than ``min_words`` words are left or more
than ``max_removed`` of its words went.

Counting combines map-side and shuffles (host, line, text) and then (host, line), so a
line that every document has is summed from partial counts; only texts with a recurring line
go through the second look. Marking is an equi-join of lines with the few lines above the
limit, which the run-time skew join can split.

Defined cases: a null text has no words (and fails the base rules); a null host is a host of
its own; repeated rows are judged each, alike; an empty table gives no rows; texts of one
line only are never depleted by copies of themselves; texts without words are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from footfall.llm.common import WordHashes, ascii_lower, gram_hashes, mixed, slices, utf8, worker_table
from footfall.operators.keyed import BROADCAST_BYTES
from footfall.session import materialize

MEASURED_BYTES = 2 << 20  # text whose words and lines are held as lists at once
WINDOW = 5        # words of the windows whose repetition inside a text counts
MIN_WORDS = 10
PARTS = 4         # a line's variants each leave one of so many parts out
OWN_WORDS = 6     # words from which a line has variants
VARIANTS = tuple(f"_variant{k}" for k in range(PARTS))
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class LineLimits:
    min_documents: int = 20
    share: float = 0.05
    min_words: int = MIN_WORDS
    max_removed: float = 0.8
    own_share: float = 0.125  # copies of one document differ in lines with at most this share of their words


_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CHAR = np.array([(b & 0xC0) != 0x80 and b != 32 and not 9 <= b <= 13 for b in range(256)], np.int64)


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the stretches that end at ``ends``."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return np.diff(np.concatenate([[0], total[ends]]))


def repeated_words(hashes: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each document the words in windows found at least twice in it; ``hashes`` are the words of all."""
    n = len(hashes)
    if n < window:
        return np.zeros(len(ends), np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    grams = gram_hashes(hashes, window)
    whole = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    keys = grams[whole] ^ mixed(doc[whole].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(whole), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    starts = whole[again]
    cover = np.zeros(n + 1, np.int64)
    cover[starts] += 1
    np.subtract.at(cover, starts + window, 1)
    return _sums(np.cumsum(cover[:n]) > 0, ends)


def variants(parts: np.ndarray) -> np.ndarray:
    """For every line, from the hashes of its parts (line x PARTS): hashes of the line without one of them."""
    placed = mixed(parts ^ np.arange(1, PARTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest = placed.sum(axis=1, dtype=np.uint64)[:, None] - placed
    return mixed(rest ^ np.arange(1, PARTS + 1, dtype=np.uint64)).view(np.int64)


def _measure(texts: list[bytes], words_known: WordHashes) -> list[list]:
    n_words, dup, hashes, counts, words, whole, parts = [], [], [], [], [], [], []
    for text in texts:
        seen, own, sizes, here, again = set(), [], [], 0, 0
        for line in text.split(b"\n"):
            w = line.split()
            if not w:
                continue
            here += len(w)
            words += w
            again += line in seen
            seen.add(line)
            lower = ascii_lower(b" ".join(w))
            own.append(xxhash.xxh3_64_intdigest(lower) - (1 << 63))
            sizes.append(len(w))
            if len(w) >= OWN_WORDS:
                x = lower.split(b" ")
                cuts = [len(w) * k // PARTS for k in range(PARTS + 1)]
                parts += [xxhash.xxh3_64_intdigest(b" ".join(x[a:b])) for a, b in zip(cuts, cuts[1:])]
        whole.append(xxhash.xxh3_64_intdigest(np.array(sorted(set(own)), np.int64).tobytes()) - (1 << 63))
        n_words.append(here)
        dup.append(again)
        hashes.append(own)
        counts.append(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    repeat = repeated_words(words_known.of(words), np.cumsum(n_words)) if words else np.zeros(len(texts), np.int64)
    made = iter(variants(np.array(parts, np.uint64).reshape(-1, PARTS)).tolist())
    missing = [None] * PARTS
    each = [[next(made) if n >= OWN_WORDS else missing for n in sizes] for sizes in counts]
    without = [[[v[k] for v in lines] for lines in each] for k in range(PARTS)]
    return [n_words, _sums(_CHAR[data], ends), _sums(_SYMBOL[data], ends), dup, repeat, hashes, counts, whole, *without]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row the text's figures, its lines (hashes, word counts, variants) and a hash of their set; other columns stay, the text goes."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema
    for name in FIGURES:
        schema = schema.add(name, "long")
    schema = schema.add("_lines", T.ArrayType(T.LongType())).add("_line_words", T.ArrayType(T.IntegerType())).add("_text", "long")
    for name in VARIANTS:
        schema = schema.add(name, T.ArrayType(T.LongType()))
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()] + [pa.list_(pa.int64())] * PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_table("quality", WordHashes)
        for batch in batches:
            for part in slices(batch, text, MEASURED_BYTES):
                made = [pa.array(v, k) for v, k in zip(_measure(utf8(part.column(text)), known), kinds, strict=True)]
                kept = [part.column(c) for c in rest]
                yield pa.RecordBatch.from_arrays(kept + made, names=schema.names)

    return docs.mapInArrow(run, schema)


def same(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on the host (nulls are equal) and ``key``; those of ``right`` go."""
    other = right.withColumnsRenamed({"_host": "_h", key: "_k"})
    joined = left.join(other, F.expr(f"_host <=> _h AND {key} = _k"), how)
    return joined if how == "left_semi" else joined.drop("_h", "_k")


def small_side(names: DataFrame, label: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(host, long) rows written, and marked for broadcast where their counted size is within ``limit``: the texts they are looked up for then stay where they are."""
    seen = Observation()
    written = materialize(names.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.length("_host")).alias("longest")), label)
    found = seen.get
    return F.broadcast(written) if found["n"] * (64 + 4 * (found["longest"] or 0)) <= limit else written


def stand_ins(lines: DataFrame, recurring: DataFrame) -> DataFrame:
    """(host, line, stand-in) of lines that aren't recurring and share a variant with another line."""
    each = lines.where(F.col(VARIANTS[0]).isNotNull()).distinct()
    ranked = same(each, recurring, "_line", "left").select("_host", "_line", "_texts", F.explode(F.array(*VARIANTS)).alias("_variant"))
    ranked = materialize(ranked, "quality-variants")
    shared = ranked.groupBy("_host", "_variant").agg(F.min("_line").alias("_lo"), F.max("_line").alias("_hi")).where("_lo < _hi")
    rivals = materialize(same(ranked, materialize(shared.select("_host", "_variant"), "quality-shared"), "_variant", "left_semi"), "quality-rivals")
    rank = F.struct((-F.coalesce("_texts", F.lit(0))).alias("n"), F.col("_line").alias("line"))
    leaders = rivals.groupBy("_host", "_variant").agg(F.min(rank).alias("_best"))
    best = same(rivals.where("_texts IS NULL").select("_host", "_line", "_variant"), leaders, "_variant").groupBy("_host", "_line").agg(F.min("_best").alias("_best"))
    return best.select("_host", "_line", F.col("_best.line").alias("_for")).where("_line != _for")


def frequent_lines(measured: DataFrame, limits: LineLimits, host: str = "source") -> DataFrame:
    """(host, line) above the limits, from the distinct documents that have it."""
    texts = measured.withColumnRenamed(host, "_host")
    lines = texts.select("_host", "_text", F.explode("_lines").alias("_line")).distinct()
    recurring = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") > limits.min_documents)
    recurring = materialize(recurring, "quality-recurring")
    all_lines = texts.select("_host", "_text", F.explode("_lines").alias("_line"))
    having = materialize(same(all_lines, recurring, "_line", "left_semi").distinct(), "quality-having")
    touched = same(texts, small_side(having.select("_host", "_text").distinct(), "quality-touched"), "_text", "left_semi")
    own = touched.select("_host", "_text", F.explode(F.arrays_zip("_lines", "_line_words", *VARIANTS)).alias("_at")).select(
        "_host", "_text", F.col("_at._lines").alias("_line"), F.col("_at._line_words").alias("_words"), *[F.col(f"_at.{v}").alias(v) for v in VARIANTS]
    )
    own = materialize(own, "quality-own")
    canon = materialize(stand_ins(own.drop("_text", "_words"), recurring), "quality-stand-ins")
    named = same(own.select("_host", "_text", "_line", "_words"), canon, "_line", "left")
    alike = F.xxhash64(F.array_sort(F.collect_set(F.coalesce("_for", "_line"))))  # as many entries as a text has lines, at most
    exchanged = F.sum(F.when(F.col("_for").isNotNull(), F.col("_words")).otherwise(0))
    itself = F.xxhash64(F.array_sort(F.collect_set("_line")))
    document = F.when(exchanged <= F.sum("_words") * limits.own_share, alike).otherwise(itself)
    units = materialize(named.groupBy("_host", "_text").agg(document.alias("_document")), "quality-documents")
    counted = same(having, units, "_text").select("_host", "_line", "_document").distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_documents"))
    # the host's size: texts without a recurring line, and the documents that the others are
    plain = texts.select("_host", "_text").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    fewer = units.groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    merged = units.select("_host", "_document").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_n"))
    parts = plain.unionByName(fewer.withColumn("_n", -F.col("_n"))).unionByName(merged)
    hosts = parts.groupBy(F.col("_host").alias("_h")).agg(F.sum("_n").alias("_size"))
    kept = counted.where(F.col("_documents") > limits.min_documents).join(hosts, F.expr("_host <=> _h"))
    return kept.where(F.col("_documents") > F.col("_size") * limits.share).select("_host", "_line", "_documents")


def judge(docs: DataFrame, limits: LineLimits = LineLimits(), text: str = "text", host: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For every row its ``keys`` and host, figures and verdict (``base_failed``, ``kept``), and the hashes of the lines to remove."""
    measured = materialize(measure(docs.select(*keys, host, text), text).withColumn("_row", F.monotonically_increasing_id()), "quality-rows")
    frequent = materialize(frequent_lines(measured, limits, host), "quality-lines")
    lines = measured.select("_row", F.col(host).alias("_lh"), F.explode(F.arrays_zip("_lines", "_line_words")).alias("_at"))
    marked = lines.join(frequent, F.expr("_lh <=> _host AND _at._lines = _line")).groupBy("_row").agg(
        F.sum("_at._line_words").alias("n_removed_words"), F.collect_set("_line").alias("_removed")
    )
    judged = measured.drop("_lines", "_line_words", "_text", *VARIANTS).join(marked, "_row", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    depleted = (F.col("n_removed_words") > 0) & (
        (F.col("n_words") - F.col("n_removed_words") < limits.min_words) | (F.col("n_removed_words") > F.col("n_words") * limits.max_removed)
    )
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("_row")


def without_lines(docs: DataFrame, text: str = "text", removed: str = "_removed") -> DataFrame:
    """``docs`` with the lines named in ``removed`` taken out of ``text``; that column goes."""
    rest = [c for c in docs.columns if c != removed]
    schema = docs.select(*rest).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, gone in enumerate(batch.column(removed).to_pylist()):
                if gone and texts[i]:
                    away = set(gone)
                    lines = texts[i].encode().split(b"\n")
                    texts[i] = b"\n".join(
                        x for x in lines if not (w := x.split()) or xxhash.xxh3_64_intdigest(ascii_lower(b" ".join(w))) - (1 << 63) not in away
                    ).decode()
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays(columns, names=rest)

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The kept documents, without the lines above the limits; columns as in ``docs``."""
    columns = docs.columns
    keyed = docs.withColumn("_content", F.xxhash64("text"))  # rows with equal ids, hosts and texts have equal verdicts
    verdicts = judge(keyed, limits, keys=("doc_id", "_content"))
    chosen = verdicts.where("kept").select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("_content").alias("_c"), "_removed"
    ).dropDuplicates(["_id", "_src", "_c"])
    kept = keyed.join(chosen, F.expr("doc_id <=> _id AND source <=> _src AND _content = _c")).select(*columns, "_removed")
    cleaned = without_lines(kept)
    if "n_chars" in columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return cleaned.select(*columns)
