"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is
kept. DataFrame functions only.

Which hashes are kept depends on the hash alone, so sketches merge by union, and the share
of one sketch found in another estimates containment however unequal the documents are.
Shingles are ``WORDS`` consecutive words; a text with fewer words has its whole word sequence
as its one shingle. A text with shingles of which none lies below the threshold keeps its
smallest hash.

Defined cases: null texts are empty; texts without words have the empty sketch, whose
likeness is 1 to an empty sketch and 0 to any other; equal texts have equal sketches. Every row
is a document: the next one of rows that share an id is the one with the next smaller text, and
rows without an id come last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import WORD, text_or_empty
from footfall.operators.keyed import with_ordinals
from footfall.session import materialize

WORDS = 5
SCALE_BITS = 4                 # one hash in 2^4 is kept
BLOCK_ROWS = 50_000
MAX_BLOCKS = 2_000


def sketch(text: Column, words: int = WORDS, bits: int = SCALE_BITS) -> Column:
    """Sorted distinct hashes of the text's shingles below the threshold, as array of long."""
    limit = F.lit(-(1 << 63) + (1 << (64 - bits)))
    hashed = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - words)
        return F.when(F.size(h) >= words, F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))).when(
            F.size(h) > 0, F.array(F.xxhash64(h))
        ).otherwise(F.array().cast("array<bigint>"))

    def kept(s: Column) -> Column:
        low = F.filter(s, lambda x: x < limit)
        return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(s)

    # one-element arrays bind an intermediate array to a name, so that it is built once
    return F.transform(F.transform(F.transform(F.array(hashed), shingles), lambda s: s), kept)[0]


def spelled(sketched: Column) -> Column:
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller document's shingles found in the larger one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(
        F.when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))
    ).cast("double")


def merged(a: Column, b: Column) -> Column:
    """Sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _key, text) of every row: ``_id`` is unique and orders rows by id, those without one first, then by text.

    It is the id itself while no id repeats, else the row's number in that order, counted range by range.
    """
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(key), F.lit(-(1 << 63))).cast("long").alias("_id"), text_or_empty(text).alias("text"))
    if not rows.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return rows
    at = rows.select("_key", F.lit(0).alias("_all"), F.struct("_id", "text").alias("_at"))
    return with_ordinals(at, "_at", ["_all"], "_id").select("_id", "_key", F.col("_at.text").alias("text"))


def neighbours(ids: DataFrame) -> DataFrame:
    """(_id, _next): the next id in descending order, the largest after the smallest.

    Ids are cut into ranges of about ``BLOCK_ROWS`` by approximate quantiles, each range is
    sorted alone, and a table of one row per range links the ranges.
    """
    n = ids.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // BLOCK_ROWS)))
    block = F.lit(0)
    if blocks > 1:
        cuts = ids.agg(F.percentile_approx("_id", [i / blocks for i in range(1, blocks)], 10 * blocks).alias("c")).first().c  # < MAX_BLOCKS values
        block = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("_id")))
    dealt = ids.withColumn("_block", block)
    inside = Window.partitionBy("_block").orderBy(F.col("_id").desc())
    first = dealt.groupBy("_block").agg(F.max("_id").alias("_top"))
    order = Window.orderBy("_block")  # one row per range
    link = first.select(F.col("_block").alias("_b"), F.coalesce(F.lag("_top").over(order), F.max("_top").over(Window.partitionBy())).alias("_below"))
    return dealt.withColumn("_next", F.lead("_id").over(inside)).join(F.broadcast(link), F.expr("_block = _b")).select(
        *ids.columns, F.coalesce("_next", "_below").alias("_next")
    )


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its text, the edited text, its own sketch and the next document's.

    The edited text replaces the last half of the code points by the first as many of the next
    document. Texts are shuffled once by id (both uses share the exchange); each document then
    sends only the characters that its predecessor needs, with its sketch.
    """
    rows = placed(docs, key, text)
    pairs = materialize(neighbours(rows.select("_id", "_key", F.length("text").cast("long").alias("n_chars"))), "sketch-ids")
    asked = pairs.select(F.col("_next").alias("_id"), F.col("_id").alias("_to"), "_key", (F.floor(F.col("n_chars") / 2)).cast("int").alias("_need"))
    spread = rows.select("_id", "text").repartition("_id")
    sent = spread.join(asked, "_id").select(F.col("_to").alias("_id"), "_key", F.expr("left(text, _need)").alias("_head"), sketch(F.col("text")).alias("_next_sketch"))
    own = spread.join(sent, "_id").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2)
    return own.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.col("_head"))).withColumn(
        "n_replaced", half
    ).withColumn("_sketch", sketch(F.col("text"))).withColumn("_edited_sketch", sketch(F.col("edited"))).withColumn(key, F.col("_key"))
