"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source gets a word target (its share of the mix, at most ``most`` times its size; what
is over goes to the others by weight). Its weight over the training time t in [0, 1] follows
the schedule f(t) = 1 + a (1 - 2t), whose integral F(t) = t + a (t - t^2) runs from 0 to 1.
The words a source gives are lined up in an order fixed by the document's id and text; the word at
share u of the source's demand is trained at the time t with F(t) = u. Documents are then
range-sorted by that position.

No key gathers in one task: rows are cut into blocks of about ``BLOCK_ROWS`` by a hash of
id and text within each source (rows without an id, or that share one, so spread), block totals (one row per source and block) give the running sums
across blocks, and a window runs inside one block only.

Defined cases: null or empty texts have size 0 and are taken 0 words; a null source is a
source of its own, ranked last; sources without words get the target 0; repeated rows are
mixed each, in one block; an empty table gives an empty mix. Reruns give the same mix, as nothing depends
on the order in which rows are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from footfall.llm.common import WORD, text_or_empty, word_count
from footfall.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (-0.5, 0.0, 0.5)  # by the source's rank like the weights: heavy sources grow in time
BLOCK_ROWS = 50_000
LEAST_BLOCKS = 64  # a source with most rows is spread over so many tasks at least


def _cycled(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def source_targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``weight``, ``slope`` rank and ``target`` to (_source, source_size); one row per source.

    Giving out what capped sources leave, again and again, ends at target = min(cap, level * weight).
    With the sources ordered by cap / weight, the level is the first (all - caps before) /
    (weights from here on) that the source's own ratio reaches.
    """
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", _cycled(weights, F.col("_rank"))).withColumn("_cap", F.col("source_size") * float(most))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (
        (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward)
    )
    tried = weighed.withColumn("_level", level)
    ratio = F.col("_cap") / F.col("weight")
    first = F.min(F.when(F.col("_level") <= ratio, F.struct(ratio, "_rank", "_level"))).over(everything)
    level = F.coalesce(first.getField("_level"), F.lit(float("inf")))
    return tried.withColumn("target", F.least(F.col("_cap"), level * F.col("weight"))).drop("_level", "_cap")


def position(share: Column, slope: Column) -> Column:
    """The time t in [0, 1] at which a source with this slope has given ``share`` of its demand."""
    b = slope + 1.0
    return F.least(F.lit(1.0), share * 2.0 / (b + F.sqrt(F.greatest(b * b - slope * share * 4.0, F.lit(0.0)))))


def curriculum(
    docs: DataFrame, key: str = "doc_id", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5,
    most: float = 2.0, slopes: Sequence[float] = SLOPES, content: str = "content",
) -> DataFrame:
    """Plan of the mix: every row of ``docs`` (which has a column ``size``, and in ``content`` a hash of its text) with its source's
    ``source_size`` and ``target``, the words ``taken``, the ``copies`` taken whole, the words
    ``part`` of a last copy taken in part, and the ``position`` of each copy in time (array ``positions``)."""
    # 60 bits of a hash that every engine has; blocks are ranges of it, so that their number changes nothing
    named = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(" "), F.col(content))
    order = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")
    n_rows = docs.count()
    blocks = max(LEAST_BLOCKS, -(-n_rows // BLOCK_ROWS))
    rows = docs.withColumn("_source", F.col(source)).withColumn("_order", order).withColumn("_block", F.floor(F.col("_order") / float(1 << 60) * blocks))
    by_block = materialize(rows.groupBy("_source", "_block").agg(F.sum("size").alias("_words")), "mix-blocks")
    targets = source_targets(by_block.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, share, most)
    targets = targets.withColumn("slope", _cycled(slopes, F.col("_rank"))).drop("_rank", "weight")
    running = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks_table = by_block.withColumn("_offset", F.coalesce(F.sum("_words").over(running), F.lit(0))).drop("_words")
    blocks_table = blocks_table.alias("b").join(targets.alias("t"), F.expr("b._source <=> t._source")).select(
        F.col("b._source").alias("_bs"), F.col("_block").alias("_bb"), "_offset", "source_size", "target", "slope"
    )
    inside = Window.partitionBy("_source", "_block").orderBy("_order", key, content).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(blocks_table, F.expr("_source <=> _bs AND _block = _bb")).withColumn("_before", F.col("_before") + F.col("_offset"))
    goal = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - whole * F.col("source_size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))).cast("long")
    full = F.when(extra == F.col("size"), whole + 1).otherwise(whole)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, full).otherwise(0)).withColumn(
        "part", F.when(extra < F.col("size"), extra).otherwise(0).cast("long")
    ).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))
    n = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    at = F.when(n > 0, F.transform(
        F.sequence(F.lit(0), n.cast("int") - 1),
        lambda k: position((F.col("_before") + k * F.col("source_size")) / F.col("target"), F.col("slope")),
    )).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("positions", at).drop("_source", "_order", "_block", "_bs", "_bb", "_before", "_offset", "slope")


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", word_count(text_or_empty(text))).withColumn("content", content_hash(text))


def content_hash(text: str = "text") -> Column:
    return F.md5(text_or_empty(text).cast("binary"))


def mix_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as it is taken, in training order.

    A copy taken in part has the first words of its text, joined by single spaces.
    """
    kept = docs.columns
    plan = curriculum(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"),
                                  word_count(text_or_empty(text)).alias("size"), content_hash(text).alias("content")), "_id", "_src", **options)
    copies = plan.select("_row", "_id", "copies", "part", F.posexplode("positions").alias("_copy", "_at"))
    first_words = F.array_join(F.slice(F.regexp_extract_all(text_or_empty("_whole"), F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " ")
    cut = copies.withColumn("_whole", F.col(f"_row.`{text}`"))
    cut = cut.withColumn("_whole", F.when(F.col("_copy") < F.col("copies"), F.col("_whole")).otherwise(first_words))
    ordered = cut.orderBy("_at", "_id", "_copy")

    def column(c: str) -> Column:
        if c == text:
            return F.col("_whole")
        old = F.col(f"_row.`{c}`")
        return F.when(F.col("_copy") < F.col("copies"), old).otherwise(F.length("_whole").cast("long")) if c == "n_chars" else old

    return ordered.select(*[column(c).alias(c) for c in kept])
