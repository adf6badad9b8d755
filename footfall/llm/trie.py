"""Prefix trie of conversations by van Emde Boas recursion, as joins over tables of turns.

A conversation is a sequence of turns (role, text); a node is a distinct prefix. A sequence is cut at half
of the (power of two) height: its first half belongs to the upper trie, the rest to the lower trie that
hangs on the name of the cut prefix. Both are cut again in the same way. All tries of one height are
handled together, as rows of one table, so there are as many rounds as the longest sequence's length has
binary digits, however many sequences there are.

* Naming: blocks of 1, 2, 4, .. turns get names (128 bits) from their halves; going down, each cut prefix
  is named by its root's name and its block's. At the end every prefix of every sequence has a name, and
  a node is known by its depth and its smallest member.
* Grafting: going up, a lower trie's totals are added to the nodes of the upper trie above its root, then
  the two are one trie of double height. A total meets each ancestor once.
* No window, sort or list is as long as a conversation or the members of a node, except that a node's
  members' digest is fed in id order: ids are joined in ranges first, and one task reads those strings as a stream.

Defined cases: turns are in ``turn`` order, nulls first, equal ones by role and text; rows that repeat are
turns of their own; null roles and texts are empty; turns without a ``conv_id`` belong to no conversation
and are left out; a conversation may have no turns after rebuilding and then ends at the root; an empty
table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.operators.keyed import attach, settle, with_ordinals
from footfall.session import materialize

BLOCK = 100  # conversations of one hundred share openings
MOST = 6     # shared turns are fewer than this
NODE = ("depth", "a", "b")


def _names(*parts: Column | str) -> list[Column]:
    """128 bits from the parts."""
    return [F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b")]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ord, a, b, chars): turns numbered from 0 in their conversation, each with its name and its text's length."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    order = F.struct(F.col("turn").cast("long").alias("turn"), text["role"].alias("role"), text["text"].alias("text")).alias("at")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), order)
    numbered = with_ordinals(rows, "at", ["conv_id"])
    return numbered.select("conv_id", "ord", *_names("at.role", "at.text"), F.char_length("at.text").cast("long").alias("chars"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, pos, a, b, chars) and their lengths (conv_id, length): shared openings, then own turns."""
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("share")
    first = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("first")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = sizes.select("conv_id", "n", share, first)
    there = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("_n"))
    head = F.least("share", F.coalesce("_n", F.lit(0))).alias("head")
    convs = convs.join(there, "first", "left").select("conv_id", "n", "share", "first", head)
    convs = convs.withColumn("length", F.col("head") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("share")))
    convs = settle(convs, "trie-conversations").with_hot("n", ("conv_id",))
    opening = own.where((F.col("conv_id") % BLOCK == 0) & (F.col("ord") < MOST)).withColumnRenamed("conv_id", "first")
    shared = convs.df.where("head > 0").select("conv_id", "first", "head").join(opening, "first").where("ord < head")
    rest = attach(own, convs.of(convs.df.select("conv_id", "share", "head")), ["conv_id"], spread=["ord"]).where("ord >= share")
    columns = ("a", "b", "chars")
    both = shared.select("conv_id", F.col("ord").alias("pos"), *columns).union(
        rest.select("conv_id", (F.col("ord") - F.col("share") + F.col("head")).alias("pos"), *columns))
    return materialize(both, "trie-turns"), convs.df.select("conv_id", "length")


def prefixes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, depth, a, b): the name of every prefix of every sequence; and the number of halvings."""
    longest = lengths.agg(F.max("length").alias("most")).first().most or 0
    rounds = int(longest).bit_length()
    blocks = [turns.select("conv_id", F.col("pos").alias("block"), "a", "b")]
    for _ in range(1, rounds):
        odd = F.col("block") % 2 == 1
        pick = lambda c, side: F.max(F.when(side, F.col(c)))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.count(F.lit(1)).alias("n"), pick("a", ~odd).alias("a0"), pick("b", ~odd).alias("b0"), pick("a", odd).alias("a1"), pick("b", odd).alias("b1"))
        blocks.append(materialize(pairs.where("n = 2").select("conv_id", "block", *_names("a0", "b0", "a1", "b1")), "trie-blocks"))
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"))
    for k in reversed(range(rounds)):
        cut = roots.select("conv_id", "depth", F.col("a").alias("ra"), F.col("b").alias("rb"), F.shiftright("depth", k).alias("block"))
        below = cut.join(blocks[k], ["conv_id", "block"]).select("conv_id", (F.col("depth") + (1 << k)).alias("depth"), *_names("ra", "rb", "a", "b"))
        roots = materialize(roots.union(below), "trie-prefixes")
    return roots, rounds


def subtree_totals(values: DataFrame, paths: DataFrame, rounds: int, columns: list[str]) -> DataFrame:
    """(conv_id, depth, columns): sums over subtrees, by grafting lower tries' totals on upper ones.

    ``values`` has a row a node (conv_id: its smallest member), ``paths`` the nodes of each sequence
    (conv_id, depth, node: the smallest member of its prefix).
    """
    given = values.select("conv_id", "depth", *columns)
    sums = [F.sum(c).alias(c) for c in columns]
    for k in range(rounds):
        height = 1 << k
        lower = given.where(F.col("depth") % (2 * height) == height).groupBy("conv_id", "depth").agg(*sums)
        up = F.explode(F.sequence(F.col("depth") - height, F.col("depth") - 1)).alias("depth")
        above = paths.where(F.col("depth") % (2 * height) < height)
        grafted = lower.select("conv_id", up, *columns).join(above, ["conv_id", "depth"]).groupBy(F.col("node").alias("conv_id"), "depth").agg(*sums)
        given = given.union(materialize(grafted, "trie-grafts"))
    return given.groupBy("conv_id", "depth").agg(*sums)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Places a to b of a sorted batch that belong to one node."""
    keys = list(zip(batch.column("node").to_pylist(), batch.column("depth").to_pylist(), strict=True))
    a = 0
    for b in range(1, len(keys) + 1):
        if b == len(keys) or keys[b] != keys[a]:
            yield keys[a], a, b
            a = b


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        rows = [(*key, ids[a], ",".join(map(str, ids[a:b]))) for key, a, b in _runs(batch)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["node", "depth", "least", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        out, ids = [], batch.column("ids").to_pylist()
        for own, a, b in _runs(batch):
            if own != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
                digest.update(ids[a].encode())
                a += 1
            for i in range(a, b):
                digest.update(b"," + ids[i].encode())
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["node", "depth", "ends_sha256"])


def member_digests(members: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of ``members`` (node, depth, conv_id): SHA-256 of each node's ids, ascending, joined by commas."""
    order = ["node", "depth", "conv_id"]
    ranged = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = materialize(ranged.mapInArrow(_joined, "node long, depth long, least long, ids string"), "trie-ends")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "node", "depth").sortWithinPartitions("node", "depth", "least").mapInArrow(_digested, "node long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    sequences, lengths = rebuilt(turns(conversations))
    named, rounds = prefixes(sequences, lengths)
    groups = named.groupBy(*NODE).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"))
    groups = settle(groups, "trie-nodes").with_hot("n_convs", NODE)
    paths = attach(named, groups.of(groups.df.drop("n_convs")), list(NODE), spread=["conv_id"]).select("conv_id", "depth", "node")
    paths = materialize(paths, "trie-paths")

    nodes = groups.df.select(F.col("node").alias("conv_id"), "depth", "n_convs")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    last = sequences.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars")
    nodes = nodes.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left")
    nodes = materialize(nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("chars", F.lit(0)).alias("chars")), "trie-linked")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children, ["conv_id", "depth"], "left").fillna({"n_children": 0}), "trie-children")
    own = nodes.select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(own, paths, rounds, ["n_leaves", "saved_tokens"])
    members = paths.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    ends = member_digests(members).withColumnRenamed("node", "conv_id")
    out = nodes.join(totals, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
