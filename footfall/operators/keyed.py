"""Attaching one-row-per-key tables to row-level tables, skew-safe."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T, Window

from footfall.session import materialize

BROADCAST_BYTES = 64 << 20   # proven bound for a broadcast side
HOT_ROWS = 20_000_000        # a key with more rows is cut into parts before a shuffled join
BLOCK = 1 << 17              # rows handed to one vectorised task group

MESH = ("mesh_id",)


def _width(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(_width(f.dataType) for f in kind.fields) + 16
    if isinstance(kind, T.ArrayType):
        return 32 * _width(kind.elementType)
    return 64 if isinstance(kind, T.StringType) else 16


@dataclass(frozen=True)
class KeyTable:
    """A table with one row per key, its known row count and observed figures.

    ``hot`` lists keys known to hold very many rows, with the number of parts (``_parts``)
    their rows should be cut into.
    """

    df: DataFrame
    rows: int
    seen: dict = field(default_factory=dict)
    hot: "KeyTable | None" = None

    @property
    def bytes(self) -> int:
        """Upper estimate; names of meshes (file paths) count with the longest one seen, four bytes a character."""
        longer = max(0, 4 * (self.seen.get("_longest") or 0) - 64) if "mesh_id" in self.df.columns else 0
        return self.rows * (_width(self.df.schema) + longer)

    def of(self, df: DataFrame) -> "KeyTable":
        """The same keys with other columns."""
        return KeyTable(df, self.rows, self.seen, self.hot)

    def with_hot(self, size: str, keys: Sequence[str] = MESH, limit: int = BROADCAST_BYTES, most: int = HOT_ROWS) -> "KeyTable":
        """Note the keys whose ``size`` column exceeds ``most``; needless while the table can be broadcast."""
        if self.bytes <= limit:
            return self
        parts = F.ceil(F.col(size) / F.lit(most)).cast("int").alias("_parts")
        hot = settle(self.df.where(F.col(size) > most).select(*keys, parts), "hot")
        return KeyTable(self.df, self.rows, self.seen, hot)


def settle(df: DataFrame, label: str = "keys", like: KeyTable | None = None, **figures: Column) -> KeyTable:
    """Write a key table; its row count and ``figures`` are observed by the same job.

    ``like`` is a table with the same keys whose hot keys are hot here as well.
    """
    watch = Observation()
    if "mesh_id" in df.columns:
        figures["_longest"] = F.max(F.length("mesh_id"))
    counted = df.observe(watch, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in figures.items()])
    written = materialize(counted, label)
    seen = watch.get
    return KeyTable(written, seen["rows"], seen, like.hot if like else None)


def attach(
    rows: DataFrame,
    table: KeyTable,
    on: Sequence[str] = MESH,
    how: str = "inner",
    spread: Sequence[str] | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``rows`` with ``table``.

    The table is broadcast when its size is proven to be within ``limit``. Beyond that
    both sides are shuffled; a key known to be hot is cut into parts (its rows by a hash
    of ``spread``, its table row by copies), all other keys stay whole. Hot keys nobody
    knew of are left to the run-time skew join.
    """
    on = list(on)
    if table.bytes <= limit:
        return rows.join(F.broadcast(table.df), on, how)
    if table.hot is None or table.hot.rows == 0 or table.hot.bytes > BROADCAST_BYTES:
        return rows.join(table.df, on, how)
    spread = list(spread or [c for c in rows.columns if c not in on] or on)
    hot = F.broadcast(table.hot.df)
    parts = F.coalesce("_parts", F.lit(1))
    cut = rows.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    copies = table.df.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return cut.drop("_parts").join(copies.drop("_parts"), on + ["_part"], how).drop("_part")


def with_ordinals(rows: DataFrame, id_col: str, keys: Sequence[str] = MESH, name: str = "ord") -> DataFrame:
    """Number rows 0..n-1 per key in ``id_col`` order without sorting a key in one task.

    Rows are range-partitioned by key and id and written once; each range is numbered alone
    and the ranges' running totals (one row per key and range) supply the offsets. How the
    ids are spread makes no difference.
    """
    keys = list(keys)
    ranged = materialize(rows.repartitionByRange(*keys, id_col).withColumn("_part", F.spark_partition_id()), "ordered")
    totals = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_part").orderBy(id_col)
    return (
        ranged.withColumn("_local", F.row_number().over(inside) - 1)
        .join(offsets, keys + ["_part"])
        .withColumn(name, (F.col("_off") + F.col("_local")).cast("long"))
        .drop("_part", "_local", "_off")
    )


def block_count(n: str | Column = "n", size: int = BLOCK) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.ceil(n / F.lit(size))).cast("long")
