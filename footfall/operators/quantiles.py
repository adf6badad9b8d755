"""Exact order statistics and ranks that never gather one key in a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from footfall.operators.keyed import MESH, attach, settle
from footfall.session import materialize

EXACT_BUFFER_ROWS = 1_000_000  # largest key sorted in one aggregation buffer
BINS = 1024                    # sub-intervals per narrowing pass
INF = float("inf")


def exact_quantiles(
    rows: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = MESH,
    bound: int = EXACT_BUFFER_ROWS,
    largest: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per key: columns ``keys, n, q`` (array, as ``probs``).

    Keys of up to ``bound`` rows are sorted in an aggregation buffer. Larger keys are narrowed
    by counting passes: each pass bins the bracket holding the wanted ranks and keeps
    one bin, so only (key, bin) partial counts are ever shuffled. ``largest`` may give
    a known upper limit of the rows per key. Values order as -inf, finite, inf, NaN; on both
    routes a quantile that falls between an infinity and a finite value is that infinity.
    """
    keys = list(keys)
    rows = rows.select(*keys, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if largest is not None and largest <= bound:
        return _buffered(rows, keys, probs)
    counts = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "qcount", largest=F.max("n"))
    if (counts.seen["largest"] or 0) <= bound:
        return _buffered(rows, keys, probs)
    hot = settle(counts.df.where(F.col("n") > bound).select(*keys), "qhot")
    calm = attach(rows, hot, keys, "left_anti", spread=["_v"])
    return _buffered(calm, keys, probs).unionByName(_narrowed(rows, keys, probs, hot))


def lerp(low: Column, high: Column, t: Column) -> Column:
    """Linear interpolation taken from the nearer end, so that both ends are met exactly.

    Equal ends and whole positions need no arithmetic, which infinities would spoil.
    """
    between = F.when(t < 0.5, low + (high - low) * t).otherwise(high - (high - low) * (1 - t))
    return F.when((t == 0) | low.eqNullSafe(high), low).otherwise(between)


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Quantile of an ascending array of a bounded group."""
    at = (F.size(ordered) - 1) * F.lit(float(p))
    k = F.floor(at).cast("int")
    return lerp(F.get(ordered, k), F.get(ordered, F.least(k + 1, F.size(ordered) - 1)), at - F.floor(at))


def _buffered(rows: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    ordered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_s"))
    return ordered.select(
        *keys, F.size("_s").cast("long").alias("n"), F.array(*[sorted_quantile(F.col("_s"), p) for p in probs]).alias("q")
    )


def _narrowed(rows: DataFrame, keys: list[str], probs: Sequence[float], hot) -> DataFrame:
    v = F.col("_v").cast("double")
    finite = (v > -INF) & (v < INF)
    wanted = F.array(*[F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    state = (
        attach(rows, hot, keys, spread=["_v"])
        .groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(v == -INF).alias("n_low"), F.count_if(v == INF).alias("n_high"), F.count_if(F.isnan(v)).alias("n_nan"),
            F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"),
        )
        .select("*", F.inline(wanted))
        .withColumn("pos", (F.col("n") - 1) * F.col("p"))
        .withColumn("k", F.floor("pos").cast("long"))
        .withColumn("next", F.least(F.col("k") + 1, F.col("n") - 1))
        .withColumn("last", F.col("n") - F.col("n_nan") - F.col("n_high") - 1)  # rank of the largest finite value
    )

    def special(rank: Column) -> Column:
        """The value at a rank among the infinities and NaNs, which have known ranks; null if it is finite."""
        beyond = F.when(rank < F.col("n") - F.col("n_nan"), F.lit(INF)).otherwise(F.lit(float("nan")))
        return F.when(rank < F.col("n_low"), F.lit(-INF)).when(rank > F.col("last"), beyond)

    here, after = special(F.col("k")), special(F.col("next"))
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    state = state.select(
        *keys, "pi", "n", "lo", "hi", F.col("n_low").alias("below"), "k", (F.col("pos") - F.col("k")).alias("frac"),
        F.coalesce(here, one, F.when(after.isNotNull(), F.col("hi"))).alias("xk"),
        F.coalesce(after, one, F.when(here.isNotNull(), F.col("lo"))).alias("xk1"),
    )
    id_cols = keys + ["pi"]
    done = None
    table = settle(state, "qstate")
    while True:
        resolved = table.df.where(F.col("xk").isNotNull())
        done = resolved if done is None else done.unionByName(resolved)
        table = settle(table.df.where(F.col("xk").isNull()), "qopen")
        if table.rows == 0:
            break
        table = settle(_narrow_once(rows, table, keys, id_cols), "qstate")
    values = done.withColumn("x", lerp(F.col("xk"), F.col("xk1"), F.col("frac")))
    return values.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pi", "x"))), lambda s: s["x"]).alias("q"),
    )


def _narrow_once(rows: DataFrame, table, keys: list[str], id_cols: list[str]) -> DataFrame:
    # Each rounding step is monotone, so bin order agrees with value order. Halves can't overflow.
    # The ends always fall into different bins, so that every pass leaves fewer distinct values.
    part = F.try_divide(F.col("_v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
    inner = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.coalesce(part, F.lit(0.0)) * BINS)))
    bin_no = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), BINS - 1).otherwise(inner).cast("int")
    bins = (
        attach(rows, table, keys, spread=["_v"])
        .where(F.col("_v").between(F.col("lo"), F.col("hi")))
        .groupBy(*id_cols, bin_no.alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("bmin"), F.max("_v").alias("bmax"))
    )
    upto = Window.partitionBy(*id_cols).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    state = table.df.select(*id_cols, "n", "below", "k", "frac")
    placed = (
        bins.withColumn("cum", F.sum("c").over(upto))
        .join(state, id_cols)
        .withColumn("last", F.col("below") + F.col("cum") - 1)
        .withColumn("first", F.col("last") - F.col("c") + 1)
    )
    next_rank = F.least(F.col("k") + 1, F.col("n") - 1)

    def holds(rank):
        return (F.col("first") <= rank) & (rank <= F.col("last"))

    picked = placed.groupBy(*id_cols).agg(
        F.first("n").alias("n"), F.first("k").alias("k"), F.first("frac").alias("frac"),
        F.max(F.when(holds(F.col("k")), F.struct("bin", "bmin", "bmax", "first"))).alias("a"),
        F.max(F.when(holds(next_rank), F.struct("bin", "bmin", "bmax", "first"))).alias("b"),
    )
    split = F.col("a.bin") != F.col("b.bin")
    single = (F.col("a.bin") == F.col("b.bin")) & (F.col("a.bmin") == F.col("a.bmax"))
    return picked.select(
        *id_cols, "n", F.col("a.bmin").alias("lo"), F.col("a.bmax").alias("hi"),
        F.col("a.first").alias("below"), "k", "frac",
        F.when(split | single, F.col("a.bmax")).alias("xk"),
        F.when(split | single, F.col("b.bmin")).alias("xk1"),
    )


def average_ranks(rows: DataFrame, value: str, keys: Sequence[str], **carried: Column) -> DataFrame:
    """Distinct values per key with their tie-averaged rank: ``keys, value, rank, repeats``.

    Values are counted first, range-partitioned, and ranked by running totals within
    each range plus the totals of the ranges before it. ``carried`` adds further
    aggregates of the rows sharing a value.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("c"), *[agg.alias(name) for name, agg in carried.items()]
    )
    # Written once: both the ranges' totals and the ranking must see the same ranges.
    ranged = materialize(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "rank")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_part").agg(F.sum("c").alias("pc"))
        .select(*keys, "_part", F.coalesce(F.sum("pc").over(before), F.lit(0)).alias("off"))
    )
    upto = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("cum", F.sum("c").over(upto))
        .join(offsets, keys + ["_part"])
        .select(
            *keys, F.col("_v").alias(value),
            (F.col("off") + F.col("cum") - (F.col("c") - 1) / 2.0).alias("rank"), F.col("c").alias("repeats"), *carried,
        )
    )


def spearman_squared(rows: DataFrame, columns: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Squared rank correlation of each column with the target: ``keys, column, rho2``; 0 when either is constant.

    Target ranks are looked up once per row. Each column is then grouped by value with
    the sum of target ranks riding along, so ranking it already yields the products.
    """
    keys = list(keys)
    y = settle(average_ranks(rows.select(*keys, F.col(target).cast("double").alias("y")), "y", keys), "ranks")
    y = y.with_hot("repeats", [*keys, "y"])
    known = rows.select(*keys, F.col(target).cast("double").alias("y"), *columns)
    ranked = attach(known, y.of(y.df.select(*keys, "y", F.col("rank").alias("ry"))), [*keys, "y"], spread=list(columns))
    long = ranked.select(*keys, "ry", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns
    ])))
    x = average_ranks(long, "x", [*keys, "column"], ry=F.sum("ry"))
    c, rank = F.col("repeats"), F.col("rank")
    of_y = y.df.groupBy(*keys).agg(
        F.sum(c).alias("n"), F.sum(c * rank).alias("sy"), F.sum(c * rank * rank).alias("syy"), F.count(F.lit(1)).alias("ny")
    )
    of_x = x.groupBy(*keys, "column").agg(
        F.sum(c * rank).alias("sx"), F.sum(c * rank * rank).alias("sxx"), F.sum(rank * F.col("ry")).alias("sxy"),
        F.count(F.lit(1)).alias("nx"),
    )
    n = F.col("n")

    def spread_of(both: str, p: str, q: str) -> Column:
        return F.col(both) / n - F.col(p) / n * (F.col(q) / n)

    rho2 = F.try_divide(
        F.pow(spread_of("sxy", "sx", "sy"), 2), spread_of("sxx", "sx", "sx") * spread_of("syy", "sy", "sy")
    )
    flat = (F.col("nx") == 1) | (F.col("ny") == 1)
    return of_x.join(of_y, keys).select(*keys, "column", F.when(flat, F.lit(0.0)).otherwise(rho2).alias("rho2"))
