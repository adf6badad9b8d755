"""Steps of a flight compared with each other: trend, replaced steps, shifts along the flight.

A flight is a key, a step a numbered row of it. Flights of any length are handled by sums per key,
by range partitions and by counts per bin, never by a window over a whole flight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from footfall.operators.keyed import attach, settle
from footfall.operators.quantiles import exact_quantiles
from footfall.session import materialize

SIGMAS = 2.0
FLAT = 1e-12  # part of the whole variation below which what is left is rounding


def trend(steps: DataFrame, keys: Sequence[str], x: str = "step", y: str = "depth", weight: str | None = None) -> DataFrame:
    """Parabola of ``y`` over ``x`` per key, from centred moments up to the fourth, each row counting ``weight`` (1).

    Columns: n, x_mean, y_mean, b1 (by x - x_mean), m1 = m3 / m2 and m0 = m2 (the second polynomial is
    (x - x_mean)^2 - m1 (x - x_mean) - m0), b2 (by the second polynomial), q1 and q2 (sums of squares of both
    polynomials), sse, sigma (residual standard deviation) and rank: 3, or 2 or 1 where the steps stand at fewer
    than three or two places (b2 or both are then zero). Without a degree of freedom, or with nothing left but
    rounding, sigma is null. Rows with a null or NaN value, or without a weight above 0, are left out.
    """
    keys = list(keys)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = steps.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL AND w > 0 AND NOT isnan(y)")
    w = F.col("w")
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum("w")).alias(f"{c}_mean")
    means = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("whole"), mean("x"), mean("y")), "trend-means")
    means = means.with_hot("n", keys)
    at = attach(rows, means.of(means.df.select(*keys, "x_mean", "y_mean")), keys, spread=["x", "y"]).select(
        *keys, "w", (F.col("x") - F.col("x_mean")).alias("x"), (F.col("y") - F.col("y_mean")).alias("y"))
    x1, y1 = F.col("x"), F.col("y")
    sums = at.groupBy(*keys).agg(*[F.sum(w * v).alias(k) for k, v in (
        ("x2", x1 * x1), ("x3", x1 * x1 * x1), ("x4", x1 * x1 * x1 * x1), ("xy", x1 * y1), ("xxy", x1 * x1 * y1), ("yy", y1 * y1))])
    fit = means.df.join(sums, keys)
    fit = fit.withColumn("q1", F.col("x2")).withColumns({
        "m0": F.col("x2") / F.col("whole"), "m1": F.when(F.col("q1") > 0, F.col("x3") / F.col("q1")).otherwise(0.0)})
    fit = fit.withColumn("q2", F.col("x4") - F.col("m1") * F.col("x3") - F.col("m0") * F.col("x2"))
    straight, bent = F.col("q1") > 0, F.col("q2") > FLAT * F.col("x4")
    fit = fit.withColumns({
        "b1": F.when(straight, F.col("xy") / F.col("q1")).otherwise(0.0),
        "b2": F.when(bent, (F.col("xxy") - F.col("m1") * F.col("xy")) / F.col("q2")).otherwise(0.0),
        "rank": F.when(bent, 3).when(straight, 2).otherwise(1)})
    left = F.col("yy") - F.col("b1") * F.col("b1") * F.col("q1") - F.col("b2") * F.col("b2") * F.col("q2")
    fit = fit.withColumn("sse", F.greatest(F.lit(0.0), left))
    free = F.col("n") - F.col("rank")
    fit = fit.withColumn("sigma", F.when((free > 0) & (F.col("sse") > FLAT * F.col("yy")), F.sqrt(F.col("sse") / free)))
    return fit.select(*keys, "n", "x_mean", "y_mean", "m0", "m1", "q1", "q2", "b1", "b2", "rank", "sse", "sigma")


def consistency(steps: DataFrame, keys: Sequence[str], x: str = "step", y: str = "depth", sigmas: float = SIGMAS) -> DataFrame:
    """Each row of ``steps`` with its ``expected`` value, ``studentised`` residual and ``wear``.

    A residual is over its own standard deviation (sigma times the root of 1 - leverage). ``wear`` is LOWER or
    HIGHER beyond ``sigmas``, else CONSISTENT; it is UNKNOWN, with a null residual, where sigma or the value is
    null or where the step alone decides its own expectation (leverage 1).
    """
    keys = list(keys)
    fits = settle(trend(steps, keys, x, y), "trend").with_hot("n", keys)
    figures = ("n", "x_mean", "y_mean", "m0", "m1", "q1", "q2", "b1", "b2", "rank", "sigma")
    own = fits.of(fits.df.select(*keys, *[F.col(c).alias(f"_{c}") for c in figures]))
    rows = attach(steps, own, keys, "left", spread=[c for c in (x, y) if c not in keys])
    p1 = F.col(x).cast("double") - F.col("_x_mean")
    p2 = p1 * p1 - F.col("_m1") * p1 - F.col("_m0")
    expected = F.col("_y_mean") + F.col("_b1") * p1 + F.col("_b2") * p2
    leverage = 1.0 / F.col("_n") + F.when(F.col("_rank") > 1, p1 * p1 / F.col("_q1")).otherwise(0.0) + F.when(
        F.col("_rank") > 2, p2 * p2 / F.col("_q2")).otherwise(0.0)
    value = F.nanvl(F.col(y).cast("double"), F.lit(None).cast("double"))
    residual = F.when(leverage < 1 - 1e-9, (value - expected) / (F.col("_sigma") * F.sqrt(1 - leverage)))
    out = rows.withColumns({"expected": expected, "studentised": residual})
    wear = F.when(F.col("studentised") < -sigmas, "LOWER").when(F.col("studentised") > sigmas, "HIGHER").when(
        F.col("studentised").isNull(), "UNKNOWN").otherwise("CONSISTENT")
    return out.withColumn("wear", wear).drop(*[f"_{c}" for c in figures])


def numbered(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``rows`` range-partitioned by key and order, with their range in ``_part``; written once."""
    return materialize(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "flight-ranges")


def neighbours(steps: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows with the ``before`` and ``after`` value of their flight, across the borders of range partitions.

    Rows of equal place are ordered by their value. Of each range and flight only its first and last value
    go to its neighbours.
    """
    order = [*order, value]
    ranged = numbered(steps, key, order)
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    rows = ranged.withColumns({"_before": F.lag(value).over(inside), "_after": F.lead(value).over(inside), "_k": F.row_number().over(inside)})
    place = F.struct(*order, F.col(value).alias("_v"))
    ends = ranged.groupBy(key, "_part").agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(key).orderBy("_part")  # one row a range
    ends = ends.select(key, "_part", "_n", F.lag("_hi").over(across)["_v"].alias("_left"), F.lead("_lo").over(across)["_v"].alias("_right"))
    rows = rows.join(ends, [key, "_part"])
    return rows.withColumns({
        "before": F.when(F.col("_k") == 1, F.col("_left")).otherwise(F.col("_before")),
        "after": F.when(F.col("_k") == F.col("_n"), F.col("_right")).otherwise(F.col("_after")),
    }).drop("_before", "_after", "_k", "_n", "_left", "_right", "_part")


NORMAL_MAD = 1.4826  # a normal distribution's standard deviation over its median absolute deviation


def replaced_steps(steps: DataFrame, key: str, order: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """Rows with ``before``, ``after``, ``contrast`` and ``replaced``: much less worn than both neighbours.

    ``contrast`` is the value less the smaller neighbour (the only one at an end of the flight), in robust
    standard deviations of all such differences of the flight about their median (median absolute deviation).
    It is null without neighbours, or where more than half of the differences are equal.
    """
    rows = neighbours(steps.where(F.col(value).isNotNull()), key, order, value)
    rows = materialize(rows.withColumn("_gap", F.col(value) - F.least("before", "after")), "flight-gaps")
    known = rows.where("_gap IS NOT NULL").select(key, "_gap")
    middle = settle(exact_quantiles(known, "_gap", (0.5,), [key]).select(key, F.col("q")[0].alias("_m"), F.col("n").alias("_n")), "flight-medians").with_hot("_n", (key,))
    away = attach(known, middle.of(middle.df.drop("_n")), [key], spread=["_gap"]).select(key, F.abs(F.col("_gap") - F.col("_m")).alias("_away"))
    mad = exact_quantiles(away, "_away", (0.5,), [key]).select(key, F.col("q")[0].alias("_mad"))
    both = settle(middle.df.join(mad, key), "flight-spreads").with_hot("_n", (key,))
    out = attach(rows, both.of(both.df.drop("_n")), [key], "left", spread=[*order, value])
    contrast = F.when(F.col("_mad") > 0, (F.col("_gap") - F.col("_m")) / (NORMAL_MAD * F.col("_mad")))
    out = out.withColumn("contrast", contrast)
    return out.withColumn("replaced", F.coalesce(F.col("contrast") < -limit, F.lit(False))).drop("_gap", "_m", "_mad")


def shifts(steps: DataFrame, key: str, order: Sequence[str], value: str, gain: float, rounds: int = 3) -> DataFrame:
    """Segments of each flight between shifts of the mean: (key, first, last, n, mean), ordinals from 0.

    Binary segmentation: the best split of a segment is the one with the largest drop of squared deviations;
    it is taken if that drop is at least ``gain`` times the flight's variance (population). Sums up to a row
    come from its range's sums and those of the ranges before it. Equal gains split at the smallest place.
    """
    ordered = numbered(steps.where(F.col(value).isNotNull()), key, [*order, value])
    sums = ordered.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"))
    inside = Window.partitionBy(key, "_part").orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    rows = ordered.withColumns({"_k": F.count(F.lit(1)).over(inside), "_c": F.sum(value).over(inside)}).join(offsets, [key, "_part"])
    rows = materialize(rows.select(key, (F.col("_n0") + F.col("_k")).alias("upto"), (F.col("_s0") + F.col("_c")).alias("total")), "flight-sums")
    spread = ordered.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.var_pop(value).alias("_var"), F.sum(value).alias("_all"))
    spread = materialize(spread, "flight-spreads")
    segments = spread.select(key, F.lit(0).cast("long").alias("lo"), F.col("_n").alias("hi"), F.lit(0.0).alias("s_lo"), F.col("_all").alias("s_hi"), F.lit(True).alias("open"))
    for _ in range(rounds):
        held = settle(segments, "flight-segments")
        cut = attach(rows, held.of(held.df.where("open")), [key], spread=["upto"]).where("upto > lo AND upto < hi")
        n, m = F.col("upto") - F.col("lo"), F.col("hi") - F.col("upto")
        step = (F.col("total") - F.col("s_lo")) / n - (F.col("s_hi") - F.col("total")) / m
        drop = step * step * n * m / (F.col("hi") - F.col("lo"))
        best = cut.groupBy(key, "lo").agg(F.max(F.struct(drop.alias("drop"), (-F.col("upto")).alias("at"), F.col("total").alias("s_at"))).alias("best"))
        found = held.df.join(best, [key, "lo"], "left").join(spread.select(key, "_var"), key)
        taken = F.col("open") & F.coalesce((F.col("best.drop") >= gain * F.col("_var")) & (F.col("best.drop") > 0), F.lit(False))
        at, s_at = -F.col("best.at"), F.col("best.s_at")
        piece = lambda lo, hi, s, t, o: F.struct(lo.alias("lo"), hi.alias("hi"), s.alias("s_lo"), t.alias("s_hi"), F.lit(o).alias("open"))
        whole = [F.col(c) for c in ("lo", "hi", "s_lo", "s_hi")]
        split = F.array(piece(whole[0], at, whole[2], s_at, True), piece(at, whole[1], s_at, whole[3], True))
        segments = found.select(key, F.inline(F.when(taken, split).otherwise(F.array(piece(*whole, False)))))
    held = materialize(segments, "flight-segments")
    n = F.col("hi") - F.col("lo")
    return held.select(key, F.col("lo").alias("first"), (F.col("hi") - 1).alias("last"), n.alias("n"), ((F.col("s_hi") - F.col("s_lo")) / n).alias("mean"))
