"""Variance-based sensitivity by pick and freeze: first-order, total and pair effects with a jackknife.

The sample design is a table of fixed low-discrepancy points: two independent sets A and B of every
input. A model is evaluated on A, on B, on A with one input taken from B and on B with one input
taken from A, as columns of one row, and its indices are ratios of partial sums by key and block of
runs. So nothing is held per key but one row of sums a block, and leaving out one block at a time
gives the standard errors.

Defined cases: keys whose model is constant, or null or NaN in a run, have null indices; pairs are
the effect of two inputs together beyond both of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

Prior = Callable[[Column, Column], Column]    # two uniform numbers -> value of an input
Model = Callable[[dict[str, Column]], Column]

BLOCKS = 16


def steps(dimensions: int) -> list[float]:
    """Step of each coordinate: powers of 1 / g, with g the positive root of x^(d + 1) = x + 1."""
    g = 2.0
    for _ in range(64):
        g = (1.0 + g) ** (1.0 / (dimensions + 1))
    return [g ** -(j + 1) % 1.0 for j in range(dimensions)]


def names(inputs: Sequence[str]) -> list[str]:
    """Columns of the design: two uniform numbers for each input of A and of B."""
    return [f"{part}_{side}_{x}" for x in inputs for side in "ab" for part in "uv"]


def design(spark: SparkSession, inputs: Sequence[str], runs: int) -> DataFrame:
    """(run, block, columns of ``names``): ``runs`` points of the open unit cube."""
    columns = names(inputs)
    at = [(F.col("run") + 1) * F.lit(a) + 0.5 for a in steps(len(columns))]
    return spark.range(runs).withColumnRenamed("id", "run").select(
        "run", (F.col("run") % BLOCKS).alias("block"), *[(x - F.floor(x)).alias(c) for x, c in zip(at, columns, strict=True)])


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def pick_freeze(rows: DataFrame, inputs: dict[str, Prior], model: Model) -> DataFrame:
    """``rows`` (keys joined with a design) with y_a, y_b and, for each input x, y_ab_x and y_ba_x."""
    sides = {side: {x: prior(F.col(f"u_{side}_{x}"), F.col(f"v_{side}_{x}")) for x, prior in inputs.items()} for side in "ab"}
    rows = rows.withColumns({f"x_{side}_{x}": value for side, of in sides.items() for x, value in of.items()})
    a, b = ({x: F.col(f"x_{side}_{x}") for x in inputs} for side in "ab")
    out = {"y_a": model(a), "y_b": model(b)}
    for x in inputs:
        out[f"y_ab_{x}"] = model(a | {x: b[x]})
        out[f"y_ba_{x}"] = model(b | {x: a[x]})
    return rows.withColumns(out)


def _sums(inputs: Sequence[str]) -> dict[str, Column]:
    y = F.col
    out = {"n": F.count(F.lit(1)).cast("double"), "s1": F.sum(y("y_a") + y("y_b")), "s2": F.sum(y("y_a") * y("y_a") + y("y_b") * y("y_b"))}
    for x in inputs:
        out[f"f_{x}"] = F.sum(y("y_b") * (y(f"y_ab_{x}") - y("y_a")))
        out[f"t_{x}"] = F.sum((y("y_a") - y(f"y_ab_{x}")) * (y("y_a") - y(f"y_ab_{x}")))
    for p, q in itertools.combinations(inputs, 2):
        out[f"p_{p}_{q}"] = F.sum(y(f"y_ba_{p}") * y(f"y_ab_{q}") - y("y_a") * y("y_b"))
    return out


def _effects(inputs: Sequence[str]) -> dict[tuple[str, str], Column]:
    n, mean = F.col("n"), F.col("s1") / (2.0 * F.col("n"))
    variance = F.col("s2") / (2.0 * n) - mean * mean
    variance = F.when(variance > 1e-12 * mean * mean, variance)  # constant up to rounding: no indices
    first = {x: F.col(f"f_{x}") / n / variance for x in inputs}
    out = {("first", x): first[x] for x in inputs}
    out |= {("total", x): F.col(f"t_{x}") / (2.0 * n) / variance for x in inputs}
    return out | {("pair", f"{p}*{q}"): F.col(f"p_{p}_{q}") / n / variance - first[p] - first[q] for p, q in itertools.combinations(inputs, 2)}


def sobol_indices(evaluated: DataFrame, inputs: Sequence[str], keys: Sequence[str] = ("mesh_id",)) -> DataFrame:
    """(keys, effect: first, total or pair, source, value, error) from rows of ``pick_freeze``."""
    keys, inputs = list(keys), list(inputs)
    sums = _sums(inputs)
    parts = evaluated.groupBy(*keys, "block").agg(*[c.alias(k) for k, c in sums.items()])
    others = Window.partitionBy(*keys)  # BLOCKS rows a key
    left = parts.select(*keys, "block", *[(F.sum(c).over(others) - F.col(c)).alias(c) for c in sums])
    whole = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*keys, F.lit(-1).cast("long").alias("block"), *sums)
    effects = F.inline(F.array(*[
        F.struct(F.lit(e).alias("effect"), F.lit(s).alias("source"), c.alias("theta")) for (e, s), c in _effects(inputs).items()]))
    each = left.where("n > 0").union(whole).select(*keys, "block", effects)
    without = F.when(F.col("block") >= 0, F.col("theta"))
    found = each.groupBy(*keys, "effect", "source").agg(
        F.max(F.when(F.col("block") < 0, F.col("theta"))).alias("value"), F.count(without).alias("_b"), F.var_pop(without).alias("_v"))
    return found.select(*keys, "effect", "source", "value", F.sqrt((F.col("_b") - 1) * F.col("_v")).alias("error"))
