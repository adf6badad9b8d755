"""Posteriors from sums per mesh: reference plane (closed form and chains), orientation, scale.

Everything rests on one aggregation of the points or faces; what follows has one row a mesh (or one a
mesh and chain), whatever the size of a mesh.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import geometry as G
from footfall.functions.text import fixed

SLOPE_WEIGHT = 1e-6    # prior of the slopes: as many square metres of points on a level plane
CHAINS, STEPS, WARM, RUN = 4, 400, 100, 25
JUMP = 1.19            # 2.38 over the root of four unknowns
NAMES = ("slope_w", "slope_d", "height", "log_sigma")

CONTRAST = 4.0         # how much likelier faces look along the up axis than across it (log density, end to end)
FACES = 50             # faces are not independent: a mesh counts as at most so many
AMBIGUOUS = 0.05       # an alternative with more than this makes the answer ambiguous

# lognormal likelihood of a tread's measured extents: median in m, standard deviation of the log
TREAD_WIDTH = (1.2, 0.5)
TREAD_DEPTH = (0.3, 0.4)


# --- plane -----------------------------------------------------------------------

def plane_moments(points: DataFrame) -> DataFrame:
    """n, means (mw, md, mu) and centred sums of squares and products of points (mesh_id, w, d, u)."""
    n = F.count(F.lit(1))
    return points.groupBy("mesh_id").agg(
        n.alias("n"), *[F.avg(c).alias(f"m{c}") for c in "wdu"], *[(n * F.var_pop(c)).alias(f"s{c}{c}") for c in "wdu"],
        *[(n * F.covar_pop(p, q)).alias(f"s{p}{q}") for p, q in (("w", "d"), ("w", "u"), ("d", "u"))])


def plane_posterior(moments: DataFrame, slope_weight: float = SLOPE_WEIGHT) -> DataFrame:
    """Exact posterior of u = slope_w w + slope_d d + c: Student t marginals with ``freedom`` degrees.

    Slopes have a normal prior about level, its variance the residual's over ``slope_weight``; the height is
    flat, the residual variance scale-free. ``height`` is that at the points' mean place. Standard deviations are
    null below three degrees of freedom. A mesh of one point, or whose points lie in one line, still has one.
    """
    sww, sdd, swd = F.col("sww") + slope_weight, F.col("sdd") + slope_weight, F.col("swd")
    det = sww * sdd - swd * swd
    rows = moments.withColumns({
        "slope_w": (F.col("swu") * sdd - F.col("sdu") * swd) / det, "slope_d": (F.col("sdu") * sww - F.col("swu") * swd) / det,
        "height": F.col("mu"), "freedom": F.col("n") - 1})
    left = F.greatest(F.lit(0.0), F.col("suu") - F.col("slope_w") * F.col("swu") - F.col("slope_d") * F.col("sdu"))
    rows = rows.withColumn("sse", left)
    variance = F.when(F.col("freedom") > 2, F.col("sse") / (F.col("freedom") - 2))
    return rows.withColumns({
        "sigma": F.sqrt(variance), "slope_w_sd": F.sqrt(variance * sdd / det), "slope_d_sd": F.sqrt(variance * sww / det),
        "height_sd": F.sqrt(variance / F.col("n")), "slopes_correlation": -swd / F.sqrt(sww * sdd)})


@functools.cache
def _uniform(chain: int, steps: int) -> np.ndarray:
    """Five numbers a step in (0, 1) by rule: the first 32 bits of the MD5 of chain:step:place."""
    words = [hashlib.md5(f"{chain}:{t}:{j}".encode()).hexdigest()[:8] for t in range(1, steps + 1) for j in range(5)]
    return ((np.array([int(x, 16) for x in words]) + 0.5) / 2**32).reshape(steps, 5)


def _chain(m: dict[str, np.ndarray], chain: int, steps: int, slope_weight: float, steepest: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """States (4 x meshes) and acceptances of random-walk Metropolis on the log density, for many meshes at once."""
    n = m["n"].astype(float)
    sww, sdd, swd = m["sww"] + slope_weight, m["sdd"] + slope_weight, m["swd"]
    det = sww * sdd - swd * swd
    a0, b0 = (m["swu"] * sdd - m["sdu"] * swd) / det, (m["sdu"] * sww - m["swu"] * swd) / det
    s0 = np.sqrt(np.maximum(m["suu"] - a0 * m["swu"] - b0 * m["sdu"], 1e-18) / np.maximum(n - 1, 1))
    l11 = np.sqrt(sww)
    l21, l22 = swd / l11, np.sqrt(det / sww)

    def density(a, b, c, s):
        q = m["suu"] - 2 * a * m["swu"] - 2 * b * m["sdu"] + a * a * sww + 2 * a * b * swd + b * b * sdd + n * c * c
        out = -(n + 2) * s - q / (2 * np.exp(2 * s))
        return np.where(np.maximum(np.abs(a), np.abs(b)) <= steepest, out, -np.inf)

    far = 2.0 * (chain - 1.5)  # starts on both sides, up to three standard deviations away
    a, b, c, s = a0 + far * s0 / l11, b0 + far * s0 / l22, far * s0 / np.sqrt(n), np.log(s0) + far / np.sqrt(2 * np.maximum(n - 1, 1))
    a, b = np.clip(a, -steepest, steepest), np.clip(b, -steepest, steepest)
    here = density(a, b, c, s)
    for t, (u1, u2, u3, u4, u5) in enumerate(_uniform(chain, steps), 1):
        r1, r2 = JUMP * math.sqrt(-2 * math.log(u1)), JUMP * math.sqrt(-2 * math.log(u3))
        z1, z2, z3, z4 = r1 * math.cos(2 * math.pi * u2), r1 * math.sin(2 * math.pi * u2), r2 * math.cos(2 * math.pi * u4), r2 * math.sin(2 * math.pi * u4)
        step_b = s0 * z2 / l22
        to = (a + s0 * z1 / l11 - step_b * l21 / l11, b + step_b, c + s0 * z3 / np.sqrt(n), s + z4 / np.sqrt(2 * np.maximum(n - 1, 1)))
        there = density(*to)
        take = math.log(u5) < there - here
        a, b, c, s = (np.where(take, new, old) for new, old in zip(to, (a, b, c, s), strict=True))
        here = np.where(take, there, here)
        yield t, np.array([a, b, c, s]), take


def plane_chains(
    moments: DataFrame, chains: int = CHAINS, steps: int = STEPS, warm: int = WARM, slope_weight: float = SLOPE_WEIGHT, steepest: float | None = None
) -> DataFrame:
    """(mesh_id, chain, run, name, n, s1, s2, taken): sums over each ``RUN`` steps after ``warm`` of each chain.

    ``steepest`` bounds both slopes; the posterior then has no closed form. Chains start around the
    least-squares plane. ``height`` is counted from the mean height. Meshes of fewer than three points have no chain.
    """
    limit = math.inf if steepest is None else steepest
    columns = ["n", "sww", "sdd", "swd", "swu", "sdu", "suu"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            k = batch.num_rows
            for chain in range(chains) if k else ():
                s1, s2, taken = np.zeros((4, k)), np.zeros((4, k)), np.zeros(k)
                for t, state, take in _chain(m, chain, steps, slope_weight, limit):
                    if t <= warm:
                        continue
                    s1, s2, taken = s1 + state, s2 + state * state, taken + take
                    if (t - warm) % RUN == 0:
                        for i, name in enumerate(NAMES):
                            yield pa.RecordBatch.from_arrays([
                                batch.column("mesh_id"), pa.array(np.full(k, chain, np.int32)), pa.array(np.full(k, (t - warm) // RUN, np.int32)),
                                pa.array([name] * k), pa.array(np.full(k, RUN)), pa.array(s1[i]), pa.array(s2[i]), pa.array(taken),
                            ], names=["mesh_id", "chain", "run", "name", "n", "s1", "s2", "taken"])
                        s1, s2, taken = np.zeros((4, k)), np.zeros((4, k)), np.zeros(k)

    return moments.where("n > 2").select("mesh_id", *columns).mapInArrow(
        run, "mesh_id string, chain int, run int, name string, n long, s1 double, s2 double, taken double")


def chain_summary(runs: DataFrame) -> DataFrame:
    """(mesh_id, name, mean, sd, rhat, effective, accepted): moments and diagnostics of ``plane_chains``.

    rhat compares means between chains with variances within; ``effective`` is the number of independent draws
    that the scatter of run means allows. Both are null where nothing moved.
    """
    own = runs.groupBy("mesh_id", "name", "chain").agg(
        F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"), F.sum("taken").alias("taken"),
        F.avg("n").alias("run"), F.var_samp(F.col("s1") / F.col("n")).alias("of_runs"))
    mean = F.col("s1") / F.col("n")
    own = own.withColumns({"mean": mean, "within": (F.col("s2") / F.col("n") - mean * mean) * F.col("n") / (F.col("n") - 1)})
    both = own.groupBy("mesh_id", "name").agg(
        F.avg("mean").alias("mean"), F.avg("within").alias("w"), F.var_samp("mean").alias("between"), F.sum("n").alias("n"),
        F.avg("n").alias("each"), F.avg(F.col("run") * F.col("of_runs")).alias("long_run"), (F.sum("taken") / F.sum("n")).alias("accepted"))
    moved = lambda c, over: F.when(over > 0, c / over)
    kept = (F.col("each") - 1) / F.col("each")
    return both.select(
        "mesh_id", "name", "mean", F.sqrt(kept * F.col("w") + F.col("between")).alias("sd"),
        F.sqrt(moved(kept * F.col("w") + F.col("between"), F.col("w"))).alias("rhat"),
        moved(F.col("n") * F.col("w"), F.col("long_run")).alias("effective"), "accepted")


# --- orientation -----------------------------------------------------------------

def softmax(logs: Sequence[Column]) -> list[Column]:
    """Weights from their logarithms, by the largest first; null logs weigh nothing."""
    top = F.greatest(*logs)
    each = [F.coalesce(F.exp(x - top), F.lit(0.0)) for x in logs]
    total = functools.reduce(Column.__add__, each)
    return [x / total for x in each]


def entropy(weights: Sequence[Column]) -> Column:
    return functools.reduce(Column.__add__, [F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in weights])


def orientation_weights(tris: DataFrame, contrast: float = CONTRAST, faces: float = FACES) -> DataFrame:
    """(mesh_id, n_faces, p_x, p_y, p_z): probability of each axis being up, from the faces' normals.

    Under an up axis the density of a unit normal's absolute component along it grows exponentially, by
    ``contrast`` from 0 to 1. A mesh counts as at most ``faces`` independent faces. Faces without area say nothing.
    """
    normal = G.unit_normal(G.normal())
    rows = tris.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n_faces"), *[F.avg(F.abs(c)).alias(f"_{a}") for a, c in zip(G.XYZ, normal, strict=True)])
    logs = [contrast * F.least(F.col("n_faces").cast("double"), F.lit(float(faces))) * F.col(f"_{a}") for a in G.XYZ]
    return rows.select("mesh_id", "n_faces", *[p.alias(f"p_{a}") for a, p in zip(G.XYZ, softmax(logs), strict=True)])


def box_moments(vertices: DataFrame) -> DataFrame:
    """Count, extents, variances and covariances of a mesh's coordinates."""
    return vertices.groupBy("mesh_id").agg(
        F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(f"size_{c}") for c in G.XYZ],
        *[F.covar_pop(p, q).alias(f"c_{p}{q}") for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")])


def _assigned(up: str) -> dict[str, Column]:
    """Width, depth, residual and tilt of the plane if ``up`` is the up axis."""
    p, q = [a for a in G.XYZ if a != up]
    c = lambda i, j: F.col("c_" + "".join(sorted(i + j)))
    det = c(p, p) * c(q, q) - c(p, q) * c(p, q)
    usable = det > 1e-12 * c(p, p) * c(q, q)
    a = F.when(usable, (c(p, up) * c(q, q) - c(q, up) * c(p, q)) / det).otherwise(0.0)
    b = F.when(usable, (c(q, up) * c(p, p) - c(p, up) * c(p, q)) / det).otherwise(0.0)
    left = F.greatest(F.lit(0.0), c(up, up) - a * c(p, up) - b * c(q, up))
    return {
        "width": F.least(f"size_{p}", f"size_{q}"), "depth": F.greatest(f"size_{p}", f"size_{q}"),
        "residual": F.sqrt(left), "tilt": F.degrees(F.atan(F.sqrt(a * a + b * b)))}


def orientation_marginal(vertices: DataFrame, tris: DataFrame, contrast: float = CONTRAST, faces: float = FACES) -> DataFrame:
    """Width, depth, plane residual and plane tilt averaged over the three up axes, with their standard deviations.

    Columns beside these: p_x, p_y, p_z, ``up`` (the likeliest axis; the first of equals), ``entropy`` (nats) and
    ``ambiguous``: another axis has more than ``AMBIGUOUS``. A mesh without faces has equal probabilities.
    """
    rows = box_moments(vertices).join(orientation_weights(tris, contrast, faces), "mesh_id", "left")
    rows = rows.withColumns({f"p_{a}": F.coalesce(f"p_{a}", F.lit(1 / 3)) for a in G.XYZ})
    weights = [F.col(f"p_{a}") for a in G.XYZ]
    out = {}
    given = [_assigned(a) for a in G.XYZ]
    for name in given[0]:
        mean = functools.reduce(Column.__add__, [p * x[name] for p, x in zip(weights, given, strict=True)])
        out[name] = mean
        out[f"{name}_sd"] = F.sqrt(functools.reduce(Column.__add__, [p * (x[name] - mean) * (x[name] - mean) for p, x in zip(weights, given, strict=True)]))
    top = F.greatest(*weights)
    up = F.element_at(F.array(*[F.lit(a.upper()) for a in G.XYZ]), F.array_position(F.array(*weights), top).cast("int"))
    return rows.select(
        "mesh_id", "n", F.coalesce("n_faces", F.lit(0)).alias("n_faces"), *weights, up.alias("up"), entropy(weights).alias("entropy"),
        (1 - top > AMBIGUOUS).alias("ambiguous"), *[c.alias(k) for k, c in out.items()])


# --- scale -----------------------------------------------------------------------

def _log_normal(value: Column, median: float, sd: float) -> Column:
    """Log density of log ``value``, without the constant; nothing to say about extents of zero."""
    away = (F.ln(value) - math.log(median)) / sd
    return F.when(value > 0, -0.5 * away * away).otherwise(0.0)


def scale_posterior(
    rows: DataFrame, width: str = "width_raw", depth: str = "depth_raw",
    tread_width: tuple[float, float] = TREAD_WIDTH, tread_depth: tuple[float, float] = TREAD_DEPTH,
) -> DataFrame:
    """Adds the posterior of ``hypotheses`` (see ``scale_prior``) given the raw extents.

    ``posterior`` (the hypotheses with probabilities, likeliest first, then smaller scales), ``scale`` and ``unit``
    (the likeliest), ``log10_mean`` and ``log10_sd`` of the scale, ``entropy`` (nats), ``ambiguous`` (all others
    together have more than ``AMBIGUOUS``) and ``posterior_json``. Null extents and zeros leave the prior as it is.
    """
    extents = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), given) for c, given in ((width, tread_width), (depth, tread_depth))]
    fit = lambda h: sum((_log_normal(x * h["scale"], *given) for x, given in extents), F.ln(h["prob"]))
    rows = rows.withColumn("_log", F.transform("hypotheses", fit))
    top = F.array_max("_log")
    total = F.aggregate("_log", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    paired = F.zip_with("hypotheses", "_log", lambda h, x: F.struct((-F.exp(x - top) / total).alias("_less"), h["scale"].alias("scale"), h["label"].alias("label")))
    sorted_pairs = F.transform(F.array_sort(paired), lambda h: F.struct(h["scale"].alias("scale"), (-h["_less"]).alias("prob"), h["label"].alias("label")))
    rows = rows.withColumn("posterior", sorted_pairs).drop("_log")
    log10 = lambda h: F.log10(h["scale"])
    rows = rows.withColumn("log10_mean", F.aggregate("posterior", F.lit(0.0), lambda acc, h: acc + h["prob"] * log10(h)))
    spread = F.aggregate("posterior", F.lit(0.0), lambda acc, h: acc + h["prob"] * (log10(h) - F.col("log10_mean")) * (log10(h) - F.col("log10_mean")))
    best = F.col("posterior")[0]
    said = F.transform("posterior", lambda h: F.concat(F.lit('"'), h["label"], F.lit('": '), fixed(h["prob"], 4)))
    return rows.withColumns({
        "scale": best["scale"], "unit": best["label"], "log10_sd": F.sqrt(spread),
        "entropy": F.aggregate("posterior", F.lit(0.0), lambda acc, h: acc - F.when(h["prob"] > 0, h["prob"] * F.ln(h["prob"])).otherwise(0.0)),
        "ambiguous": 1 - best["prob"] > AMBIGUOUS, "posterior_json": F.concat(F.lit("{"), F.array_join(said, ", "), F.lit("}"))})
