"""One-dimensional Gaussian mixtures of weighted positions, chosen by BIC."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from footfall.functions import constants as K

VARIANCE_FLOOR = 1e-6
TOLERANCE = 1e-3
MAX_ITERATIONS = 100

RESULT = T.StructType(
    [T.StructField("n_modes", T.IntegerType()), T.StructField("bic", T.DoubleType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("means", "stds", "weights")]
)


def _log_density(x, mean, var, share):
    with np.errstate(divide="ignore"):
        return np.log(share)[:, None, :] - 0.5 * (
            np.log(2 * np.pi * var)[:, None, :] + (x[:, :, None] - mean[:, None, :]) ** 2 / var[:, None, :]
        )


def _weighted_start(x, n, k, most=50):
    """Component centres at the middle of k equal slices of the weight, then settled by nearest centre."""
    rows = np.arange(len(x))
    cum = np.cumsum(n, axis=1)
    centre = np.stack([
        x[rows, np.minimum((cum < (c + 0.5) / k * cum[:, -1:]).sum(axis=1), x.shape[1] - 1)] for c in range(k)
    ], axis=1)
    for _ in range(most):
        near = np.abs(x[:, :, None] - centre[:, None, :]).argmin(axis=2)
        member = (near[:, :, None] == np.arange(k)) * n[:, :, None]
        mass = member.sum(axis=1)
        moved = np.where(mass > 0, (member * x[:, :, None]).sum(axis=1) / np.maximum(mass, 1e-300), centre)
        if np.allclose(moved, centre, rtol=0, atol=1e-12):
            break
        centre = moved
    return member / np.maximum(n[:, :, None], 1e-300)


def _parameters(x, n, resp):
    mass = (n[:, :, None] * resp).sum(axis=1) + 10 * np.finfo(float).eps
    mean = (n[:, :, None] * resp * x[:, :, None]).sum(axis=1) / mass
    var = (n[:, :, None] * resp * (x[:, :, None] - mean[:, None, :]) ** 2).sum(axis=1) / mass + VARIANCE_FLOOR
    return mean, var, mass / mass.sum(axis=1, keepdims=True)


def fit_mixtures(x: np.ndarray, n: np.ndarray, k: int, rounds: int | None = None):
    """Expectation-maximisation for a batch of weighted 1-D histograms of equal length.

    With ``rounds`` given, centres are not settled first and exactly so many rounds follow, so that any engine can
    repeat them.
    """
    total = n.sum(axis=1)
    mean, var, share = _parameters(x, n, _weighted_start(x, n, k, 50 if rounds is None else 1))
    previous = np.full(len(x), -np.inf)
    active = np.ones(len(x), dtype=bool)
    for _ in range(MAX_ITERATIONS if rounds is None else rounds):
        at = np.flatnonzero(active)
        if not at.size:
            break
        logp = _log_density(x[at], mean[at], var[at], share[at])
        top = logp.max(axis=2, keepdims=True)
        norm = top[..., 0] + np.log(np.exp(logp - top).sum(axis=2))
        mean[at], var[at], share[at] = _parameters(x[at], n[at], np.exp(logp - norm[:, :, None]))
        level = (n[at] * norm).sum(axis=1) / total[at]
        active[at] = (np.abs(level - previous[at]) >= TOLERANCE) | (rounds is not None)
        previous[at] = level
    logp = _log_density(x, mean, var, share)
    top = logp.max(axis=2, keepdims=True)
    loglik = (n * (top[..., 0] + np.log(np.exp(logp - top).sum(axis=2)))).sum(axis=1)
    return mean, var, share, -2 * loglik + (3 * k - 1) * np.log(total)


def _select_mixture(xs: pd.Series, ns: pd.Series, rounds: int | None) -> pd.DataFrame:
    out = [None] * len(xs)
    for size in {len(v) for v in xs}:
        at = [i for i, v in enumerate(xs) if len(v) == size]
        if size == 0:
            for i in at:
                out[i] = (0, None, None, None, None)
            continue
        x = np.array([xs.iloc[i] for i in at], dtype="float64").reshape(len(at), size)
        n = np.array([ns.iloc[i] for i in at], dtype="float64").reshape(len(at), size)
        fits = {k: fit_mixtures(x, n, k, rounds) for k in (1, 2, 3)}
        for r, i in enumerate(at):
            best = min((k for k in fits if np.isfinite(fits[k][3][r])), key=lambda k: (fits[k][3][r], k), default=None)
            if best is None:
                out[i] = (0, None, None, None, None)
                continue
            mean, var, share, bic = (part[r] for part in fits[best])
            order = np.argsort(mean)
            out[i] = (best, float(bic), mean[order].tolist(), np.sqrt(var[order]).tolist(), share[order].tolist())
    return pd.DataFrame(out, columns=["n_modes", "bic", "means", "stds", "weights"])


def lateral_mixture(profile: DataFrame, rounds: int | None = None) -> DataFrame:
    """Best mixture of 1..3 components per mesh: (mesh_id, n_modes, bic, means, stds, weights).

    Profiles hold at most one row per grid column; meshes are fitted in batches. Fewer
    than ten replicates leave n_modes at 0. ``rounds`` fixes the number of rounds.
    """

    @F.pandas_udf(RESULT)
    def select(xs: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return _select_mixture(xs, ns, rounds)

    packed = profile.groupBy("mesh_id").agg(
        F.sum("weight").alias("n"), F.array_sort(F.collect_list(F.struct("x", "weight"))).alias("bins")
    )
    bins = F.when(F.col("n") >= K.LATERAL_MIN_SAMPLES, F.col("bins")).otherwise(F.slice("bins", 1, 0))
    return packed.select("mesh_id", bins.alias("bins")).select(
        "mesh_id",
        select(
            F.transform("bins", lambda b: b["x"]), F.transform("bins", lambda b: b["weight"].cast("double"))
        ).alias("m"),
    ).select("mesh_id", "m.*")
