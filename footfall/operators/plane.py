"""Robust reference plane: candidates, consensus fit, refit, bootstrap replicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from footfall.functions import constants as K
from footfall.functions import geometry as G
from footfall.operators.keyed import BLOCK, KeyTable, attach, block_count, settle, with_ordinals
from footfall.operators.quantiles import exact_quantiles
from footfall.session import materialize

CHUNK = 4096  # points held against all planes at once inside a task


@dataclass(frozen=True)
class PlaneFit:
    """Fitted planes (one row per mesh) and the numbered candidate points."""

    plane: KeyTable
    candidates: DataFrame


def border_points(points: DataFrame, frame_table: KeyTable) -> DataFrame:
    """Points in the outer strips along width or depth (union, strict bounds)."""
    edges = frame_table.of(frame_table.df.select("mesh_id", "w_min", "w_max", "d_min", "d_max"))

    def outer(axis: str) -> F.Column:
        lo, hi = F.col(f"{axis}_min"), F.col(f"{axis}_max")
        margin = F.lit(K.BORDER) * (hi - lo)
        return (F.col(axis) < lo + margin) | (F.col(axis) > hi - margin)

    return attach(points, edges, spread=["vid"]).where(outer("w") | outer("d")).select(*points.columns)


def plane_candidates(points: DataFrame, frame_table: KeyTable) -> DataFrame:
    """Border points; with more than 100 of them only the top height quartile."""
    strip = border_points(points, frame_table)
    high = settle(
        exact_quantiles(strip, "u", [K.TOP_QUANTILE], largest=frame_table.seen.get("most_vertices")).select(
            "mesh_id", F.when(F.col("n") > K.TOP_QUANTILE_ABOVE, F.col("q")[0]).alias("u_floor")
        ),
        "floor", frame_table,
    )
    return attach(strip, high, spread=["vid"]).where(
        F.col("u_floor").isNull() | (F.col("u") >= F.col("u_floor"))
    ).drop("u_floor")


def draw_triples(counts: DataFrame, iters: int, seed: int = K.RANSAC_SEED) -> DataFrame:
    """Index triples per mesh: (mesh_id, it, corner, ord). Every mesh restarts the generator."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mesh_id, n in zip(batch["mesh_id"], batch["n"]):
                rng = np.random.default_rng(seed)
                picks = np.array([rng.choice(n, 3, replace=False) for _ in range(iters)], dtype="int64")
                yield pd.DataFrame({
                    "mesh_id": mesh_id, "it": np.repeat(np.arange(iters), 3),
                    "corner": np.tile(np.arange(3), iters), "ord": picks.reshape(-1),
                })

    return counts.select("mesh_id", "n").mapInPandas(draw, "mesh_id string, it int, corner int, ord long")


def solve_triples(triples: DataFrame, numbered: DataFrame) -> DataFrame:
    """Planes through the drawn points: (mesh_id, it, a, b, c); degenerate triples drop out."""
    located = triples.join(numbered.select("mesh_id", "ord", "w", "d", "u"), ["mesh_id", "ord"])
    corners = located.groupBy("mesh_id", "it").agg(*[
        F.max(F.when(F.col("corner") == k, F.struct("w", "d", "u"))).alias(f"p{k}") for k in range(3)
    ])
    solved = corners.select("mesh_id", "it", G.plane_through("p0", "p1", "p2").alias("pl"))
    return solved.where(F.col("pl").isNotNull()).select("mesh_id", "it", "pl.*")


def _spread_planes(planes: DataFrame, counts: KeyTable, size: int) -> DataFrame:
    """One copy of a mesh's planes per block of its rows."""
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), block_count(size=size) - 1))
    return attach(planes, counts.of(counts.df.select("mesh_id", "n")), spread=["it"]).select(
        *planes.columns, blocks.alias("block")
    )


def inlier_counts(numbered: DataFrame, planes: DataFrame, counts: KeyTable, thresh_m: float, size: int = BLOCK) -> DataFrame:
    """Points within the threshold of each plane: (mesh_id, it, inliers).

    Points are cut into blocks of bounded size per mesh; each task group scores a block
    against all planes as an array product and emits one partial count per plane.
    """

    def score(key: tuple[Any, ...], points: pd.DataFrame, hyps: pd.DataFrame) -> pd.DataFrame:
        if points.empty or hyps.empty:
            return pd.DataFrame({
                "mesh_id": np.array([], dtype=object), "it": np.array([], dtype="int32"),
                "inliers": np.array([], dtype="int64"),
            })
        abc = hyps[["a", "b", "c"]].to_numpy()
        wdu = points[["w", "d", "u"]].to_numpy()
        total = np.zeros(len(abc), dtype="int64")
        for at in range(0, len(wdu), CHUNK):
            w, d, u = wdu[at:at + CHUNK].T
            gap = abc[:, :1] * w + abc[:, 1:2] * d + abc[:, 2:] - u
            total += (np.abs(gap) < thresh_m).sum(axis=1)
        return pd.DataFrame({"mesh_id": key[0], "it": hyps["it"].to_numpy(), "inliers": total})

    blocks = numbered.select("mesh_id", F.floor(F.col("ord") / F.lit(size)).alias("block"), "w", "d", "u")
    partial = blocks.groupBy("mesh_id", "block").cogroup(
        _spread_planes(planes, counts, size).groupBy("mesh_id", "block")
    ).applyInPandas(score, "mesh_id string, it int, inliers long")
    return partial.groupBy("mesh_id", "it").agg(F.sum("inliers").alias("inliers"))


def best_plane(scored: DataFrame, planes: DataFrame) -> DataFrame:
    """Most supported plane per mesh; the earliest wins a tie; zero support never wins."""
    ranked = scored.where(F.col("inliers") > 0).join(planes, ["mesh_id", "it"])
    return ranked.groupBy("mesh_id").agg(
        F.max_by(F.struct("a", "b", "c", "inliers"), F.struct("inliers", -F.col("it"))).alias("best")
    ).select("mesh_id", "best.*")


def inlier_points(candidates: DataFrame, best: KeyTable, thresh_m: float) -> DataFrame:
    gap = G.plane_height(F.col("ha"), F.col("hb"), F.col("hc"), F.col("w"), F.col("d")) - F.col("u")
    hyp = best.of(best.df.select("mesh_id", "ha", "hb", "hc"))
    return attach(candidates, hyp, spread=["vid"]).where(F.abs(gap) < thresh_m).drop("ha", "hb", "hc")


def ols_planes(points: DataFrame, keys=("mesh_id",)) -> DataFrame:
    """Least-squares plane per key with the point count n."""
    moments = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *G.plane_moments())
    return moments.select(*keys, "n", G.plane_from_moments().alias("pl")).select(*keys, "n", "pl.*")


def rms_mm(points: DataFrame, planes: KeyTable) -> DataFrame:
    gap = G.plane_height(F.col("a"), F.col("b"), F.col("c"), F.col("w"), F.col("d")) - F.col("u")
    only = planes.of(planes.df.select("mesh_id", "a", "b", "c"))
    return attach(points, only, spread=["vid"]).groupBy("mesh_id").agg(
        (F.sqrt(F.avg(gap * gap)) * 1000.0).alias("rms_error_mm")
    )


def fit_planes(
    points: DataFrame,
    frame_table: KeyTable,
    iters: int = K.RANSAC_ITERS,
    thresh_mm: float = K.RANSAC_THRESH_MM,
    block: int = BLOCK,
    draw: Callable[[DataFrame, int], DataFrame] | None = None,
) -> PlaneFit:
    """Robust reference plane per mesh. ``draw`` makes the candidate triples, seeded ones by default.

    Plane row: mesh_id, a, b, c, inlier_fraction, rms_error_mm, method, candidates_used,
    inlier_count, and the winning three-point plane (ha, hb, hc) that defines the inliers.
    """
    thresh_m = thresh_mm / 1000.0
    numbered = materialize(with_ordinals(plane_candidates(points, frame_table), "vid"), "candidates")
    counts = settle(numbered.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n")), "ccount", frame_table)
    enough = counts.of(counts.df.where(F.col("n") >= K.MIN_SUPPORT))

    planes = materialize(solve_triples((draw or draw_triples)(enough.df, iters), numbered), "hypotheses")
    scored = inlier_counts(numbered, planes, enough, thresh_m, block)
    best = settle(
        best_plane(scored, planes)
        .where(F.col("inliers") >= K.MIN_SUPPORT)
        .withColumnsRenamed({"a": "ha", "b": "hb", "c": "hc"}),
        "best", frame_table,
    )
    inliers = inlier_points(numbered, best, thresh_m)
    refit = settle(ols_planes(inliers).drop("n"), "refit", frame_table)
    fitted = (
        best.df.join(refit.df, "mesh_id")
        .join(rms_mm(inliers, refit), "mesh_id")
        .join(counts.df, "mesh_id")
        .select(
            "mesh_id", "a", "b", "c", (F.col("inliers") / F.col("n")).alias("inlier_fraction"), "rms_error_mm",
            F.lit("RANSAC").alias("method"), F.col("n").alias("candidates_used"),
            F.col("inliers").alias("inlier_count"), "ha", "hb", "hc",
        )
    )
    if best.rows < frame_table.rows:
        fitted = fitted.unionByName(_fallback(points, frame_table, best, counts))
    return PlaneFit(settle(fitted, "plane", frame_table, fallbacks=F.count_if(F.col("method") != "RANSAC")), numbered)


def _fallback(points: DataFrame, frame_table: KeyTable, best: KeyTable, counts: KeyTable) -> DataFrame:
    """Level plane at the median height for meshes without a supported fit."""
    open_meshes = settle(frame_table.df.select("mesh_id").join(best.df.select("mesh_id"), "mesh_id", "left_anti"), "open", frame_table)
    level = exact_quantiles(
        attach(points, open_meshes, spread=["vid"]), "u", [0.5], largest=frame_table.seen.get("most_vertices")
    )
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    return level.join(counts.df.select("mesh_id", F.col("n").alias("cn")), "mesh_id", "left").select(
        "mesh_id", zero.alias("a"), zero.alias("b"), F.col("q")[0].alias("c"), zero.alias("inlier_fraction"),
        zero.alias("rms_error_mm"), F.lit("fallback").alias("method"),
        F.coalesce("cn", F.lit(0)).cast("long").alias("candidates_used"), F.lit(0).cast("long").alias("inlier_count"),
        none.alias("ha"), none.alias("hb"), none.alias("hc"),
    )


def bootstrap_support(
    points: DataFrame, frame_table: KeyTable, fit: PlaneFit,
    iters: int = K.RANSAC_ITERS, thresh_mm: float = K.RANSAC_THRESH_MM,
) -> tuple[DataFrame, KeyTable]:
    """Points to resample and the plane row of each mesh.

    ``iters`` and ``thresh_mm`` are those of ``fit``. Meshes whose fit fell back are
    fitted again with default settings (a fit that already used them is not repeated:
    its draws would be the same). Where that fails too, every vertex is an inlier.
    """
    columns = ("mesh_id", "vid", "w", "d", "u")

    def split(f: PlaneFit) -> tuple[KeyTable, KeyTable]:
        ok = F.col("method") == "RANSAC"
        return f.plane.of(f.plane.df.where(ok)), f.plane.of(f.plane.df.where(~ok))

    good, bad = split(fit)
    support = inlier_points(fit.candidates, good, thresh_mm / 1000.0).select(*columns)
    rows = good.df.withColumn("pool", F.col("candidates_used"))
    if fit.plane.seen["fallbacks"] == 0:
        return support, good.of(rows)
    if (iters, thresh_mm) != (K.RANSAC_ITERS, K.RANSAC_THRESH_MM):
        weak = settle(bad.df.select("mesh_id"), "weak", frame_table)
        weak_frame = settle(frame_table.df.join(weak.df, "mesh_id", "left_semi"), "frame", frame_table, most_vertices=F.max("n_vertices"))
        again = fit_planes(attach(points, weak, spread=["vid"]), weak_frame)
        better, bad = split(again)
        support = support.unionByName(
            inlier_points(again.candidates, better, K.RANSAC_THRESH_MM / 1000.0).select(*columns)
        )
        rows = rows.unionByName(better.df.withColumn("pool", F.col("candidates_used")))
    whole = attach(points, bad.of(bad.df.select("mesh_id")), spread=["vid"]).select(*columns)
    rows = rows.unionByName(bad.df.join(frame_table.df.select("mesh_id", F.col("n_vertices").alias("pool")), "mesh_id"))
    return support.unionByName(whole), frame_table.of(rows)


def _block_draws(n: int, block: int, size: int, reps: int, seed: int) -> np.ndarray:
    """How many of the n draws of each replicate fall into one block.

    The blocks form a binary tree; every split is a binomial draw seeded by its node, so
    each block finds its own share independently and all shares sum to n.
    """
    lo, hi = 0, -(-n // size)
    left = np.full(reps, n, dtype="int64")
    node = 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        below, all_rows = (mid - lo) * size, min(hi * size, n) - lo * size
        took = np.random.default_rng([seed, node]).binomial(left, below / all_rows)
        if block < mid:
            left, hi, node = took, mid, 2 * node
        else:
            left, lo, node = left - took, mid, 2 * node + 1
    return left


def bootstrap_planes(
    support: DataFrame, planes: KeyTable, reps: int = K.MC_SAMPLES, seed: int = K.MC_SEED, size: int = BLOCK,
    times: Callable[[np.ndarray, int], np.ndarray] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Least-squares planes of resampled inliers: samples (mesh_id, b, a, b_, c) and quality.

    Draws with replacement are counted per block; each block contributes the weighted
    moments of its rows for every replicate, and the moments are summed per replicate.
    The rule is the same at every size: block k draws from the stream (seed, 0, k). ``times`` replaces the
    draws: for given row numbers it says how often each replicate takes them (replicates x rows).
    """
    numbered = materialize(with_ordinals(support, "vid"), "inliers")
    stats = settle(
        numbered.groupBy("mesh_id").agg(
            F.count(F.lit(1)).alias("n"), F.avg("w").alias("ow"), F.avg("d").alias("od"), F.avg("u").alias("ou")
        ),
        "instats", planes,
    )
    row = settle(
        planes.df.select("mesh_id", "a", "b", "c", "pool").join(stats.df, "mesh_id", "left").fillna({"n": 0}), "inrow", planes
    )
    enough = row.of(row.df.where(F.col("n") >= K.MIN_SUPPORT).select("mesh_id", "n", "ow", "od", "ou"))

    def resample(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        block, n = int(key[1]), int(pdf["n"].iloc[0])
        pdf = pdf.sort_values("ord")
        rows = len(pdf)
        w, d, u = (pdf[c].to_numpy() - pdf["o" + c].to_numpy() for c in ("w", "d", "u"))
        feats = np.column_stack([np.ones(rows), w, d, u, w * w, d * d, w * d, w * u, d * u])
        sums = np.zeros((reps, feats.shape[1]))
        if times is not None:
            ords = pdf["ord"].to_numpy()
            for at in range(0, rows, CHUNK):
                sums += times(ords[at:at + CHUNK], reps) @ feats[at:at + CHUNK]
        else:
            share = _block_draws(n, block, size, reps, seed)
            rng = np.random.default_rng([seed, 0, block])
            for b in range(reps):
                sums[b] = np.bincount(rng.choice(rows, int(share[b]), replace=True), minlength=rows) @ feats
        out = pd.DataFrame(sums, columns=["s", "sw", "sd", "su", "sww", "sdd", "swd", "swu", "sdu"])
        out.insert(0, "b", np.arange(reps))
        out.insert(0, "mesh_id", key[0])
        return out

    blocks = attach(numbered, enough, spread=["vid"]).select(
        "mesh_id", F.floor(F.col("ord") / F.lit(size)).alias("block"), "ord", "n", "w", "d", "u", "ow", "od", "ou"
    )
    names = ["s", "sw", "sd", "su", "sww", "sdd", "swd", "swu", "sdu"]
    partial = blocks.groupBy("mesh_id", "block").applyInPandas(
        resample, "mesh_id string, b int, " + ", ".join(f"{c} double" for c in names)
    )
    sums = partial.groupBy("mesh_id", "b").agg(*[F.sum(c).alias(c) for c in names])
    s = F.col("s")
    centred = attach(sums, enough, spread=["b"]).select(
        "mesh_id", "b", "ow", "od", "ou",
        (F.col("sw") / s).alias("tw"), (F.col("sd") / s).alias("td"), (F.col("su") / s).alias("tu"),
        *[(F.col(f"s{p}{q}") / s - F.col(f"s{p}") * F.col(f"s{q}") / (s * s)).alias(name)
          for p, q, name in (("w", "w", "vw"), ("d", "d", "vd"), ("w", "d", "cwd"), ("w", "u", "cwu"), ("d", "u", "cdu"))],
    )
    absolute = centred.withColumns({
        "mw": F.col("tw") + F.col("ow"), "md": F.col("td") + F.col("od"), "mu": F.col("tu") + F.col("ou")
    })
    fitted = absolute.select("mesh_id", "b", G.plane_from_moments().alias("pl")).select(
        "mesh_id", "b", F.col("pl.a").alias("pa"), F.col("pl.b").alias("pb"), F.col("pl.c").alias("pc")
    )
    sparse = row.df.where(F.col("n") < K.MIN_SUPPORT)
    samples = fitted.unionByName(_noisy_planes(sparse, reps, seed))
    kept = attach(numbered, enough.of(enough.df.select("mesh_id")), spread=["vid"])
    rms = rms_mm(kept, row)
    quality = row.df.join(rms, "mesh_id", "left").select(
        "mesh_id", F.col("n").alias("candidates_used"),
        F.coalesce(F.try_divide(F.col("n"), F.col("pool")), F.lit(0.0)).alias("inlier_fraction"),
        F.coalesce("rms_error_mm", F.lit(0.0)).alias("rms_error_mm"),
    )
    return samples, quality.withColumn("weak_fit", weak_fit(F.col("inlier_fraction"), F.col("rms_error_mm")))


def _noisy_planes(rows: DataFrame, reps: int, seed: int) -> DataFrame:
    """Inflated samples around a plane with too little support."""

    def jitter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mesh_id, *abc in batch.itertuples(index=False):
                plane = np.array(abc, dtype="float64")
                noise = np.random.default_rng(seed).normal(0, 0.1 * np.abs(plane) + 1e-6, (reps, 3))
                pa, pb, pc = (plane + noise).T
                yield pd.DataFrame({"mesh_id": mesh_id, "b": np.arange(reps), "pa": pa, "pb": pb, "pc": pc})

    return rows.select("mesh_id", "a", "b", "c").mapInPandas(jitter, "mesh_id string, b int, pa double, pb double, pc double")


def weak_fit(inlier_fraction: F.Column, rms: F.Column) -> F.Column:
    """Monte Carlo rule; the report rule is inlier fraction below one half."""
    return (inlier_fraction < K.WEAK_INLIER_MC) | (rms > K.WEAK_RMS_MC_MM)
