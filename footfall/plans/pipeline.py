"""Composed plans: wear analysis, traffic inference, uncertainty propagation.

Every step is keyed by mesh, so any number of surfaces runs in one job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from footfall.functions import constants as K
from footfall.operators import grid as Gr
from footfall.operators import mesh as M
from footfall.operators import plane as P
from footfall.operators import traffic as T
from footfall.operators import uncertainty as U
from footfall.operators.keyed import KeyTable, settle
from footfall.operators.mixture import lateral_mixture
from footfall.operators.volume import wear_volume
from footfall.session import materialize
from footfall.sources.materials import with_material, with_material_prior


@dataclass(frozen=True)
class Config:
    """Settings of an analysis.

    ``compat`` keeps known oddities of the published model: profiles always come from
    the default robust fit, Monte Carlo nosing applies the scale twice, and oak has no
    Monte Carlo prior. ``nominal_width`` is recorded but enters no formula.

    ``triples``, ``mixture_rounds`` and ``times`` replace seeded draws and tolerances by rules, see
    ``fit_planes``, ``fit_mixtures`` and ``bootstrap_planes``.
    """

    material: str = "granite"
    nominal_width: float | None = None
    scale: float = 1.0
    axes: tuple[int, int, int] | None = None
    use_legacy_wear_volume: bool = False
    ransac_iters: int = K.RANSAC_ITERS
    ransac_thresh_mm: float = K.RANSAC_THRESH_MM
    seg_angle_deg: float = K.TREAD_ANGLE_DEG
    roi_quantiles: tuple[float, float] = K.ROI_QUANTILES
    grid: int = K.GRID
    flip_depth: bool = False
    compat: bool = True
    triples: Callable[[DataFrame, int], DataFrame] | None = None
    mixture_rounds: int | None = None
    times: Callable[[np.ndarray, int], np.ndarray] | None = None

    @property
    def default_fit(self) -> bool:
        return (self.ransac_iters, self.ransac_thresh_mm) == (K.RANSAC_ITERS, K.RANSAC_THRESH_MM)


@dataclass
class Surface:
    """Prepared mesh: gathered triangles, frame and oriented points."""

    mesh: M.Mesh
    triangles: DataFrame
    frame: KeyTable
    config: Config
    scales: DataFrame | None = None  # mesh_id, scale where each mesh has its own
    fits: dict = field(default_factory=dict)

    @property
    def points(self) -> DataFrame:
        return M.oriented_points(self.mesh.vertices, self.frame)

    @property
    def oriented(self) -> DataFrame:
        return M.oriented_triangles(self.triangles, self.frame)

    def fit(self, iters: int, thresh_mm: float) -> P.PlaneFit:
        key = (iters, thresh_mm)
        if key not in self.fits:
            self.fits[key] = P.fit_planes(self.points, self.frame, iters, thresh_mm, draw=self.config.triples)
        return self.fits[key]

    def segmented(self, angle: float, roi) -> DataFrame:
        return M.segment_tread(self.oriented, angle, roi, self.frame.seen["most_faces"])


    def scale_rows(self) -> DataFrame:
        if self.scales is not None:
            return self.scales
        return self.frame.df.select("mesh_id", F.lit(float(self.config.scale)).alias("scale"))


def load(mesh: M.Mesh, config: Config = Config(), scales: DataFrame | None = None) -> Surface:
    """Prepare a mesh that is already scaled; ``scales`` records per-mesh factors."""
    mesh, tris, frame = M.prepare(mesh, config.axes)
    return Surface(mesh, tris, frame, config, scales)


@dataclass(frozen=True)
class Wear:
    """Wear tables; ``summary`` has one row per mesh, the profiles one row per grid line."""

    summary: DataFrame
    cells: DataFrame
    lateral: DataFrame
    longitudinal: DataFrame
    extents: KeyTable


def _robust_summary(surface: Surface) -> DataFrame:
    c = surface.config
    fit = surface.fit(c.ransac_iters, c.ransac_thresh_mm)
    seg = materialize(surface.segmented(c.seg_angle_deg, c.roi_quantiles), "tread")
    volume = wear_volume(seg.where("is_tread"), fit.plane)
    plane = fit.plane.df.select(
        "mesh_id", "a", "b", "c", "inlier_fraction", "rms_error_mm", F.col("method").alias("plane_method"),
        "candidates_used", "inlier_count",
    )
    return volume.join(plane, "mesh_id").join(M.tread_summary(seg), "mesh_id").withColumn("method", F.lit("robust_triangle"))


def _legacy_summary(surface: Surface) -> tuple[DataFrame, DataFrame]:
    g = surface.config.grid
    cells, ref = Gr.legacy_cells(surface.points, surface.frame, g)
    cells = materialize(cells, "legacy")
    volume = Gr.legacy_volume(cells, surface.frame, g).join(ref.df, "mesh_id").withColumn("method", F.lit("legacy_grid"))
    nulls = {
        "triangles_used": "long", "a": "double", "b": "double", "c": "double", "inlier_fraction": "double",
        "rms_error_mm": "double", "plane_method": "string", "candidates_used": "long", "inlier_count": "long",
        "tread_count": "long", "excluded_count": "long", "excluded_fraction": "double",
    }
    return volume.withColumns({n: F.lit(None).cast(t) for n, t in nulls.items()}), cells


def analyze_wear(surface: Surface) -> Wear:
    """Wear volume and depth, lateral mixture and moments, longitudinal regions."""
    c = surface.config
    legacy_cells = None
    if c.use_legacy_wear_volume:
        summary, legacy_cells = _legacy_summary(surface)
    else:
        summary = _robust_summary(surface)
    if legacy_cells is not None and not c.compat:
        cells = legacy_cells
    else:
        fit = surface.fit(K.RANSAC_ITERS, K.RANSAC_THRESH_MM) if c.compat else surface.fit(c.ransac_iters, c.ransac_thresh_mm)
        cells = materialize(Gr.depth_cells(surface.points, surface.frame, fit.plane, c.grid), "cells")
    lateral = materialize(Gr.lateral_profile(cells, surface.frame, c.grid), "lateral")
    along = materialize(Gr.longitudinal_profile(cells, surface.frame, c.grid), "along")
    moments = Gr.lateral_moments(lateral).withColumnRenamed("skewness", "lateral_skewness")
    mixture = lateral_mixture(lateral, c.mixture_rounds)
    regions = Gr.longitudinal_regions(along, c.grid, c.flip_depth)
    # Moments of a profile without a mixture are not reported.
    fitted = F.col("n_modes") > 0
    joined = summary.join(mixture, "mesh_id").join(moments, "mesh_id").join(regions, "mesh_id")
    joined = joined.withColumns({
        "kurtosis": F.when(fitted, F.col("kurtosis")), "lateral_skewness": F.when(fitted, F.col("lateral_skewness"))
    }).drop("worn", "n_samples")
    return Wear(materialize(joined, "wear"), cells, lateral, along, surface.frame)


def estimate_traffic(wear: Wear, config: Config) -> DataFrame:
    """One result row per mesh answering volume, direction and lanes."""
    drift = Gr.temporal_drift(wear.cells, wear.summary).select("mesh_id", "drift", "shift_ratio")
    rows = wear.summary.join(drift, "mesh_id", "left").withColumn("material", F.lit(config.material))
    rows = rows.withColumn("drift", F.col("drift") & (F.col("n_modes") > 0))
    rows = T.traffic_volume(with_material(rows))
    rows = T.simultaneity(T.directionality(rows))
    return T.quality_flags(rows)


def analyze(mesh: M.Mesh, config: Config = Config()) -> tuple[Surface, Wear, DataFrame]:
    surface = load(mesh, config)
    wear = analyze_wear(surface)
    return surface, wear, materialize(estimate_traffic(wear, config), "results")


def propagate(
    surface: Surface, n: int = K.MC_SAMPLES, seed: int = K.MC_SEED, samples_only: bool = False, draws: DataFrame | None = None
) -> DataFrame:
    """Uncertainty of a prepared surface: one result row per mesh, or its samples. ``draws`` (see ``monte_carlo_draws``) replaces the seeded ones."""
    c = surface.config
    fit = surface.fit(c.ransac_iters, c.ransac_thresh_mm)
    support, planes = P.bootstrap_support(surface.points, surface.frame, fit, c.ransac_iters, c.ransac_thresh_mm)
    plane_samples, quality = P.bootstrap_planes(support, planes, n, seed, times=c.times)
    plane_samples, quality = materialize(plane_samples, "bootstrap"), materialize(quality, "quality")
    widths = surface.frame.df.select("mesh_id", (F.col("w_max") - F.col("w_min")).alias("width"))
    given = F.when(F.col("scale") != 1.0, F.col("scale"))
    scaled = widths.join(surface.scale_rows(), "mesh_id").withColumn("user_scale", given)
    config = U.scale_prior(scaled, "width").withColumns({"n_planes": F.lit(n), "material": F.lit(c.material)})
    if draws is None:
        draws = U.monte_carlo_draws(with_material_prior(config, compat=c.compat), n, seed)
    tread = surface.segmented(K.TREAD_ANGLE_DEG, K.ROI_QUANTILES).where("is_tread")
    samples = U.monte_carlo_samples(
        draws, plane_samples, materialize(tread.select("mesh_id", "fid", *[f"{x}{k}" for k in range(3) for x in "wdu"]), "mctread"),
        surface.points, surface.frame, c.compat,
    )
    if samples_only:
        return samples
    result = U.summarize(samples, widths, quality, n, seed)
    return result.join(surface.scale_rows(), "mesh_id").withColumn("material", F.lit(c.material))
