"""Chart data: the tables behind every plot, without drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from footfall.functions import constants as K
from footfall.functions.text import fill, fixed, general, percent, sci
from footfall.operators.grid import dense_grid, node
from footfall.operators.keyed import KeyTable
from footfall.operators.traffic import calibration_banner
from footfall.operators.uncertainty import direction_class

CURVE_POINTS = 200

# Fixed wording of the calibration checklist.
CHECKLIST = "\n".join([
    "HOW TO CALIBRATE", "",
    "1. MEASURE THE REAL WIDTH", "   Use: --measured-width-m <width_in_meters>", "",
    "2. IF MESH UNITS ARE MILLIMETERS", "   Use: --scale 0.001", "",
    "3. IF MESH UNITS ARE CENTIMETERS", "   Use: --scale 0.01", "",
    "4. TRY DIFFERENT MATERIALS", "   Use: --material sandstone", "   Use: --material limestone", "   Use: --material marble", "",
    "5. COMPARE ROBUST VS LEGACY METHODS", "   Use: --use-legacy-wear-volume",
])


def _joined(*lines: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def heatmap_info(results: DataFrame) -> DataFrame:
    """Info box of the heat map: (mesh_id, text)."""
    c = F.col
    return results.select("mesh_id", _joined(
        fill("Method: {0}", c("method")), fill("Max depth: {0} mm", fixed(c("max_depth"), 1)),
        fill("Volume: {0} m³", general(c("volume"), 3)), fill("Volume: {0} L", fixed(c("volume") * 1000, 1)),
        fill("RANSAC inliers: {0}", percent(c("inlier_fraction"), 1)),
        F.when(c("inlier_fraction") < K.WEAK_INLIER_REPORT, F.lit("⚠ weak plane fit")),
        fill("RMS error: {0} mm", fixed(c("rms_error_mm"), 2)),
        fill("Excluded: {0}", percent(c("excluded_fraction"), 1)),
    ).alias("text"))


def lateral_curves(profile: DataFrame, results: DataFrame) -> DataFrame:
    """Observed profile and one curve per mixture component: (mesh_id, series, x, value).

    Each component is scaled to the height of the observed profile and is always called
    a component, never a lane.
    """
    observed = profile.select("mesh_id", F.lit("Observed Wear").alias("series"), "x", F.col("share").alias("value"))
    span = profile.groupBy("mesh_id").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("share").alias("peak")
    )
    parts = results.where(F.col("n_modes") > 0).select(
        "mesh_id", F.posexplode(F.arrays_zip("means", "stds", "weights")).alias("k", "comp")
    )
    points = parts.join(span, "mesh_id").select(
        "mesh_id", "k", "comp", "peak", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1))).alias("i")
    ).withColumn("x", node(F.col("lo"), F.col("hi"), F.col("i"), CURVE_POINTS))
    z = (F.col("x") - F.col("comp.means")) / F.col("comp.stds")
    raw = points.withColumn("raw", F.col("comp.weights") * F.exp(-0.5 * z * z))
    top = F.max("raw").over(Window.partitionBy("mesh_id", "k"))  # 200 rows
    curves = raw.select(
        "mesh_id", F.concat(F.lit("GMM Component "), (F.col("k") + 1).cast("string")).alias("series"), "x",
        F.try_divide(F.col("raw"), top).alias("unit"), "peak",
    ).select("mesh_id", "series", "x", (F.col("unit") * F.col("peak")).alias("value"))
    return observed.unionByName(curves)


# The wording of this text is fixed.
def lateral_info(results: DataFrame) -> DataFrame:
    c = F.col
    single = c("pattern").contains(K.SINGLE)
    return results.select(
        "mesh_id", fill("Lateral Wear (Simultaneity Evidence): {0}", c("pattern")).alias("title"),
        F.when(single, F.lit("GMM components are statistical modes, not physical lanes.")).alias("note"),
        _joined(
            fill("Final Pattern: {0}", c("pattern")),
            fill("W_nom: {0}m  W_eff: {1}m", fixed(c("w_nom"), 2), fixed(c("w_eff"), 2)),
            fill("shy_dist: {0}m  w_lane: {1}m", fixed(c("shy_distance"), 2), fixed(c("w_lane"), 2)),
            fill("M_max_two_abreast: {0}", c("m_max_two_abreast")),
            fill("Single file possible: {0}", F.initcap(c("single_file_possible").cast("string"))),
            F.when(c("temporal_drift_likely"), F.lit("⚠ Temporal drift: YES")),
        ).alias("text"),
    )


# The wording of this text is fixed.
def longitudinal_info(profile: DataFrame, results: DataFrame, g: int = K.GRID) -> DataFrame:
    """Region borders and info box of the longitudinal chart."""
    c = F.col
    borders = profile.groupBy("mesh_id").agg(
        F.max(F.when(c("i") == g // 4, c("y"))).alias("front_border"),
        F.max(F.when(c("i") == 3 * g // 4, c("y"))).alias("back_border"),
    )
    info = results.select("mesh_id", F.lit("Directionality Evidence (Heuristic)").alias("title"), _joined(
        fill("Nosing Ratio: {0}", fixed(c("nosing_wear_ratio"), 2)), fill("Direction: {0}", c("dominant_direction")),
        fill("Confidence: {0}%", fixed(c("confidence"), 0)), F.lit(""), F.lit("(Heuristic inference)"),
        F.lit("Assumes depth axis orientation is correct; flip if reversed."),
    ).alias("text"))
    return borders.join(info, "mesh_id")


# The wording of this text is fixed.
def conclusions(results: DataFrame) -> DataFrame:
    """Evidence summary without traffic numbers: (mesh_id, text)."""
    c = F.col
    weak = F.when(c("inlier_fraction") < K.WEAK_INLIER_REPORT, F.lit(" (⚠ weak plane fit)")).otherwise(F.lit(""))
    return results.select("mesh_id", _joined(
        F.lit("STABLE CONCLUSIONS\n" + "━" * 25 + "\n\n✅ GEOMETRY:"),
        fill("  • Max depth: {0} mm", fixed(c("max_depth"), 1)),
        fill("  • Volume: {0} m³ ({1} L)", general(c("volume"), 3), fixed(c("volume") * 1000, 1)),
        fill("  • Method: {0}{1}", c("method"), weak),
        F.lit("\n✅ SIMULTANEITY (Physics-Constrained):"), fill("  • Pattern: {0}", c("pattern")),
        fill("  • W_eff: {0} m", fixed(c("w_eff"), 2)), fill("  • {0}", c("description")),
        F.lit("\n⚠ DIRECTION (Heuristic):"), fill("  • {0}", c("dominant_direction")),
        fill("  • Confidence: {0}%", fixed(c("confidence"), 0)), fill("  • {0}", c("explanation")),
        F.lit("  • Note: Assumes depth axis orientation\n    is correct; flip if reversed."),
        F.lit(
            "\n⚠ TRAFFIC: CALIBRATION-LIMITED\n  • Traffic estimates require validated\n    scale/material parameters.\n"
            "  • See traffic_assumptions.png for\n    conditional estimates."
        ),
        F.when(c("temporal_drift_likely"), F.lit("\n⚠ Temporal drift detected\n  (peaks shift over depth)")),
    ).alias("text"))


# The wording of this text is fixed.
def traffic_assumptions(results: DataFrame) -> DataFrame:
    """Banner, assumptions, horizon table and warnings of the traffic page."""
    c = F.col
    limited = calibration_banner()
    table = [fill("Total footsteps: {0}", sci(c("total_steps"), 2))]
    for years in K.HORIZONS_YEARS:
        table.append(fill(f"{years} years".ljust(12) + "{0} footsteps/day", fixed(c(f"daily_{years}y"), 1, grouped=True)))
    return results.select(
        "mesh_id", limited.alias("is_limited"),
        F.when(limited, F.lit("⚠ CALIBRATION LIMITED ⚠")).otherwise(
            F.lit("Traffic Estimates (Conditional on Assumptions)")).alias("banner"),
        F.when(limited, F.lit("Verify scale/material before interpreting traffic estimates")).otherwise(
            F.lit("These estimates depend on calibration parameters")).alias("subtitle"),
        _joined(
            fill("k_spec value:    {0}", sci(c("k_spec_value"), 2)), fill("k_spec units:    {0}", c("k_spec_units")),
            fill("k_spec SI:       {0} m²/N", sci(c("k_spec_si"), 2)),
            F.lit(f"Body weight:     {K.BODY_WEIGHT_N:.0f} N"), F.lit(f"GRF multiplier:  {K.GRF_DESCENT}"),
            F.lit(f"Microslip:       {K.MICROSLIP_M} m"), fill("Wear volume:     {0} m³", sci(c("volume"), 3)),
        ).alias("assumptions_text"),
        _joined(*table).alias("traffic_text"),
        F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("• "), w)), "\n").alias("warnings_text"),
        F.lit(CHECKLIST).alias("checklist_text"),
    )


def tornado(uncertainty: DataFrame) -> DataFrame:
    """Sensitivity bars, largest first: (mesh_id, place, source, share, label, is_dominant)."""
    bars = uncertainty.select("mesh_id", "traffic_dominated_by", F.explode("sensitivity").alias("source", "share"))
    order = {s: i for i, s in enumerate(K.SENSITIVITY_SOURCES)}
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for s, i in order.items()])
    place = F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.desc("share"), rank))  # five rows
    return bars.select(
        "mesh_id", place.alias("place"), "source", "share", percent(F.col("share"), 0).alias("label"),
        (F.col("source") == F.col("traffic_dominated_by")).alias("is_dominant"),
    )


def traffic_intervals(uncertainty: DataFrame) -> DataFrame:
    """Median and intervals per horizon, and whether the axis should be logarithmic."""
    dists = [F.col(f"daily_{y}y") for y in K.HORIZONS_YEARS]
    low = F.least(*[d["ci_95"]["lo"] for d in dists])
    high = F.greatest(*[d["ci_95"]["hi"] for d in dists])
    rows = F.array(*[
        F.struct(
            F.lit(f"{y}y").alias("horizon"), d["median"].alias("median"), d["ci_50"]["lo"].alias("ci50_lo"),
            d["ci_50"]["hi"].alias("ci50_hi"), d["ci_95"]["lo"].alias("ci95_lo"), d["ci_95"]["hi"].alias("ci95_hi"),
        ) for y, d in zip(K.HORIZONS_YEARS, dists)
    ])
    return uncertainty.select("mesh_id", F.inline(rows), (F.try_divide(high, low + 1e-20) > 100).alias("log_scale"))


def direction_panel(uncertainty: DataFrame) -> DataFrame:
    p = F.col("prob_ascent")
    lo, hi = p["ci_95"]["lo"], p["ci_95"]["hi"]
    kind = direction_class(lo, hi)
    icon = F.when(kind == "ASCENT", F.lit("↑")).when(kind == "DESCENT", F.lit("↓")).otherwise(F.lit("↔"))
    caveat = F.when(F.col("axis_ambiguous"), F.lit("⚠ Axis orientation ambiguous")).otherwise(
        F.lit("Note: Assumes depth axis orientation is correct")
    )
    return uncertainty.select(
        "mesh_id", F.concat(icon, F.lit(" "), kind).alias("heading"), F.col("classification").alias("label"),
        (0.1 + 0.8 * lo).alias("bar_lo"), (0.1 + 0.8 * hi).alias("bar_hi"), (0.1 + 0.8 * p["median"]).alias("bar_median"),
        caveat.alias("caveat"),
    )


# The wording of this text is fixed.
def uncertainty_text(uncertainty: DataFrame) -> DataFrame:
    def ci(name: str, show) -> Column:
        d = F.col(name)["ci_95"]
        return fill("     CI95: [{0}, {1}]", show(d["lo"], 2), show(d["hi"], 2))

    def flag(name: str) -> Column:
        return F.initcap(F.col(name).cast("string"))

    return uncertainty.select("mesh_id", _joined(
        fill("Monte Carlo samples: {0}", F.col("n_samples")), fill("Seed: {0}", F.col("seed")), F.lit("\nGEOMETRY (Stable)"),
        fill("  Volume: {0} m³", sci(F.col("volume.median"), 2)), ci("volume", sci),
        fill("  Max depth: {0} mm", fixed(F.col("max_depth.median"), 2)), ci("max_depth", fixed),
        F.lit("\nTRAFFIC (Conditional, 500y)"), fill("  Daily: {0} steps/day", sci(F.col("daily_500y.median"), 2)),
        ci("daily_500y", sci), F.lit("\nFLAGS"), fill("  Scale ambiguous: {0}", flag("scale_ambiguous")),
        fill("  Weak plane fit: {0}", flag("weak_plane_fit")), fill("  Axis ambiguous: {0}", flag("axis_ambiguous")),
    ).alias("text"))


def all_charts(wear, results: DataFrame, g: int = K.GRID, uncertainty: DataFrame | None = None) -> dict[str, DataFrame]:
    """Chart tables by name; the uncertainty panels only with uncertainty results."""
    charts = {
        "wear_heatmap": dense_grid(wear.cells, wear.extents, g), "wear_heatmap_info": heatmap_info(results),
        "lateral_distribution": lateral_curves(wear.lateral, results), "lateral_distribution_info": lateral_info(results),
        "longitudinal_profile": wear.longitudinal, "longitudinal_profile_info": longitudinal_info(wear.longitudinal, results, g),
        "summary_dashboard": conclusions(results), "traffic_assumptions": traffic_assumptions(results),
    }
    if uncertainty is not None:
        charts |= {
            "uncertainty_tornado": tornado(uncertainty), "uncertainty_traffic": traffic_intervals(uncertainty),
            "uncertainty_direction": direction_panel(uncertainty), "uncertainty_summary": uncertainty_text(uncertainty),
        }
    return charts


def write_charts(charts: dict[str, DataFrame], path: str) -> None:
    for name, table in charts.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
