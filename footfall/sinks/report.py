"""Text and JSON results, one document per mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import constants as K
from footfall.functions.text import fill, fixed, percent, sci
from footfall.operators.uncertainty import format_with_ci

RULE = "=" * 70


def _lines() -> list[Column]:
    """Report lines in order; a null line is left out. The wording is fixed."""
    c = F.col
    robust = c("method") == "robust_triangle"

    def only(test: Column, line: Column) -> Column:
        return F.when(test, line)

    lines = [
        F.lit(RULE), F.lit("SURFACE WEAR REPORT"), F.lit(RULE), F.lit(""),
        fill("Input File: {0}", c("mesh_id")), fill("Material: {0}", c("name")),
        fill("Wear Volume Method: {0}", c("method")),
        only(robust, F.lit("")), only(robust, F.lit("--- ROBUST METHOD DIAGNOSTICS ---")),
        only(robust, F.lit("Reference Plane:")),
        only(robust, fill("  Method: {0}", c("plane_method"))),
        only(robust, fill("  Inlier fraction: {0}", percent(c("inlier_fraction"), 1))),
        only(robust, fill("  RMS error: {0} mm", fixed(c("rms_error_mm"), 2))),
        only(robust, fill("  Candidates used: {0}", c("candidates_used"))),
        only(robust, F.lit("Tread Segmentation:")),
        only(robust, fill("  Tread triangles: {0}", c("tread_count"))),
        only(robust, fill("  Excluded fraction: {0}", percent(c("excluded_fraction"), 1))),
        only(robust & c("weak_plane"), F.lit("  WARNING: Weak reference plane fit (inliers < 50%)")),
        only(robust & c("high_exclusion"), F.lit("  WARNING: High triangle exclusion (> 50%)")),
        only(robust & c("implausible_depth"), F.lit("  WARNING: Implausible max depth (> 200mm)")),
        F.lit(""), F.lit("--- QUESTION 1: HOW OFTEN WAS THE SURFACE USED? ---"),
        fill("Total estimated footsteps: {0}", sci(c("total_steps"), 2)),
        fill("Wear volume: {0} m^3", sci(c("volume"), 2)),
        F.lit(""), F.lit("Estimated daily traffic (by building age):"),
    ]
    for years in K.HORIZONS_YEARS:
        lines.append(fill("  If " + f"{years:>3} years old:".ljust(16) + "{0} footsteps/day", fixed(c(f"daily_{years}y"), 3)))
    warned = F.size("warnings") > 0
    lines += [
        only(warned, F.lit("")), only(warned, F.lit("  TRAFFIC VOLUME WARNINGS:")),
        only(warned, F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("    - "), w)), "\n")),
        F.lit(""), F.lit("--- QUESTION 2: WAS A DIRECTION FAVORED? ---"),
        fill("Dominant direction: {0}", c("dominant_direction")),
        fill("Confidence: {0}%", fixed(c("confidence"), 1)),
        fill("Ascent/Descent ratio: {0}", fixed(c("ascent_descent_ratio"), 2)),
        fill("Explanation: {0}", c("explanation")),
        F.lit(""), F.lit("--- QUESTION 3: HOW MANY PEOPLE SIMULTANEOUSLY? ---"),
        fill("Usage pattern: {0}", c("pattern")), fill("Description: {0}", c("description")),
        fill("Number of lanes: {0}", c("n_lanes")), fill("Effective width: {0} m", fixed(c("w_eff"), 2)),
        fill("Single file possible: {0}", F.initcap(c("single_file_possible").cast("string"))),
        fill("Two-abreast lanes: {0}", c("m_max_two_abreast")),
        F.when(c("temporal_drift_likely"), F.lit("Temporal drift detected: YES (peaks shift over depth)")).otherwise(
            F.lit("Temporal drift detected: NO")
        ),
        F.lit(""), F.lit(RULE),
    ]
    return lines


def report(results: DataFrame) -> DataFrame:
    """Full report text per mesh: (mesh_id, text)."""
    return results.select("mesh_id", F.array_join(F.array_compact(F.array(*_lines())), "\n").alias("text"))


def short_report(results: DataFrame) -> DataFrame:
    """The five-line file variant: (mesh_id, text)."""
    return results.select("mesh_id", F.concat_ws(
        "\n", F.lit("SURFACE WEAR REPORT"), fill("Material: {0}", F.col("material")),
        fill("Traffic: {0} steps", sci(F.col("total_steps"), 2)),
        fill("Direction: {0}", F.col("dominant_direction")), fill("Pattern: {0}", F.col("pattern")),
    ).alias("text"))


def uncertainty_lines(results: DataFrame) -> DataFrame:
    """Screen summary of the uncertainty per mesh: (mesh_id, text)."""
    c = F.col
    posterior = F.array_join(F.transform(F.map_entries("scale_hypothesis_posterior"), lambda e: fill("{0} {1}", e["key"], percent(e["value"], 0))), ", ")
    shares = F.array_join(F.transform(F.map_entries("sensitivity"), lambda e: fill("{0} {1}", e["key"], percent(e["value"], 1))), ", ")
    return results.select("mesh_id", F.concat_ws(
        "\n", fill("Mesh: {0}", c("mesh_id")), fill("Wear volume (m3): {0}", format_with_ci("volume", 2, True)),
        fill("Max depth (mm): {0}", format_with_ci("max_depth")), fill("P(ascent): {0}", format_with_ci("prob_ascent")),
        fill("Direction: {0}", c("classification")), fill("Total steps: {0}", format_with_ci("total_steps", 2, True)),
        *[fill(f"Daily over {y} years: " + "{0}", format_with_ci(f"daily_{y}y")) for y in K.HORIZONS_YEARS],
        fill("Shares of variance: {0}", shares), fill("Dominated by: {0}", c("traffic_dominated_by")), fill("Scale: {0}", posterior),
    ).alias("text"))


def uncertainty_document(results: DataFrame) -> DataFrame:
    """Nested JSON result per mesh: (mesh_id, text)."""

    def dist(name: str) -> Column:
        d = F.col(name)
        return F.struct(
            d["median"].alias("median"), d["mean"].alias("mean"),
            F.array(d["ci_50"]["lo"], d["ci_50"]["hi"]).alias("ci_50"),
            F.array(d["ci_95"]["lo"], d["ci_95"]["hi"]).alias("ci_95"),
        )

    document = F.struct(
        F.struct(
            "n_samples", "seed", "material", "scale", "scale_hypothesis_posterior",
        ).alias("metadata"),
        F.struct(
            dist("volume").alias("volume_m3"), dist("max_depth").alias("max_depth_mm"),
            dist("mean_depth").alias("mean_depth_mm"),
        ).alias("geometry"),
        F.struct(
            dist("prob_ascent").alias("prob_ascent"), dist("nosing_ratio").alias("nosing_ratio"), "axis_ambiguous",
            "classification", "simple_classification",
        ).alias("directionality"),
        F.struct(
            dist("total_steps").alias("total_steps"),
            *[dist(f"daily_{y}y").alias(f"daily_{y}y") for y in K.HORIZONS_YEARS],
            "sensitivity", F.col("traffic_dominated_by").alias("dominant_source"),
        ).alias("traffic_conditional"),
        F.struct("scale_ambiguous", "weak_plane_fit").alias("flags"),
    )
    return results.select("mesh_id", F.to_json(document, {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))


def write_documents(documents: DataFrame, path: str, foldered: bool = False) -> None:
    """One JSON row (mesh_id, text) per mesh; ``foldered`` writes a text folder per mesh instead, for few meshes."""
    if foldered:
        documents.write.mode("overwrite").partitionBy("mesh_id").text(path)
    else:
        documents.write.mode("overwrite").json(path)
