"""Traffic volume, direction and lane usage as column expressions on result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from footfall.functions import constants as K
from footfall.functions.text import fill, fixed, percent, sci, shortest


def k_spec_si(value: str = "k_spec_value", units: str = "k_spec_units") -> Column:
    """Specific wear rate in m2/N; an unknown unit is an error."""
    unknown = F.raise_error(F.concat(
        F.lit("Unknown k_spec units: "), F.col(units), F.lit(". Expected 'mm3_per_Nm' or 'm2_per_N'")
    )).cast("double")
    return (
        F.when(F.col(units) == "mm3_per_Nm", F.col(value) * K.MM3_PER_NM_TO_M2_PER_N)
        .when(F.col(units) == "m2_per_N", F.col(value))
        .otherwise(unknown)
    )


def unify_material_columns(rows: DataFrame) -> DataFrame:
    """Accept the older ``k_spec_mm3_per_Nm`` column; where present it wins."""
    have = set(rows.columns)
    old = F.col("k_spec_mm3_per_Nm") if "k_spec_mm3_per_Nm" in have else F.lit(None).cast("double")
    value = F.col("k_spec_value") if "k_spec_value" in have else F.lit(None).cast("double")
    units = F.col("k_spec_units") if "k_spec_units" in have else F.lit(None).cast("string")
    return rows.withColumns({
        "k_spec_value": F.coalesce(old, value, F.lit(1e-6)),
        "k_spec_units": F.when(old.isNotNull(), F.lit("mm3_per_Nm")).otherwise(F.coalesce(units, F.lit("mm3_per_Nm"))),
    })


def steps_from_volume(volume: Column, k_si: Column, load: Column, slip: Column) -> Column:
    """Archard inversion N = V / (k W L); 0 unless every factor is positive."""
    usable = (k_si > 0) & (load > 0) & (slip > 0)
    return F.when(usable, F.try_divide(volume, k_si * load * slip)).otherwise(F.lit(0.0))


def daily(steps: Column, years: int) -> Column:
    return F.when(steps > 0, steps / float(years * K.DAYS_PER_YEAR)).otherwise(F.lit(0.0))


def traffic_volume(rows: DataFrame) -> DataFrame:
    """Rows with volume (m3), max_depth (mm) and material columns -> steps, rates, warnings."""
    load, slip = F.lit(K.BODY_WEIGHT_N * K.GRF_DESCENT), F.lit(K.MICROSLIP_M)
    out = unify_material_columns(rows).withColumn("k_spec_si", k_spec_si())
    out = out.withColumn("total_steps", steps_from_volume(F.col("volume"), F.col("k_spec_si"), load, slip))
    steps = F.col("total_steps")
    out = out.withColumns({f"daily_{y}y": daily(steps, y) for y in K.HORIZONS_YEARS})
    out = out.withColumn(
        "per_step_wear_volume", F.when(steps > 0, F.try_divide(F.col("volume"), steps)).otherwise(F.lit(0.0))
    )
    return out.withColumns({
        "assumptions": F.struct(
            F.lit(K.BODY_WEIGHT_N).alias("avg_weight_N"), F.lit(K.GRF_DESCENT).alias("grf_multiplier"),
            F.lit(K.MICROSLIP_M).alias("microslip_m"),
        ),
        "warnings": traffic_warnings(),
    })


def traffic_warnings() -> Column:
    rate, steps = F.col("daily_500y"), F.col("total_steps")
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("max_depth"), F.lit(0.0)) > 200, F.lit(K.DEPTH_WARNING)),
        F.when(F.col("per_step_wear_volume") > 1e-9, fill(K.STEP_WARNING, sci(F.col("per_step_wear_volume"), 2))),
        F.when(rate > 50000, fill(K.HIGH_TRAFFIC_WARNING, fixed(rate, 0))),
        F.when((rate < 0.1) & (steps > 0), fill(K.LOW_TRAFFIC_WARNING, fixed(rate, 3))),
    ))


def horizon_rows(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per age horizon with its daily rate."""
    pairs = F.array(*[
        F.struct(F.lit(y).alias("years"), daily(F.col("total_steps"), y).alias("daily")) for y in K.HORIZONS_YEARS
    ])
    return rows.select(*keep, F.inline(pairs))


def directionality(rows: DataFrame, ratio: str = "nosing_wear_ratio", skew: str = "skewness") -> DataFrame:
    """Adds dominant_direction, confidence, ascent_descent_ratio, explanation."""
    r, s = F.col(ratio), F.col(skew)
    cases = [
        (r > 1.3, K.DESCENT, F.least(F.lit(95.0), 50 + (r - 1.0) * 50)),
        (r < 0.7, K.ASCENT, F.least(F.lit(95.0), 50 + (1.0 - r) * 50)),
        (s > 0.5, K.DESCENT_MODERATE, 60 + s * 20),
        (s < -0.5, K.ASCENT_MODERATE, 60 + F.abs(s) * 20),
    ]
    label, confidence, why = F.lit(K.BALANCED[0]), F.lit(70.0), F.lit(K.BALANCED[1])
    for test, (name, text), value in reversed(cases):
        label = F.when(test, F.lit(name)).otherwise(label)
        confidence = F.when(test, value).otherwise(confidence)
        why = F.when(test, F.lit(text)).otherwise(why)
    ratio_out = F.when(r > 1.0, F.try_divide(F.lit(1.0), r)).otherwise(F.try_divide(F.lit(1.0), r + 0.1))
    return rows.withColumns({
        "dominant_direction": label, "confidence": confidence,
        "ascent_descent_ratio": ratio_out, "explanation": why,
    })


def simultaneity(rows: DataFrame, w_lane: float = K.W_LANE_M, shy: float = K.SHY_M) -> DataFrame:
    """Rows with n_modes, kurtosis, means, w_nom, drift -> lane pattern columns."""
    modes = F.coalesce(F.col("n_modes"), F.lit(0))
    kurt = F.coalesce(F.col("kurtosis"), F.lit(0.0))
    out = rows.withColumns({
        "n_modes": modes, "kurtosis": kurt, "w_eff": F.col("w_nom") - 2 * shy,
        "_two": (modes == 2) & (F.coalesce(F.size("means"), F.lit(0)) >= 2),
    })
    w_eff = F.col("w_eff")
    out = out.withColumns({
        "m_max_two_abreast": F.when(w_eff > 0, F.floor(w_eff / w_lane)).otherwise(F.lit(0)).cast("int"),
        "separation": F.when(F.col("_two"), F.abs(F.get("means", F.lit(1)) - F.get("means", F.lit(0)))),
    })
    out = out.withColumn(
        "sep_ratio",
        F.when(F.col("_two"), F.when(w_eff > 0, F.try_divide(F.col("separation"), w_eff)).otherwise(F.lit(0.0))),
    )
    fits, modes = F.col("m_max_two_abreast"), F.col("n_modes")
    sep, ratio, wide = F.col("separation"), F.col("sep_ratio"), fixed(w_eff, 2)
    cases = [
        (fits == 0, K.SINGLE, F.lit(1), fill(K.WHY_TOO_NARROW, wide, F.lit(f"{w_lane:.2f}"))),
        (fits < 2, K.SINGLE, F.lit(1), fill(K.WHY_ONE_LANE, wide, F.lit(f"{2 * w_lane:.2f}"))),
        (modes == 0, K.NO_DATA, F.lit(0), F.lit(K.WHY_NO_DATA)),
        ((modes == 1) & (F.col("kurtosis") > 3), K.SINGLE, F.lit(1), fill(K.WHY_PEAKED, fixed(F.col("kurtosis"), 2))),
        (modes == 1, K.SINGLE, F.lit(1), fill(K.WHY_DISPERSED, fixed(F.col("kurtosis"), 2))),
        (F.col("_two") & ratio.between(0.45, 0.75), K.TWO_LANES, F.lit(2), fill(K.WHY_TWO_LANES, fixed(sep, 2), fixed(ratio, 2))),
        (F.col("_two") & (ratio < 0.35), K.SINGLE_FEET, F.lit(1), fill(K.WHY_FEET, fixed(sep, 2), fixed(ratio, 2))),
        (F.col("_two"), K.TWO_UNCERTAIN, F.lit(2), fill(K.WHY_UNCERTAIN, fixed(ratio, 2))),
        ((modes >= 3) & (fits < modes), K.SINGLE_COMPLEX, F.lit(1), fill(K.WHY_COMPLEX, modes, wide, fits)),
        (modes >= 3, K.MULTI, F.least(modes, fits), fill(K.WHY_MULTI, modes, fits)),
    ]
    pattern, lanes, why = F.lit(K.UNKNOWN), F.lit(0), F.lit("")
    for test, name, count, text in reversed(cases):
        pattern = F.when(test, F.lit(name)).otherwise(pattern)
        lanes = F.when(test, count).otherwise(lanes)
        why = F.when(test, text).otherwise(why)
    drift = F.coalesce(F.col("drift"), F.lit(False))
    out = out.withColumns({
        "pattern": pattern, "n_lanes": lanes.cast("int"),
        "rationale": F.concat(why, F.when(drift, F.lit(K.WHY_DRIFT)).otherwise(F.lit(""))),
        "temporal_drift_likely": drift, "single_file_possible": F.lit(True),
        "shy_distance": F.lit(float(shy)), "w_lane": F.lit(float(w_lane)),
    })
    return out.withColumn("description", _describe()).drop("_two", "drift")


def _describe() -> Column:
    name, wide, fits = F.col("pattern"), fixed(F.col("w_eff"), 2), F.col("m_max_two_abreast")
    return (
        F.when((name == K.SINGLE) & (fits == 0), fill(K.SAY_TOO_NARROW, wide))
        .when(name == K.SINGLE, fill(K.SAY_SINGLE, wide, fits))
        .when(name == K.SINGLE_FEET, F.lit(K.SAY_FEET))
        .when(name == K.SINGLE_COMPLEX, fill(K.SAY_COMPLEX, wide))
        .when(name == K.TWO_LANES, F.lit(K.SAY_TWO_LANES))
        .when(name == K.MULTI, fill(K.SAY_MULTI, F.col("n_lanes"), fits))
        .when(name == K.TWO_UNCERTAIN, F.lit(K.SAY_UNCERTAIN))
        .otherwise(fill(K.SAY_OTHER, name))
    )


def likely_units(rows: DataFrame, width: str = "width_raw", scale: str = "scale") -> DataFrame:
    """Adds likely_units, suggested_scale, unit_confidence, unit_reasoning."""
    w, s = F.col(width), F.col(scale)
    label, factor = F.lit("unknown"), F.lit(None).cast("double")
    sure, why = F.lit("low"), fill(K.UNIT_OUTSIDE, fixed(w, 2))
    for low, high, unit, suggested, confidence, word, digits in reversed(K.UNIT_RANGES):
        test = w.between(low, high)
        label = F.when(test, F.lit(unit)).otherwise(label)
        factor = F.when(test, F.lit(suggested)).otherwise(factor)
        sure = F.when(test, F.lit(confidence)).otherwise(sure)
        why = F.when(test, fill(K.UNIT_REASON, fixed(w, digits), F.lit(word))).otherwise(why)
    given = s != 1.0
    return rows.withColumns({
        "likely_units": F.when(given, F.lit("scaled")).otherwise(label),
        "suggested_scale": F.when(given, s).otherwise(factor),
        "unit_confidence": F.when(given, F.lit("user_specified")).otherwise(sure),
        "unit_reasoning": F.when(given, fill(K.UNIT_GIVEN, shortest(s))).otherwise(why),
    })


def calibration_limits(rows: DataFrame) -> DataFrame:
    """Rows with daily_500y, total_steps, scale, width_m, inlier_fraction (nullable) -> reasons, is_limited."""
    rate, width, inliers = F.col("daily_500y"), F.col("width_m"), F.col("inlier_fraction")
    reasons = F.array_compact(F.array(
        F.when(rate > 50000, fill(K.LIMIT_HIGH, fixed(rate, 0))),
        F.when((F.col("scale") == 1.0) & ((width < 0.4) | (width > 5.0)), fill(K.LIMIT_WIDTH, fixed(width, 2))),
        F.when(inliers < K.WEAK_INLIER_REPORT, fill(K.LIMIT_PLANE, percent(inliers, 1))),
        F.when((rate < 0.1) & (F.col("total_steps") > 0), fill(K.LIMIT_LOW, fixed(rate, 3))),
    ))
    return rows.withColumn("reasons", reasons).withColumn("is_limited", F.size("reasons") > 0)


def calibration_banner() -> Column:
    """Chart rule: unlike the reasons list it also fires when nothing was worn."""
    rate = F.col("daily_500y")
    return (rate > 50000) | (rate < 0.1) | (F.size("warnings") > 0)


def quality_flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "weak_plane": F.col("inlier_fraction") < K.WEAK_INLIER_REPORT,
        "high_exclusion": F.col("excluded_fraction") > 0.5,
        "implausible_depth": F.col("max_depth") > 200,
    })
