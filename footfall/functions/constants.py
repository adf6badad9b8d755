"""Fixed values. They must equal the published model for results to agree."""

# material key, display name, specific wear rate, its unit, hardness in Pa
MATERIALS = [
    ("granite", "Granite", 1e-6, "mm3_per_Nm", 7.5e9),
    ("marble", "Marble", 1e-5, "mm3_per_Nm", 2.25e9),
    ("sandstone", "Sandstone", 5e-5, "mm3_per_Nm", 2e9),
    ("limestone", "Limestone", 3e-5, "mm3_per_Nm", 2e9),
    ("oak", "Oak Wood", 1e-4, "mm3_per_Nm", 5e8),
]

# material key, median specific wear rate in mm3/(N m), standard deviation of its log
MATERIAL_PRIORS = [
    ("granite", 1e-6, 0.7),
    ("marble", 1e-5, 0.5),
    ("limestone", 3e-5, 1.0),
    ("sandstone", 5e-5, 1.2),
    ("wood", 1e-4, 0.8),
]

# scale hypotheses (scale, prior, label): default, then by raw width
SCALE_DEFAULT = [(0.001, 0.4, "mm"), (0.01, 0.3, "cm"), (1.0, 0.3, "m")]
SCALE_WIDE = [(0.001, 0.7, "mm"), (0.01, 0.2, "cm"), (1.0, 0.1, "m")]      # width > 100
SCALE_MIDDLE = [(0.001, 0.1, "mm"), (0.01, 0.5, "cm"), (1.0, 0.4, "m")]    # width > 1
SCALE_NARROW = [(0.001, 0.1, "mm"), (0.01, 0.2, "cm"), (1.0, 0.7, "m")]    # otherwise
SCALE_WIDE_ABOVE = 100.0
SCALE_MIDDLE_ABOVE = 1.0
SCALE_CV = 0.05

# gait
BODY_WEIGHT_N = 700.0
GRF_ASCENT = 1.2
GRF_DESCENT = 1.7
MICROSLIP_M = 0.002
GRF_STD = 0.2
GRF_LOW, GRF_HIGH = 1.0, 2.5
MICROSLIP_LOG_STD = 0.3
HORIZONS_YEARS = (50, 100, 200, 500, 1000)
DAYS_PER_YEAR = 365
MM3_PER_NM_TO_M2_PER_N = 1e-9

# surface fitting
BORDER = 0.1
TOP_QUANTILE = 0.75
TOP_QUANTILE_ABOVE = 100
MIN_SUPPORT = 10
RANSAC_ITERS = 500
RANSAC_THRESH_MM = 2.0
RANSAC_SEED = 0
TREAD_ANGLE_DEG = 25.0
ROI_QUANTILES = (0.01, 0.99)
GRID = 100
LEGACY_EDGE_QUANTILE = 0.95
NORM_EPS = 1e-10

# lanes
W_LANE_M = 0.55
SHY_M = 0.2
DRIFT_QUANTILES = (0.6, 0.75, 0.9)
DRIFT_SHIFT = 0.15
DRIFT_MIN_CELLS = 10
DRIFT_MIN_MASKED = 5
LATERAL_REPLICATES = 1000
LATERAL_MIN_SAMPLES = 10

# uncertainty
MC_SAMPLES = 500
MC_SEED = 42
WEAK_INLIER_MC = 0.6
WEAK_RMS_MC_MM = 5.0
WEAK_INLIER_REPORT = 0.5
PLANE_SHARE_FLOOR = 0.02
PLANE_SHARE_FACTOR = 0.3
AXIS_FLIP_AT = 0.85
SENSITIVITY_SOURCES = ("k_spec", "scale", "plane", "grf", "slip")

# Report wording. {n} marks the n-th formatted value.
DEPTH_WARNING = "Max wear depth > 200mm: likely axis/scale/segmentation issue"
STEP_WARNING = (
    "Per-step wear volume {0} m³ is implausibly high for stone - check k_spec units "
    "(expected mm3_per_Nm but got m2_per_N?)"
)
HIGH_TRAFFIC_WARNING = "Extremely high traffic ({0} footsteps/day): check k_spec and scale"
LOW_TRAFFIC_WARNING = (
    "Extremely low traffic ({0} footsteps/day): likely k_spec units mismatch or "
    "wear volume under-estimated"
)

# direction label, explanation
DESCENT = ("DESCENT", "High nosing wear indicates heavy descent traffic (braking forces at edge)")
ASCENT = ("ASCENT", "Low nosing wear with center concentration indicates ascent dominance")
DESCENT_MODERATE = ("DESCENT (moderate)", "Positive skewness suggests front-heavy wear pattern (descent bias)")
ASCENT_MODERATE = ("ASCENT (moderate)", "Negative skewness suggests back-heavy wear pattern (ascent bias)")
BALANCED = ("BIDIRECTIONAL (balanced)", "Balanced wear pattern indicates equal ascent and descent traffic")

# lane patterns
SINGLE = "SINGLE FILE"
SINGLE_FEET = "SINGLE FILE (alternating feet)"
SINGLE_COMPLEX = "SINGLE FILE (complex)"
TWO_LANES = "TWO LANES POSSIBLE"
TWO_UNCERTAIN = "UNCERTAIN (two modes)"
MULTI = "COMPLEX MULTI-LANE"
NO_DATA = "INSUFFICIENT DATA"
UNKNOWN = "unknown"

WHY_TOO_NARROW = "Effective width {0}m < {1}m: physically constrained to single file (cannot fit standard lane width)"
WHY_ONE_LANE = "Effective width {0}m < {1}m: only single lane fits, single-file traffic"
WHY_NO_DATA = "No wear pattern detected"
WHY_PEAKED = "Unimodal peaked distribution (kurtosis={0}): single-file traffic"
WHY_DISPERSED = "Unimodal dispersed distribution (kurtosis={0}): low-density single-file"
WHY_TWO_LANES = "Two peaks separated by {0}m (sep_ratio={1}): consistent with bi-directional lanes"
WHY_FEET = "Two close peaks (sep={0}m, ratio={1}): likely alternating foot placement"
WHY_UNCERTAIN = "Two peaks with intermediate separation (sep_ratio={0}): ambiguous pattern"
WHY_COMPLEX = (
    "GMM detected {0} modes but W_eff={1}m only allows {2} two-abreast lanes: "
    "likely temporal drift or artifacts"
)
WHY_MULTI = "{0} modes detected within physical constraints (M_max_two_abreast={1})"
WHY_DRIFT = " | TEMPORAL DRIFT DETECTED: peaks may represent different usage periods"

SAY_TOO_NARROW = "Single-file traffic (W_eff={0}m cannot fit standard lane, single file always possible)"
SAY_SINGLE = "Single-file traffic (W_eff={0}m allows max {1} two-abreast lanes)"
SAY_FEET = "Single-file with alternating foot placement pattern"
SAY_COMPLEX = "Single-file traffic with temporal variation (constrained by W_eff={0}m)"
SAY_TWO_LANES = "Two distinct lanes detected (bi-directional or paired traffic)"
SAY_MULTI = "Multiple lanes detected ({0} lanes within {1} max two-abreast)"
SAY_UNCERTAIN = "Two modes detected but separation is ambiguous"
SAY_OTHER = "Pattern: {0}"

# unit heuristic: low, high, unit, suggested scale, confidence, unit word, decimals
UNIT_RANGES = [
    (500.0, 1500.0, "mm", 0.001, "high", "millimeters", 1),
    (50.0, 150.0, "cm", 0.01, "medium", "centimeters", 1),
    (0.4, 5.0, "m", 1.0, "high", "meters", 2),
]
UNIT_REASON = "Width {0} units suggests {1}"
UNIT_OUTSIDE = "Width {0} units outside typical range"
UNIT_GIVEN = "User specified scale={0}"

LIMIT_HIGH = "Extremely high traffic ({0} footsteps/day at 500y)"
LIMIT_WIDTH = "Implausible surface width ({0}m) with scale=1.0 - likely unit mismatch"
LIMIT_PLANE = "Weak reference plane fit ({0} inliers) - results less reliable"
LIMIT_LOW = "Extremely low traffic ({0} footsteps/day) - likely calibration issue"
