"""Whole analyses under rules instead of seeded draws, as queries that SQL can repeat.

The plane fit takes its candidate triples by a rule of the iteration number, the mixture a fixed number of
rounds, the bootstrap its draw counts and the propagation its samples by rules of the replicate's number.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.catalog import (
    AXES, BOX, CAND, DIRECTION, DRIFT, FIT, GRID, HYP, LANES, LATERAL, LEG, LEGACY, MOMENTS, ORACLE, RANKS, REGION, RHO, ROI, SCORE, SF, SGRID, SHARES, SL, SN, ST, STRIP, SV, TILT, TREAD,
    VOLUME, VOLUME_OUT, cte, fixed_triples, grid_sql, query, r, shipment_cells, surfaces,
)
from footfall.functions import constants as K
from footfall.operators import grid as Gr, plane as P, uncertainty as U
from footfall.operators.mixture import VARIANCE_FLOOR, lateral_mixture
from footfall.plans import pipeline as PL
from footfall.session import materialize
from footfall.sinks import charts, report

ROUNDS = 6
REPLICATES = 64
EPS = f"'{float(10 * np.finfo(float).eps)!r}'::DOUBLE"
TAU = f"'{float(2 * np.pi)!r}'::DOUBLE"


# --- mixture ---------------------------------------------------------------------

def mixture_sql(rounds: int = ROUNDS) -> str:
    """Fixed rounds of expectation-maximisation for one to three components, the smallest BIC first."""
    def parameters(i: int, source: str) -> list[str]:
        return [
            f"ms{i} AS MATERIALIZED (SELECT mesh_id, k, c, sum(n*rp)+{EPS} AS mass, sum(n*rp*x)/(sum(n*rp)+{EPS}) AS mean FROM {source} GROUP BY mesh_id, k, c)",
            f"""pm{i} AS MATERIALIZED (SELECT s.mesh_id, s.k, s.c, any_value(m.mean) AS mean, sum(n*rp*(x-m.mean)*(x-m.mean))/any_value(mass)+{VARIANCE_FLOOR!r}::DOUBLE AS var,
  any_value(mass)/any_value(allm) AS share FROM {source} s JOIN (SELECT *, sum(mass) OVER (PARTITION BY mesh_id, k) AS allm FROM ms{i}) m ON m.mesh_id = s.mesh_id AND m.k = s.k AND m.c = s.c GROUP BY s.mesh_id, s.k, s.c)""",
        ]

    def densities(i: int) -> str:
        return f"""dn{i} AS MATERIALIZED (SELECT *, top+ln(sum(exp(lp-top)) OVER (PARTITION BY mesh_id, k, j)) AS norm FROM (SELECT *, max(lp) OVER (PARTITION BY mesh_id, k, j) AS top
  FROM (SELECT b.mesh_id, p.k, p.c, b.j, b.x, b.n, ln(share)-0.5*(ln({TAU}*var)+(b.x-mean)*(b.x-mean)/var) AS lp FROM bins b JOIN pm{i} p ON p.mesh_id = b.mesh_id)))"""

    parts = [
        "bins AS MATERIALIZED (SELECT mesh_id, j, x, CAST(weight AS DOUBLE) AS n, sum(weight) OVER (PARTITION BY mesh_id ORDER BY x, weight ROWS UNBOUNDED PRECEDING) AS cum, sum(weight) OVER (PARTITION BY mesh_id) AS total FROM lat)",
        "enough AS (SELECT mesh_id FROM bins GROUP BY mesh_id HAVING max(total) >= 10)",
        "ks AS (SELECT k, c FROM range(1, 4) a(k), range(0, 3) b(c) WHERE c < k)",
        "ctr AS MATERIALIZED (SELECT mesh_id, k, c, min(x) AS centre FROM bins JOIN enough USING (mesh_id), ks WHERE cum >= (c+0.5)/k*total GROUP BY mesh_id, k, c)",
        "nr AS MATERIALIZED (SELECT b.mesh_id, k, c, j, x, n, CAST(row_number() OVER (PARTITION BY b.mesh_id, k, j ORDER BY abs(x-centre), c) = 1 AND n > 0 AS INTEGER) AS rp FROM bins b JOIN ctr ON ctr.mesh_id = b.mesh_id)",
        *parameters(0, "nr"),
    ]
    for i in range(rounds):
        parts += [densities(i), f"rs{i} AS (SELECT mesh_id, k, c, j, x, n, exp(lp-norm) AS rp FROM dn{i})", *parameters(i + 1, f"rs{i}")]
    parts += [densities(rounds), f"""bic AS (SELECT mesh_id, k, -2*sum(n*norm)+(3*k-1)*ln(any_value(total)) AS bic FROM (SELECT d.mesh_id, k, j, any_value(n) AS n, any_value(norm) AS norm FROM dn{rounds} d GROUP BY d.mesh_id, k, j) q
  JOIN (SELECT mesh_id, any_value(total) AS total FROM bins GROUP BY mesh_id) t USING (mesh_id) GROUP BY mesh_id, k)""",
        "pick AS (SELECT mesh_id, k, bic FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY bic, k) AS rn FROM bic) WHERE rn = 1)",
        f"mix AS MATERIALIZED (SELECT p.mesh_id, p.k, bic, row_number() OVER (PARTITION BY p.mesh_id ORDER BY mean) AS place, mean, sqrt(var) AS std, share FROM pick p JOIN pm{rounds} m ON m.mesh_id = p.mesh_id AND m.k = p.k)"]
    return ",\n".join(parts)


MIXTURE_COLUMNS = ("mean", "std", "share")


@query("ruled_mixture", cte(*LEG, LATERAL, mixture_sql()) + """SELECT mesh_id, CAST(k AS INTEGER) AS n_modes, round(bic, 4) AS bic, CAST(place AS INTEGER) AS place,
round(mean, 6) AS mean, round(std, 6) AS std, round(share, 6) AS share FROM mix""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = lateral_mixture(materialize(Gr.lateral_profile(*shipment_cells(spark, sf), GRID), "lateral"), ROUNDS)
    rows = found.select("mesh_id", "n_modes", r("bic", 4), F.posexplode(F.arrays_zip("means", "stds", "weights")).alias("place", "c"))
    return rows.select("mesh_id", "n_modes", "bic", (F.col("place") + 1).alias("place"), r(F.col("c.means"), 6, "mean"), r(F.col("c.stds"), 6, "std"), r(F.col("c.weights"), 6, "share"))


# --- wear analysis ---------------------------------------------------------------

RULES = PL.Config(axes=AXES, triples=lambda counts, iters: fixed_triples(counts), mixture_rounds=ROUNDS)
PLANE_CTE = (SV, BOX, STRIP, CAND, HYP, SCORE, FIT, """pl AS MATERIALIZED (SELECT b.mesh_id, coalesce(rf.a, 0.0) AS a, coalesce(rf.b, 0.0) AS b, coalesce(rf.c, (SELECT quantile_cont(z, 0.5) FROM sv WHERE sv.mesh_id=b.mesh_id)) AS c,
  coalesce(inliers/cn.n, 0.0) AS inlier_fraction, coalesce(rms, 0.0) AS rms, CASE WHEN rf.mesh_id IS NULL THEN 'fallback' ELSE 'RANSAC' END AS plane_method
  FROM box b LEFT JOIN cn ON cn.mesh_id=b.mesh_id LEFT JOIN bs ON bs.mesh_id=b.mesh_id LEFT JOIN rf ON rf.mesh_id=b.mesh_id LEFT JOIN rm ON rm.mesh_id=b.mesh_id)""")
TREAD_ON = (SF, ST, SN, SL, TILT, ROI, TREAD)
ON_PLANE = ("tri AS (SELECT t.*, pl.a, pl.b, pl.c FROM tread t JOIN pl ON pl.mesh_id=t.mesh_id WHERE is_tread)", VOLUME,
            "vo AS (SELECT mesh_id, sum((p0+p1+p2)/3.0*area) AS volume, max(greatest(p0,p1,p2))*1000.0 AS max_depth, coalesce(avg(CASE WHEN p0+p1+p2 > 0 THEN (p0+p1+p2)/3.0 END), 0)*1000.0 AS mean_depth, count(*) AS used FROM dep GROUP BY mesh_id)")
PLANE_CELLS = """cell AS MATERIALIZED (SELECT n.mesh_id, n.i, n.j, n.x, n.y, coalesce(greatest(0.0, a*n.x+b*n.y+c-u_top), 0.0)*1000.0 AS depth_mm FROM nodes n
  JOIN pl ON pl.mesh_id=n.mesh_id LEFT JOIN top t ON t.mesh_id=n.mesh_id AND t.i=n.i AND t.j=n.j)"""
LANES_OF = """ln AS (SELECT lmom.mesh_id, coalesce(mx.k, 0) AS n_modes, CASE WHEN mx.k > 0 THEN m4/(m2*m2)-3.0 END AS kurt, coalesce(CASE WHEN mx.k > 0 THEN m4/(m2*m2)-3.0 END, 0.0) AS kurtosis, CASE WHEN mx.k > 0 THEN m3/(m2*sqrt(m2)) END AS lateral_skewness,
  mx.m0, mx.m1, lmom.w_nom, coalesce(shift_ratio > 0.15, false) AND coalesce(mx.k, 0) > 0 AS drift, shift_ratio
  FROM lmom LEFT JOIN (SELECT mesh_id, any_value(k) AS k, min(mean) FILTER (place = 1) AS m0, min(mean) FILTER (place = 2) AS m1 FROM mix GROUP BY mesh_id) mx ON mx.mesh_id = lmom.mesh_id LEFT JOIN dr ON dr.mesh_id = lmom.mesh_id)"""
ANALYSIS_CTE = (*PLANE_CTE, *TREAD_ON, *ON_PLANE, *SGRID, grid_sql("sp", "sb"), PLANE_CELLS, LATERAL, MOMENTS, REGION, DRIFT, DIRECTION, mixture_sql(), LANES_OF, LANES[LANES.index("le AS"):],
                "sg AS (SELECT mesh_id, 1.0-count(*) FILTER (is_tread)/count(*) AS excluded_fraction FROM tread GROUP BY mesh_id)",
                "an AS (SELECT *, volume/(1e-6*1e-9*(700.0*1.7)*0.002) AS total_steps FROM pl LEFT JOIN vo USING (mesh_id) JOIN sg USING (mesh_id) JOIN dir USING (mesh_id) JOIN lo USING (mesh_id))")
ROUNDED = {"volume_cm3": "volume*1e6", "max_depth": "max_depth", "mean_depth": "mean_depth", "inlier_fraction": "inlier_fraction", "rms_error_mm": "rms", "excluded_fraction": "excluded_fraction",
           "kurtosis": "kurt", "lateral_skewness": "lateral_skewness", "w_nom": "w_nom", "w_eff": "w_eff", "nosing_wear": "nosing_wear", "center_wear": "center_wear", "nosing_wear_ratio": "nosing_wear_ratio",
           "shift_ratio": "shift_ratio", "confidence": "confidence"}


@query("ruled_analysis", cte(*ANALYSIS_CTE) + "SELECT mesh_id, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in ROUNDED.items()) + """, round(total_steps, 0) AS total_steps, round(total_steps/(500*365.0), 3) AS daily_500y, used AS triangles_used, plane_method,
CAST(n_modes AS INTEGER) AS n_modes, dominant_direction, pattern, CAST(n_lanes AS INTEGER) AS n_lanes, rationale, drift AS temporal_drift_likely, inlier_fraction < 0.5 AS weak_plane, excluded_fraction > 0.5 AS high_exclusion, max_depth > 200 AS implausible_depth FROM an""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = PL.analyze(surfaces(spark, sf), RULES)[2].withColumn("volume_cm3", F.col("volume") * 1e6)
    kurtosis = F.when(F.col("n_modes") > 0, F.col("kurtosis"))
    return found.withColumn("kurtosis", kurtosis).select(
        "mesh_id", *[r(c, 6) for c in ROUNDED], r("total_steps", 0), r("daily_500y", 3), "triangles_used", "plane_method", "n_modes", "dominant_direction", "pattern", "n_lanes", "rationale",
        "temporal_drift_likely", "weak_plane", "high_exclusion", "implausible_depth")


# --- bootstrap and propagation ---------------------------------------------------

def ruled_times(ords: np.ndarray, reps: int) -> np.ndarray:
    """How often replicate b takes row number ord, by a rule of both: 0 to 3 times."""
    b, at = np.arange(reps)[:, None], ords[None, :]
    return ((b * 7919 + at * 10473 + b * at * 31) % 13 % 4).astype(float)


BOOTSTRAP = f"""inl AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY vid)-1 AS o, avg(w) OVER (PARTITION BY mesh_id) AS ow, avg(d) OVER (PARTITION BY mesh_id) AS od, avg(u) OVER (PARTITION BY mesh_id) AS ou
  FROM (SELECT mesh_id, vid, w, d, u FROM nl UNION ALL SELECT mesh_id, vid, x, y, z FROM sv WHERE mesh_id NOT IN (SELECT mesh_id FROM rf))),
wt AS (SELECT mesh_id, b, (b*7919+o*10473+b*o*31) % 13 % 4 AS t, ow, od, ou, w-ow AS w, d-od AS d, u-ou AS u FROM inl, range(0, {REPLICATES}) r(b)),
bm AS (SELECT mesh_id, b, any_value(ow) AS ow, any_value(od) AS od, any_value(ou) AS ou, sum(t) AS s, sum(t*w)/sum(t) AS w, sum(t*d)/sum(t) AS d, sum(t*u)/sum(t) AS u,
  sum(t*w*w)/sum(t) AS ww, sum(t*d*d)/sum(t) AS dd, sum(t*w*d)/sum(t) AS wd, sum(t*w*u)/sum(t) AS wu, sum(t*d*u)/sum(t) AS du FROM wt GROUP BY mesh_id, b),
bv AS (SELECT *, ww-w*w AS vw, dd-d*d AS vd, wd-w*d AS cwd, wu-w*u AS cwu, du-d*u AS cdu FROM bm),
bp AS (SELECT *, (cwu*vd-cdu*cwd)/(vw*vd-cwd*cwd) AS pa, (cdu*vw-cwu*cwd)/(vw*vd-cwd*cwd) AS pb FROM bv),
bt AS MATERIALIZED (SELECT mesh_id, CAST(b AS INTEGER) AS b, pa, pb, u+ou-pa*(w+ow)-pb*(d+od) AS pc FROM bp)"""


@query("ruled_bootstrap", cte(*PLANE_CTE, BOOTSTRAP) + "SELECT mesh_id, b, round(pa, 6) AS pa, round(pb, 6) AS pb, round(pc, 6) AS pc FROM bt")
def _(spark: SparkSession, sf: str) -> DataFrame:
    surface = PL.load(surfaces(spark, sf), RULES)
    support, planes = P.bootstrap_support(surface.points, surface.frame, surface.fit(K.RANSAC_ITERS, K.RANSAC_THRESH_MM))
    found = P.bootstrap_planes(support, planes, REPLICATES, times=ruled_times)[0]
    return found.select("mesh_id", "b", r("pa", 6), r("pb", 6), r("pc", 6))


def finite(name: str) -> F.Column:
    """The value, or null where a centre without wear leaves no number."""
    return F.when(~F.isnan(name) & (F.abs(F.col(name)) < float("inf")), F.col(name))


UNITS = (("mm", 0.001), ("cm", 0.01), ("m", 1.0))


def ruled_draws(meshes: DataFrame) -> DataFrame:
    """Monte Carlo draws by a rule of the sample number."""
    s = F.col("s")
    unit = F.element_at(F.array(*[F.struct(F.lit(u).alias("label"), F.lit(x).alias("scale")) for u, x in UNITS]), (s % 3 + 1).cast("int"))
    rows = meshes.select("mesh_id", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("s"))
    return rows.select(
        "mesh_id", "s", (unit["scale"] * (0.9 + (s % 11) / 64.0)).alias("scale"), unit["label"].alias("hypothesis"), (s * 5 % REPLICATES).cast("long").alias("b"),
        (1e-6 * (0.5 + (s % 7) / 4.0)).alias("k_spec"), (1.25 + (s % 5) / 8.0).alias("grf"), ((1 + s % 9) / 1024.0).alias("slip"),
        (0.875 + (s % 4) / 16.0).alias("threshold"), (4.0 + (s % 3) / 2.0).alias("slope"))


DRAWS = f"""dw AS MATERIALIZED (SELECT CAST(s AS INTEGER) AS s, [{', '.join(f'{x!r}::DOUBLE' for _, x in UNITS)}][s%3+1]*(0.9::DOUBLE+(s%11)/64.0) AS scale, [{', '.join(f"'{u}'" for u, _ in UNITS)}][s%3+1] AS hypothesis, s*5%{REPLICATES} AS b,
  1e-6*(0.5+(s%7)/4.0) AS k_spec, 1.25+(s%5)/8.0 AS grf, (1+s%9)/1024.0 AS slip, 0.875+(s%4)/16.0 AS threshold, 4.0+(s%3)/2.0 AS slope FROM range(0, {REPLICATES}) q(s))"""
SAMPLED = (
    "tri AS (SELECT t.*, bt.b AS rep, pa AS a, pb AS b, pc AS c FROM tread t JOIN bt ON bt.mesh_id=t.mesh_id WHERE is_tread)", VOLUME,
    "bw AS MATERIALIZED (SELECT mesh_id, rep, sum((p0+p1+p2)/3.0*area) AS volume, max(greatest(p0,p1,p2))*1000.0 AS max_depth, coalesce(avg(CASE WHEN p0+p1+p2 > 0 THEN (p0+p1+p2)/3.0 END), 0)*1000.0 AS mean_depth FROM dep GROUP BY mesh_id, rep)",
    """nz AS MATERIALIZED (SELECT v.mesh_id, s, avg(greatest(0.0, pa*scale*x+pb*scale*y+pc-scale*z)) FILTER (y < y_min+0.25*(y_max-y_min)) AS front,
  avg(greatest(0.0, pa*scale*x+pb*scale*y+pc-scale*z)) FILTER (y >= y_min+0.25*(y_max-y_min) AND y <= y_max-0.25*(y_max-y_min)) AS centre
  FROM sv v JOIN box x0 ON x0.mesh_id=v.mesh_id JOIN bt ON bt.mesh_id=v.mesh_id JOIN dw ON dw.b=bt.b GROUP BY v.mesh_id, s)""",
    """sm AS MATERIALIZED (SELECT bt.mesh_id, dw.s, dw.scale, dw.hypothesis, dw.k_spec, dw.grf, dw.slip, volume, max_depth, mean_depth,
  CASE WHEN centre = 0 THEN CASE WHEN coalesce(front, 0) > 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE coalesce(front, 0)/coalesce(centre, 1e-10) END AS nosing_ratio, threshold, slope,
  volume/(k_spec*1e-9*(700.0*grf)*slip) AS traffic FROM bt JOIN dw ON dw.b=bt.b JOIN bw ON bw.mesh_id=bt.mesh_id AND bw.rep=bt.b JOIN nz ON nz.mesh_id=bt.mesh_id AND nz.s=dw.s)""",
    "sp_ AS MATERIALIZED (SELECT *, 1.0/(1.0+exp(slope*(nosing_ratio-threshold))) AS prob_ascent FROM sm)")
SAMPLE_CTE = (*PLANE_CTE, BOOTSTRAP, *TREAD_ON, DRAWS, *SAMPLED)
SAMPLE_COLUMNS = {"volume_cm3": "volume*1e6", "max_depth": "max_depth", "mean_depth": "mean_depth", "nosing_ratio": "nosing_ratio", "prob_ascent": "prob_ascent"}
RULED = PL.Config(axes=AXES, triples=RULES.triples, times=ruled_times)


def ruled_surface(spark: SparkSession, sf: str) -> tuple[PL.Surface, DataFrame]:
    surface = PL.load(surfaces(spark, sf), RULED)
    return surface, ruled_draws(surface.frame.df)


@query("ruled_samples", cte(*SAMPLE_CTE) + "SELECT mesh_id, s, hypothesis, round(scale, 9) AS scale, " + ", ".join(f"round(CASE WHEN isfinite({e}) THEN {e} END, 6) AS {c}" for c, e in SAMPLE_COLUMNS.items()) + ", round(traffic, 0) AS traffic FROM sp_")
def _(spark: SparkSession, sf: str) -> DataFrame:
    surface, draws = ruled_surface(spark, sf)
    found = PL.propagate(surface, REPLICATES, samples_only=True, draws=draws).withColumn("volume_cm3", F.col("volume") * 1e6)
    return found.select("mesh_id", "s", "hypothesis", r("scale"), *[r(finite(c), 6, c) for c in SAMPLE_COLUMNS], r("traffic", 0))


METRICS = {"volume": 1e6, "max_depth": 1.0, "mean_depth": 1.0, "prob_ascent": 1.0, "nosing_ratio": 1.0, "total_steps": 1e-6, "daily_500y": 1.0}
DISTRIBUTION = {"mean": "mean", "median": "median", "std": "std", "lo50": "ci_50.lo", "hi50": "ci_50.hi", "lo95": "ci_95.lo", "hi95": "ci_95.hi"}
SUMMARY = "mt AS (" + " UNION ALL ".join(
    f"SELECT mesh_id, '{m}' AS metric, {k!r}::DOUBLE*{'traffic' if m == 'total_steps' else 'traffic/(500*365.0)' if m == 'daily_500y' else m} AS v FROM sp_" for m, k in METRICS.items()) + ")"


def _summary_sql() -> str:
    figures = {"mean": "avg(v)", "median": "quantile_cont(v, 0.5)", "std": "stddev_pop(v)", "lo50": "quantile_cont(v, 0.25)", "hi50": "quantile_cont(v, 0.75)", "lo95": "quantile_cont(v, 0.025)", "hi95": "quantile_cont(v, 0.975)"}
    spoiled = "bool_and(isfinite(v))"  # one sample without a number leaves no distribution
    return "SELECT mesh_id, metric, " + ", ".join(f"CASE WHEN {spoiled} THEN round({e}, 6) END AS {c}" for c, e in figures.items()) + " FROM mt GROUP BY mesh_id, metric"


@query("ruled_propagation", cte(*SAMPLE_CTE, SUMMARY) + _summary_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    surface, draws = ruled_surface(spark, sf)
    found = PL.propagate(surface, REPLICATES, draws=draws)
    rows = F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), *[(F.col(f"{m}.{p}") * k).alias(c) for c, p in DISTRIBUTION.items()]) for m, k in METRICS.items()]))
    known = finite("mean").isNotNull()  # a sample that is no number spoils the mean
    return found.select("mesh_id", rows).select("mesh_id", "metric", *[r(F.when(known, F.col(c)), 6, c) for c in DISTRIBUTION])


# The level-reference method, chosen by its setting.
LEVEL = PL.Config(axes=AXES, use_legacy_wear_volume=True, compat=False, mixture_rounds=ROUNDS)
LEVEL_CTE = (SV, "pv AS (SELECT mesh_id, x AS w, y AS d, z AS u FROM sv)",
             "pb AS (SELECT mesh_id, min(w) AS w_min, max(w) AS w_max, min(d) AS d_min, max(d) AS d_max, max(u) AS u_max FROM pv GROUP BY mesh_id)", grid_sql("pv", "pb"), LEGACY, LATERAL, MOMENTS, REGION, DRIFT, DIRECTION,
             mixture_sql(), LANES_OF, LANES[LANES.index("le AS"):],
             f"lv AS (SELECT c.mesh_id, sum(depth_mm/1000.0)*min(((w_max-w_min)/{GRID-1})*((d_max-d_min)/{GRID-1})) AS volume, max(depth_mm) AS max_depth, coalesce(avg(depth_mm) FILTER (depth_mm > 0), 0) AS mean_depth FROM cell c JOIN pb ON pb.mesh_id=c.mesh_id GROUP BY c.mesh_id)")
LEVEL_COLUMNS = {"volume_cm3": "volume*1e6", "max_depth": "max_depth", "mean_depth": "mean_depth", "reference_height": "h", "w_nom": "w_nom", "nosing_wear_ratio": "nosing_wear_ratio", "shift_ratio": "shift_ratio", "confidence": "confidence"}


@query("ruled_legacy_analysis", cte(*LEVEL_CTE) + "SELECT mesh_id, 'legacy_grid' AS method, " + ", ".join(f"round({e}, 6) AS {c}" for c, e in LEVEL_COLUMNS.items()) + """, round(volume/(1e-6*1e-9*(700.0*1.7)*0.002)/(500*365.0), 3) AS daily_500y,
CAST(n_modes AS INTEGER) AS n_modes, dominant_direction, pattern, drift AS temporal_drift_likely FROM lv JOIN ref USING (mesh_id) JOIN dir USING (mesh_id) JOIN lo USING (mesh_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = PL.analyze(surfaces(spark, sf), LEVEL)[2].withColumn("volume_cm3", F.col("volume") * 1e6)
    return found.select("mesh_id", "method", *[r(c, 6) for c in LEVEL_COLUMNS], r("daily_500y", 3), "n_modes", "dominant_direction", "pattern", "temporal_drift_likely")


# --- texts -----------------------------------------------------------------------
# The wording below is fixed: it repeats the report's and the charts' texts.

_SAID = ORACLE["simultaneity"]
DESCRIPTION = _SAID[_SAID.index("CASE WHEN pattern='SINGLE FILE' AND fits=0"):_SAID.index(" AS description")]
TEXT_CTE = (*ANALYSIS_CTE, "cd AS (SELECT b.mesh_id, coalesce(cn.n, 0) AS candidates FROM box b LEFT JOIN cn ON cn.mesh_id=b.mesh_id)",
            "tc AS (SELECT mesh_id, count(*) FILTER (is_tread) AS tread_count FROM tread GROUP BY mesh_id)",
            f"""tx AS (SELECT *, total_steps/(500*365.0) AS daily, CASE WHEN total_steps > 0 THEN volume/total_steps ELSE 0 END AS step_volume, {DESCRIPTION} AS description
  FROM (SELECT * REPLACE (coalesce(volume, 0.0) AS volume, coalesce(max_depth, 0.0) AS max_depth, coalesce(total_steps, 0.0) AS total_steps) FROM an) JOIN cd USING (mesh_id) JOIN tc USING (mesh_id))""",
            f"""wn AS (SELECT *, list_filter([CASE WHEN max_depth > 200 THEN '{K.DEPTH_WARNING}' END, CASE WHEN step_volume > 1e-9 THEN 'Per-step wear volume ' || printf('%.2e', step_volume) || '{K.STEP_WARNING.split("{0}")[1].replace("'", "''")}' END,
  CASE WHEN daily > 50000 THEN 'Extremely high traffic (' || printf('%.0f', daily) || '{K.HIGH_TRAFFIC_WARNING.split("{0}")[1]}' END,
  CASE WHEN daily < 0.1 AND total_steps > 0 THEN 'Extremely low traffic (' || printf('%.3f', daily) || '{K.LOW_TRAFFIC_WARNING.split("{0}")[1]}' END], lambda x: x IS NOT NULL) AS warnings FROM tx)""")


def _lines_sql(lines: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(lines) + "], lambda x: x IS NOT NULL), chr(10))"


def _report_sql() -> str:
    rule = f"'{report.RULE}'"
    years = [f"'  If {f'{y:>3} years old:'.ljust(16)}' || printf('%.3f', total_steps/({y}*365.0)) || ' footsteps/day'" for y in K.HORIZONS_YEARS]
    return _lines_sql([
        rule, "'SURFACE WEAR REPORT'", rule, "''", "'Input File: ' || mesh_id", "'Material: Granite'", "'Wear Volume Method: robust_triangle'", "''", "'--- ROBUST METHOD DIAGNOSTICS ---'",
        "'Reference Plane:'", "'  Method: ' || plane_method", "'  Inlier fraction: ' || printf('%.1f', inlier_fraction*100) || '%'", "'  RMS error: ' || printf('%.2f', rms) || ' mm'", "'  Candidates used: ' || candidates",
        "'Tread Segmentation:'", "'  Tread triangles: ' || tread_count", "'  Excluded fraction: ' || printf('%.1f', excluded_fraction*100) || '%'",
        "CASE WHEN inlier_fraction < 0.5 THEN '  WARNING: Weak reference plane fit (inliers < 50%)' END", "CASE WHEN excluded_fraction > 0.5 THEN '  WARNING: High triangle exclusion (> 50%)' END",
        "CASE WHEN max_depth > 200 THEN '  WARNING: Implausible max depth (> 200mm)' END", "''", "'--- QUESTION 1: HOW OFTEN WAS THE SURFACE USED? ---'",
        "'Total estimated footsteps: ' || printf('%.2e', total_steps)", "'Wear volume: ' || printf('%.2e', volume) || ' m^3'", "''", "'Estimated daily traffic (by building age):'", *years,
        "CASE WHEN len(warnings) > 0 THEN '' END", "CASE WHEN len(warnings) > 0 THEN '  TRAFFIC VOLUME WARNINGS:' END",
        "CASE WHEN len(warnings) > 0 THEN array_to_string(list_transform(warnings, lambda x: '    - ' || x), chr(10)) END", "''", "'--- QUESTION 2: WAS A DIRECTION FAVORED? ---'",
        "'Dominant direction: ' || dominant_direction", "'Confidence: ' || printf('%.1f', confidence) || '%'", "'Ascent/Descent ratio: ' || printf('%.2f', ascent_descent_ratio)", "'Explanation: ' || explanation", "''",
        "'--- QUESTION 3: HOW MANY PEOPLE SIMULTANEOUSLY? ---'", "'Usage pattern: ' || pattern", "'Description: ' || description", "'Number of lanes: ' || n_lanes", "'Effective width: ' || wide || ' m'",
        "'Single file possible: True'", "'Two-abreast lanes: ' || fits", "CASE WHEN drift THEN 'Temporal drift detected: YES (peaks shift over depth)' ELSE 'Temporal drift detected: NO' END", "''", rule])


HEATMAP = ["'Method: robust_triangle'", "'Max depth: ' || printf('%.1f', max_depth) || ' mm'", "'Volume: ' || printf('%.3g', volume) || ' m³'", "'Volume: ' || printf('%.1f', volume*1000) || ' L'",
           "'RANSAC inliers: ' || printf('%.1f', inlier_fraction*100) || '%'", "CASE WHEN inlier_fraction < 0.5 THEN '⚠ weak plane fit' END", "'RMS error: ' || printf('%.2f', rms) || ' mm'",
           "'Excluded: ' || printf('%.1f', excluded_fraction*100) || '%'"]
LATERAL_TEXT = ["'Final Pattern: ' || pattern", "'W_nom: ' || printf('%.2f', w_nom) || 'm  W_eff: ' || wide || 'm'", "'shy_dist: 0.20m  w_lane: 0.55m'", "'M_max_two_abreast: ' || fits",
                "'Single file possible: True'", "CASE WHEN drift THEN '⚠ Temporal drift: YES' END"]
ALONG_TEXT = ["'Nosing Ratio: ' || printf('%.2f', nosing_wear_ratio)", "'Direction: ' || dominant_direction", "'Confidence: ' || printf('%.0f', confidence) || '%'", "''", "'(Heuristic inference)'",
              "'Assumes depth axis orientation is correct; flip if reversed.'"]
BAR = "━" * 25
SUMMARY_TEXT = [f"'STABLE CONCLUSIONS' || chr(10) || '{BAR}' || chr(10) || chr(10) || '✅ GEOMETRY:'", "'  • Max depth: ' || printf('%.1f', max_depth) || ' mm'",
                "'  • Volume: ' || printf('%.3g', volume) || ' m³ (' || printf('%.1f', volume*1000) || ' L)'", "'  • Method: robust_triangle' || CASE WHEN inlier_fraction < 0.5 THEN ' (⚠ weak plane fit)' ELSE '' END",
                "chr(10) || '✅ SIMULTANEITY (Physics-Constrained):'", "'  • Pattern: ' || pattern", "'  • W_eff: ' || wide || ' m'", "'  • ' || description", "chr(10) || '⚠ DIRECTION (Heuristic):'",
                "'  • ' || dominant_direction", "'  • Confidence: ' || printf('%.0f', confidence) || '%'", "'  • ' || explanation", "'  • Note: Assumes depth axis orientation' || chr(10) || '    is correct; flip if reversed.'",
                "chr(10) || '⚠ TRAFFIC: CALIBRATION-LIMITED' || chr(10) || '  • Traffic estimates require validated' || chr(10) || '    scale/material parameters.' || chr(10) || '  • See traffic_assumptions.png for' || chr(10) || '    conditional estimates.'",
                "CASE WHEN drift THEN chr(10) || '⚠ Temporal drift detected' || chr(10) || '  (peaks shift over depth)' END"]
CHARTS = {"report": _report_sql(), "heatmap": _lines_sql(HEATMAP), "lateral": _lines_sql(LATERAL_TEXT), "longitudinal": _lines_sql(ALONG_TEXT), "summary": _lines_sql(SUMMARY_TEXT)}


@query("ruled_texts", cte(*TEXT_CTE) + " UNION ALL ".join(f"SELECT mesh_id, '{name}' AS chart, {text} AS text FROM wn" for name, text in CHARTS.items()))
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, wear, results = PL.analyze(surfaces(spark, sf), RULES)
    texts = {"report": report.report(results), "heatmap": charts.heatmap_info(results), "lateral": charts.lateral_info(results),
             "longitudinal": charts.longitudinal_info(wear.longitudinal, results), "summary": charts.conclusions(results)}
    rows = [t.select("mesh_id", F.lit(name).alias("chart"), "text") for name, t in texts.items()]
    return functools.reduce(DataFrame.union, rows)


def _spoiled(name: str, value: str) -> str:
    """Quantiles and mean of a metric; one sample that is no number leaves no distribution."""
    figures = {"m": f"quantile_cont({value}, 0.5)", "lo": f"quantile_cont({value}, 0.025)", "hi": f"quantile_cont({value}, 0.975)", "mean": f"avg({value})"}
    return ", ".join(f"CASE WHEN bool_or(isnan({value})) THEN 'nan'::DOUBLE ELSE {e} END AS {name}_{k}" for k, e in figures.items())


FIGURES = {"volume": "volume", "max_depth": "max_depth", "mean_depth": "mean_depth", "prob_ascent": "prob_ascent", "nosing_ratio": "nosing_ratio", "total_steps": "traffic"}
DOUBT_CTE = (*SAMPLE_CTE, RANKS, RHO, SHARES, "hs AS (SELECT mesh_id, string_agg(hypothesis || ' ' || printf('%.0f', 100.0*n/total) || '%', ', ' ORDER BY hypothesis) AS scales, count(*) FILTER (n > 0.1*total) AS likely FROM (SELECT mesh_id, hypothesis, count(*) AS n, sum(count(*)) OVER (PARTITION BY mesh_id) AS total FROM sp_ GROUP BY mesh_id, hypothesis) GROUP BY mesh_id)",
             "qf AS (SELECT pl.mesh_id, CASE WHEN plane_method = 'RANSAC' THEN inlier_fraction ELSE 1.0 END AS inl, CASE WHEN plane_method = 'RANSAC' THEN rms ELSE (SELECT sqrt(avg((c-z)*(c-z)))*1000.0 FROM sv WHERE sv.mesh_id = pl.mesh_id) END AS rms FROM pl)",
             "ds AS (SELECT mesh_id, " + ", ".join(
                 _spoiled(m, e) for m, e in FIGURES.items())
             + ", CASE WHEN bool_or(isnan(nosing_ratio)) THEN 'nan'::DOUBLE ELSE quantile_cont(1/(nosing_ratio+1e-10), 0.5) END AS flipped, stddev_pop(scale)/avg(scale) AS scale_cv FROM sp_ GROUP BY mesh_id)",
             f"""dt AS (SELECT ds.*, scales, scale_cv > 0.5 OR likely > 1 AS scale_ambiguous, inl < 0.6 OR qf.rms > 5.0 AS weak, (nosing_ratio_m < 0.85) <> (flipped < 0.85) AS axis, k_spec+scale+plane+grf+slip AS whole, k_spec, scale, plane, grf, slip,
  ['k_spec','scale','plane','grf','slip'][list_position([k_spec, scale, plane, grf, slip], list_max([k_spec, scale, plane, grf, slip]))] AS dominant,
  CASE WHEN prob_ascent_lo > 0.5 AND NOT isnan(prob_ascent_lo) THEN printf('ASCENT (%.0f%% [%.0f-%.0f%%])', prob_ascent_m*100, prob_ascent_lo*100, prob_ascent_hi*100)
  WHEN prob_ascent_hi < 0.5 THEN printf('DESCENT (%.0f%% [%.0f-%.0f%%])', (1-prob_ascent_m)*100, (1-prob_ascent_hi)*100, (1-prob_ascent_lo)*100)
  ELSE printf('AMBIGUOUS (P_ascent=%.0f%% [%.0f-%.0f%%])', prob_ascent_m*100, prob_ascent_lo*100, prob_ascent_hi*100) END AS label
  FROM ds JOIN hs USING (mesh_id) JOIN qf USING (mesh_id) JOIN pl_ USING (mesh_id))""".replace("pl_", "shr"))
DOUBT_CTE = tuple(c.replace("pl AS (SELECT mesh_id, k_spec", "shr AS (SELECT mesh_id, k_spec") for c in DOUBT_CTE)


def _interval(name: str, show: str, divisor: str = "1") -> str:
    return f"printf('{show} [{show} - {show}]', {name}_m/{divisor}, {name}_lo/{divisor}, {name}_hi/{divisor})"


def _panel(name: str, show: str, divisor: str = "1") -> str:
    return f"printf('     CI95: [{show}, {show}]', {name}_lo/{divisor}, {name}_hi/{divisor})"


def _flag(name: str) -> str:
    return f"CASE WHEN {name} THEN 'True' ELSE 'False' END"


STEPS_500Y = "(500*365.0)"
PANEL = [f"'Monte Carlo samples: {REPLICATES}'", f"'Seed: {K.MC_SEED}'", "chr(10) || 'GEOMETRY (Stable)'", "'  Volume: ' || printf('%.2e', volume_m) || ' m³'", _panel("volume", "%.2e"),
         "'  Max depth: ' || printf('%.2f', max_depth_m) || ' mm'", _panel("max_depth", "%.2f"), "chr(10) || 'TRAFFIC (Conditional, 500y)'", f"'  Daily: ' || printf('%.2e', total_steps_m/{STEPS_500Y}) || ' steps/day'",
         _panel("total_steps", "%.2e", STEPS_500Y), "chr(10) || 'FLAGS'", f"'  Scale ambiguous: ' || {_flag('scale_ambiguous')}", f"'  Weak plane fit: ' || {_flag('weak')}", f"'  Axis ambiguous: ' || {_flag('axis')}"]
LINES = ["'Mesh: ' || mesh_id", f"'Wear volume (m3): ' || {_interval('volume', '%.2e')}", f"'Max depth (mm): ' || {_interval('max_depth', '%.2f')}", f"'P(ascent): ' || {_interval('prob_ascent', '%.2f')}", "'Direction: ' || label",
         f"'Total steps: ' || {_interval('total_steps', '%.2e')}", *[f"'Daily over {y} years: ' || {_interval('total_steps', '%.2f', f'({y}*365.0)')}" for y in K.HORIZONS_YEARS],
         "'Shares of variance: ' || " + " || ', ' || ".join(f"'{s} ' || printf('%.1f', 100*{s}/whole) || '%'" for s in K.SENSITIVITY_SOURCES), "'Dominated by: ' || dominant", "'Scale: ' || scales"]
FIELDS = {"volume_cm3": ("$.geometry.volume_m3.median", "volume_m", 1e6), "max_depth_mm": ("$.geometry.max_depth_mm.ci_95[1]", "max_depth_hi", 1.0), "mean_depth_mm": ("$.geometry.mean_depth_mm.mean", "mean_depth_mean", 1.0),
          "prob_ascent": ("$.directionality.prob_ascent.median", "prob_ascent_m", 1.0), "million_steps": ("$.traffic_conditional.total_steps.median", "total_steps_m", 1e-6),
          "daily_500y": ("$.traffic_conditional.daily_500y.ci_95[0]", f"total_steps_lo/{STEPS_500Y}", 1.0), "share_k_spec": ("$.traffic_conditional.sensitivity.k_spec", "k_spec/whole", 1.0),
          "samples": ("$.metadata.n_samples", f"{REPLICATES}", 1.0)}
WORDS = {"classification": ("$.directionality.classification", "label"), "dominant_source": ("$.traffic_conditional.dominant_source", "dominant"),
         "scale_ambiguous": ("$.flags.scale_ambiguous", f"lower({_flag('scale_ambiguous')})"), "weak_plane_fit": ("$.flags.weak_plane_fit", f"lower({_flag('weak')})")}


@query("ruled_uncertainty", cte(*DOUBT_CTE) + f"SELECT mesh_id, {_lines_sql(PANEL)} AS panel, {_lines_sql(LINES)} AS lines, " + ", ".join(
    f"CASE WHEN isfinite({e}*{k!r}::DOUBLE) THEN round({e}*{k!r}::DOUBLE, 5) END AS {c}" for c, (_, e, k) in FIELDS.items()) + ", " + ", ".join(f"{e} AS {c}" for c, (_, e) in WORDS.items()) + " FROM dt")
def _(spark: SparkSession, sf: str) -> DataFrame:
    surface, draws = ruled_surface(spark, sf)
    results = materialize(PL.propagate(surface, REPLICATES, draws=draws), "doubt")
    found = charts.uncertainty_text(results).withColumnRenamed("text", "panel").join(report.uncertainty_lines(results).withColumnRenamed("text", "lines"), "mesh_id")
    document = report.uncertainty_document(results).withColumnRenamed("text", "json")
    field = lambda path: F.get_json_object("json", path)
    return found.join(document, "mesh_id").select(
        "mesh_id", "panel", "lines", *[(field(path).cast("double") * k).alias(c) for c, (path, _, k) in FIELDS.items()], *[field(path).alias(c) for c, (path, _) in WORDS.items()]).select(
        "mesh_id", "panel", "lines", *[r(finite(c), 5, c) for c in FIELDS], *WORDS)
