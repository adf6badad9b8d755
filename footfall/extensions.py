"""Analyses the model describes beyond its own computation, as named queries with their SQL.

Scans are the surfaces of ``embeddings``, parts and suppliers stand for steps and flights of ``lineitem``.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from footfall.catalog import (
    FIXED_TRI, GRID, LEG, SF, SL, SN, ST, SV, TREAD_CTE, VOLUME, cte, level_plane, plain_frame, points_of, query, r, shipment_cells, surfaces, tread_of,
)
from footfall.functions import constants as K
from footfall.operators import clusters, erosion, flight, mesh as M, posterior, provenance, sobol
from footfall.operators.keyed import attach, settle
from footfall.operators.uncertainty import scale_prior
from footfall.operators.volume import corner_depths
from footfall.sources.tables import table

TAU = f"'{2.0 * math.pi!r}'::DOUBLE"


# --- Sobol indices of traffic ----------------------------------------------------

RUNS = 512
SOURCES = K.SENSITIVITY_SOURCES


def traffic_priors() -> dict[str, sobol.Prior]:
    """The model's priors, relative to their medians; a key's ``log_std`` and ``plane_sd`` are columns."""
    z = sobol.normal
    return {
        "k_spec": lambda u, v: F.exp(F.col("log_std") * z(u, v)),
        "scale": lambda u, v: F.exp(F.lit(K.SCALE_CV) * z(u, v)),
        "plane": lambda u, v: F.col("plane_sd") * z(u, v),
        "grf": lambda u, v: F.least(F.greatest(F.lit(K.GRF_DESCENT) + F.lit(K.GRF_STD) * z(u, v), F.lit(K.GRF_LOW)), F.lit(K.GRF_HIGH)),
        "slip": lambda u, v: F.exp(F.lit(K.MICROSLIP_LOG_STD) * z(u, v)),
    }


def relative_traffic(x: dict[str, F.Column]) -> F.Column:
    """Steps over steps at the medians: volume (cube of scale, shifted with the plane) over wear rate, load and slip."""
    s = x["scale"]
    return s * s * s * F.greatest(F.lit(0.0), 1.0 + F.col("ratio") * x["plane"]) / (x["k_spec"] * x["grf"] * x["slip"])


WORN = """worn AS (SELECT mesh_id, sum((p0+p1+p2)/3.0*area) AS volume, sum(area) AS area, stddev_pop((p0+p1+p2)/3.0)/sqrt(count(*)) AS plane_sd FROM dep GROUP BY mesh_id),
ratio AS (SELECT mesh_id, area/volume AS ratio, plane_sd, [""" + ", ".join(f"{s!r}::DOUBLE" for _, _, s in K.MATERIAL_PRIORS) + """][CAST(substr(mesh_id, 2) AS INTEGER) % 5 + 1] AS log_std FROM worn WHERE volume > 0)"""


def _sobol_sql() -> str:
    z = lambda side, x: f"sqrt(-2.0*ln(u_{side}_{x}))*cos({TAU}*v_{side}_{x})"
    prior = {
        "k_spec": "exp(log_std*({z}))", "scale": f"exp({K.SCALE_CV!r}::DOUBLE*({{z}}))", "plane": "plane_sd*({z})",
        "grf": f"least(greatest({K.GRF_DESCENT!r}::DOUBLE+{K.GRF_STD!r}::DOUBLE*({{z}}), {K.GRF_LOW!r}::DOUBLE), {K.GRF_HIGH!r}::DOUBLE)",
        "slip": f"exp({K.MICROSLIP_LOG_STD!r}::DOUBLE*({{z}}))"}
    names = sobol.names(SOURCES)
    at = [f"(run+1)*'{a!r}'::DOUBLE+0.5" for a in sobol.steps(len(names))]
    design = "des AS (SELECT run, run % 16 AS block, " + ", ".join(f"({x})-floor({x}) AS {c}" for x, c in zip(at, names)) + f" FROM range(0, {RUNS}) t(run))"
    value = "val AS (SELECT mesh_id, block, ratio, " + ", ".join(
        prior[x].format(z=z(side, x)) + f" AS {side}_{x}" for side in "ab" for x in SOURCES) + " FROM ratio, des)"
    y = lambda s: f"{s['scale']}*{s['scale']}*{s['scale']}*greatest(0.0, 1.0+ratio*{s['plane']})/({s['k_spec']}*{s['grf']}*{s['slip']})"
    a, b = ({x: f"{side}_{x}" for x in SOURCES} for side in "ab")
    runs = "ys AS (SELECT mesh_id, block, " + ", ".join(
        [f"{y(a)} AS ya", f"{y(b)} AS yb", *[f"{y(a | {x: b[x]})} AS yab_{x}" for x in SOURCES], *[f"{y(b | {x: a[x]})} AS yba_{x}" for x in SOURCES]]) + " FROM val)"
    pairs = list(itertools.combinations(SOURCES, 2))
    sums = {"n": "CAST(count(*) AS DOUBLE)", "s1": "sum(ya+yb)", "s2": "sum(ya*ya+yb*yb)"}
    sums |= {f"f_{x}": f"sum(yb*(yab_{x}-ya))" for x in SOURCES} | {f"t_{x}": f"sum((ya-yab_{x})*(ya-yab_{x}))" for x in SOURCES}
    sums |= {f"p_{p}_{q}": f"sum(yba_{p}*yab_{q}-ya*yb)" for p, q in pairs}
    part = "part AS (SELECT mesh_id, block, " + ", ".join(f"{e} AS {k}" for k, e in sums.items()) + " FROM ys GROUP BY mesh_id, block)"
    every = "every AS (SELECT mesh_id, -1 AS block, " + ", ".join(f"sum({k}) AS {k}" for k in sums) + " FROM part GROUP BY mesh_id UNION ALL SELECT mesh_id, block, " + ", ".join(
        f"sum({k}) OVER (PARTITION BY mesh_id)-{k}" for k in sums) + " FROM part),\nvars AS (SELECT *, s2/(2*n)-(s1/(2*n))*(s1/(2*n)) AS v FROM every)"
    effects = [("first", x, f"f_{x}/n/v") for x in SOURCES] + [("total", x, f"t_{x}/(2*n)/v") for x in SOURCES] + [
        ("pair", f"{p}*{q}", f"p_{p}_{q}/n/v-f_{p}/n/v-f_{q}/n/v") for p, q in pairs]
    theta = "theta AS (" + " UNION ALL ".join(f"SELECT mesh_id, block, '{e}' AS effect, '{s}' AS source, {x} AS theta FROM vars" for e, s, x in effects) + ")"
    return cte(*TREAD_CTE, FIXED_TRI, VOLUME, WORN, design, value, runs, part, every, theta) + """SELECT mesh_id, effect, source, round(max(theta) FILTER (block < 0), 6) AS value,
round(sqrt((count(*) FILTER (block >= 0)-1)*var_pop(theta) FILTER (block >= 0)), 6) AS error FROM theta GROUP BY mesh_id, effect, source"""


@query("sobol_indices", _sobol_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, frame, tread = tread_of(spark, sf)
    depths = corner_depths(attach(tread.where("is_tread"), level_plane(frame), spread=["fid"]))
    worn = depths.groupBy("mesh_id").agg(
        F.sum(F.col("mean_dep") * F.col("area")).alias("volume"), F.sum("area").alias("area"),
        (F.stddev_pop("mean_dep") / F.sqrt(F.count(F.lit(1)))).alias("plane_sd")).where("volume > 0")
    stds = F.array(*[F.lit(s) for _, _, s in K.MATERIAL_PRIORS])
    worn = settle(worn.select("mesh_id", (F.col("area") / F.col("volume")).alias("ratio"), "plane_sd",
                              stds[F.substring("mesh_id", 2, 9).cast("int") % 5].alias("log_std")), "worn")
    runs = worn.df.crossJoin(F.broadcast(sobol.design(spark, SOURCES, RUNS)))  # a sample design of fixed size for every mesh
    found = sobol.sobol_indices(sobol.pick_freeze(runs, traffic_priors(), relative_traffic), SOURCES)
    return found.select("mesh_id", "effect", "source", r("value", 6), r("error", 6))


# --- plane posterior -------------------------------------------------------------

WEIGHT = f"'{posterior.SLOPE_WEIGHT!r}'::DOUBLE"
SUMS = """mo AS (SELECT mesh_id, count(*) AS n, avg(z) AS mu, count(*)*var_pop(x) AS sww, count(*)*var_pop(y) AS sdd, count(*)*var_pop(z) AS suu,
  count(*)*covar_pop(x,y) AS swd, count(*)*covar_pop(x,z) AS swu, count(*)*covar_pop(y,z) AS sdu FROM sv GROUP BY mesh_id)"""
SLOPES = f"""sl1 AS (SELECT *, sww+{WEIGHT} AS aa, sdd+{WEIGHT} AS dd, (sww+{WEIGHT})*(sdd+{WEIGHT})-swd*swd AS det FROM mo),
sl2 AS (SELECT *, (swu*dd-sdu*swd)/det AS a0, (sdu*aa-swu*swd)/det AS b0 FROM sl1),
sl3 AS (SELECT *, greatest(0.0, suu-a0*swu-b0*sdu) AS sse FROM sl2)"""


@query("plane_posterior", cte(SV, SUMS, SLOPES) + """SELECT mesh_id, n, round(a0, 9) AS slope_w, round(b0, 9) AS slope_d, round(mu, 9) AS height,
round(sqrt(sse/(n-3)), 9) AS sigma, round(sqrt(sse/(n-3)*dd/det), 9) AS slope_w_sd, round(sqrt(sse/(n-3)*aa/det), 9) AS slope_d_sd,
round(sqrt(sse/(n-3)/n), 9) AS height_sd, round(-swd/sqrt(aa*dd), 9) AS slopes_correlation FROM sl3""")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    found = posterior.plane_posterior(posterior.plane_moments(points_of(mesh, plain_frame(mesh))))
    return found.select("mesh_id", "n", *[r(c) for c in (
        "slope_w", "slope_d", "height", "sigma", "slope_w_sd", "slope_d_sd", "height_sd", "slopes_correlation")])


def _chains_sql() -> str:
    density = lambda a, b, c, s: (
        f"-(n+2)*({s})-(suu-2*({a})*swu-2*({b})*sdu+({a})*({a})*aa+2*({a})*({b})*swd+({b})*({b})*dd+n*({c})*({c}))/(2*exp(2*({s})))")
    u = ", ".join(f"(CAST('0x' || substr(md5(k || ':' || t || ':{j}'), 1, 8) AS BIGINT)+0.5)/4294967296.0 AS u{j+1}" for j in range(5))
    jump = f"{posterior.JUMP!r}::DOUBLE"
    far = "2.0*(k-1.5)"
    ends = {"slope_w": "a", "slope_d": "b", "height": "c", "log_sigma": "s"}
    return "WITH RECURSIVE " + ",\n".join([SV, SUMS, SLOPES, f"""geo AS (SELECT *, sqrt(greatest(sse, 1e-18)/(n-1)) AS s0, sqrt(aa) AS l11, swd/sqrt(aa) AS l21, sqrt(det/aa) AS l22 FROM sl3 WHERE n > 2),
du AS (SELECT k, t, {u} FROM range(0, {posterior.CHAINS}) a(k), range(1, {posterior.STEPS + 1}) b(t)),
dz AS (SELECT k, t, {jump}*sqrt(-2*ln(u1))*cos({TAU}*u2) AS z1, {jump}*sqrt(-2*ln(u1))*sin({TAU}*u2) AS z2, {jump}*sqrt(-2*ln(u3))*cos({TAU}*u4) AS z3, {jump}*sqrt(-2*ln(u3))*sin({TAU}*u4) AS z4, ln(u5) AS lu FROM du),
st0 AS (SELECT geo.*, k, a0+{far}*s0/l11 AS a, b0+{far}*s0/l22 AS b, {far}*s0/sqrt(n) AS c, ln(s0)+{far}/sqrt(2*(n-1)) AS s FROM geo, range(0, {posterior.CHAINS}) q(k)),
ch AS (SELECT mesh_id, k, 0 AS t, a, b, c, s, {density('a', 'b', 'c', 's')} AS lp, 0 AS took FROM st0
UNION ALL SELECT mesh_id, k, t+1, CASE WHEN lu < nlp-lp THEN na ELSE a END, CASE WHEN lu < nlp-lp THEN nb ELSE b END, CASE WHEN lu < nlp-lp THEN nc ELSE c END, CASE WHEN lu < nlp-lp THEN ns ELSE s END,
  CASE WHEN lu < nlp-lp THEN nlp ELSE lp END, CASE WHEN lu < nlp-lp THEN 1 ELSE 0 END
  FROM (SELECT *, {density('na', 'nb', 'nc', 'ns')} AS nlp FROM (SELECT ch.mesh_id, ch.k, ch.t, ch.a, ch.b, ch.c, ch.s, ch.lp, n, suu, swu, sdu, swd, aa, dd, lu,
    ch.a+s0*z1/l11-(s0*z2/l22)*l21/l11 AS na, ch.b+s0*z2/l22 AS nb, ch.c+s0*z3/sqrt(n) AS nc, ch.s+z4/sqrt(2*(n-1)) AS ns
    FROM ch JOIN geo ON geo.mesh_id = ch.mesh_id JOIN dz ON dz.k = ch.k AND dz.t = ch.t+1)))""",
        "lng AS (" + " UNION ALL ".join(f"SELECT mesh_id, k, t, '{name}' AS name, {c} AS x, took FROM ch WHERE t > {posterior.WARM}" for name, c in ends.items()) + ")",
        f"rn AS (SELECT mesh_id, name, k, (t-{posterior.WARM}-1)//{posterior.RUN} AS run, sum(x) AS s1, sum(x*x) AS s2, count(*) AS n, sum(took) AS took FROM lng GROUP BY ALL)",
        "own AS (SELECT mesh_id, name, k, sum(n) AS n, avg(n) AS run, sum(s1)/sum(n) AS mean, (sum(s2)/sum(n)-(sum(s1)/sum(n))*(sum(s1)/sum(n)))*sum(n)/(sum(n)-1) AS within, var_samp(s1/n) AS of_runs, sum(took) AS took FROM rn GROUP BY ALL)",
        "fin AS (SELECT mesh_id, name, avg(mean) AS mean, avg(within) AS w, var_samp(mean) AS between_, sum(n) AS n, avg(n) AS each, avg(run*of_runs) AS long_run, sum(took)/sum(n) AS accepted FROM own GROUP BY ALL)",
    ]) + """\nSELECT mesh_id, name, round(mean, 6) AS mean, round(sqrt((each-1)/each*w+between_), 6) AS sd, round(sqrt(((each-1)/each*w+between_)/w), 6) AS rhat,
round(n*w/long_run, 3) AS effective, round(accepted, 6) AS accepted FROM fin"""


@query("plane_chains", _chains_sql())
def _(spark, sf):
    mesh = surfaces(spark, sf)
    moments = settle(posterior.plane_moments(points_of(mesh, plain_frame(mesh))), "plane-moments").df
    found = posterior.chain_summary(posterior.plane_chains(moments))
    return found.select("mesh_id", "name", r("mean", 6), r("sd", 6), r("rhat", 6), r("effective", 3), r("accepted", 6))


# --- orientation -----------------------------------------------------------------

def _assigned_sql(up: str) -> str:
    p, q = [a for a in "xyz" if a != up]
    return f"""SELECT m.mesh_id, p_{up} AS p, least(size_{p}, size_{q}) AS width, greatest(size_{p}, size_{q}) AS depth, sqrt(greatest(0.0, c_{up}{up}-a*cp-b*cq)) AS residual, degrees(atan(sqrt(a*a+b*b))) AS tilt
  FROM (SELECT *, (cp*c_{q}{q}-cq*c_{p}{q})/(c_{p}{p}*c_{q}{q}-c_{p}{q}*c_{p}{q}) AS a, (cq*c_{p}{p}-cp*c_{p}{q})/(c_{p}{p}*c_{q}{q}-c_{p}{q}*c_{p}{q}) AS b
    FROM (SELECT *, c_{''.join(sorted(p + up))} AS cp, c_{''.join(sorted(q + up))} AS cq FROM cov)) m JOIN pw ON pw.mesh_id = m.mesh_id"""


MARGINAL = f"""cov AS (SELECT mesh_id, count(*) AS n, max(x)-min(x) AS size_x, max(y)-min(y) AS size_y, max(z)-min(z) AS size_z,
  {', '.join(f'covar_pop({i},{j}) AS c_{i}{j}' for i, j in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))} FROM sv GROUP BY mesh_id),
lw AS (SELECT mesh_id, count(*) AS n_faces, {', '.join(f'{posterior.CONTRAST!r}::DOUBLE*least(count(*), {posterior.FACES})*avg(abs(n{c}/(len+1e-10))) AS l{c}' for c in 'xyz')} FROM sl GROUP BY mesh_id),
ew AS (SELECT mesh_id, n_faces, {', '.join(f'exp(l{c}-greatest(lx, ly, lz)) AS e{c}' for c in 'xyz')} FROM lw),
pw AS (SELECT mesh_id, n_faces, {', '.join(f'e{c}/(ex+ey+ez) AS p_{c}' for c in 'xyz')} FROM ew),
asg AS ({' UNION ALL '.join(_assigned_sql(a) for a in 'xyz')}),
mg AS (SELECT mesh_id, {', '.join(f'sum(p*{c}) AS {c}' for c in ('width', 'depth', 'residual', 'tilt'))}, -sum(CASE WHEN p > 0 THEN p*ln(p) ELSE 0 END) AS entropy FROM asg GROUP BY mesh_id),
sg AS (SELECT a.mesh_id, {', '.join(f'sqrt(sum(p*(a.{c}-mg.{c})*(a.{c}-mg.{c}))) AS {c}_sd' for c in ('width', 'depth', 'residual', 'tilt'))} FROM asg a JOIN mg ON mg.mesh_id = a.mesh_id GROUP BY a.mesh_id)"""
MARGINAL_COLUMNS = [f"{c}{s}" for c in ("width", "depth", "residual", "tilt") for s in ("", "_sd")]


@query("orientation_marginal", cte(SV, SF, ST, SN, SL, MARGINAL) + f"""SELECT pw.mesh_id, n, n_faces, {', '.join(f'round(p_{c}, 9) AS p_{c}' for c in 'xyz')},
CASE WHEN p_x >= p_y AND p_x >= p_z THEN 'X' WHEN p_y >= p_z THEN 'Y' ELSE 'Z' END AS up, round(entropy, 9) AS entropy, 1-greatest(p_x, p_y, p_z) > {posterior.AMBIGUOUS} AS ambiguous,
{', '.join(f'round({c}, 6) AS {c}' for c in MARGINAL_COLUMNS)} FROM pw JOIN cov USING (mesh_id) JOIN mg USING (mesh_id) JOIN sg USING (mesh_id)""")
def _(spark, sf):
    mesh = surfaces(spark, sf)
    found = posterior.orientation_marginal(mesh.vertices, M.triangles(mesh))
    return found.select("mesh_id", "n", "n_faces", r("p_x"), r("p_y"), r("p_z"), "up", r("entropy"), "ambiguous", *[r(c, 6) for c in MARGINAL_COLUMNS])


# --- scale -----------------------------------------------------------------------

def part_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Each part as a scan without a unit: raw width from its prices, raw depth from its quantities."""
    size = lambda c, k: ((F.max(c) - F.min(c)) / k)
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        size("l_extendedprice", 64.0).alias("width_raw"), size("l_quantity", 2.0).alias("depth_raw"))
    return rows.withColumn("user_scale", F.lit(None).cast("double"))


def _hypotheses_sql() -> str:
    case = lambda rows: " UNION ALL ".join(f"SELECT {s!r}::DOUBLE AS scale, {p!r}::DOUBLE AS prob, '{u}' AS unit" for s, p, u in rows)
    return f"""hyp AS (SELECT 2 AS kind, * FROM ({case(K.SCALE_WIDE)}) UNION ALL SELECT 1, * FROM ({case(K.SCALE_MIDDLE)}) UNION ALL SELECT 0, * FROM ({case(K.SCALE_NARROW)}))"""


def _fit_sql(extent: str, median: float, sd: float) -> str:
    away = f"(ln({extent}*scale)-'{math.log(median)!r}'::DOUBLE)/{sd!r}::DOUBLE"
    return f"CASE WHEN {extent} > 0 THEN -0.5*({away})*({away}) ELSE 0.0 END"


@query("scale_posterior", cte("""ext AS (SELECT l_partkey AS part, (max(l_extendedprice)-min(l_extendedprice))/64.0 AS width_raw, (max(l_quantity)-min(l_quantity))/2.0 AS depth_raw FROM lineitem GROUP BY l_partkey)""",
    _hypotheses_sql(), f"""lg AS (SELECT part, unit, scale, ln(prob)+{_fit_sql('width_raw', *posterior.TREAD_WIDTH)}+{_fit_sql('depth_raw', *posterior.TREAD_DEPTH)} AS l
  FROM ext JOIN hyp ON kind = CASE WHEN width_raw > {K.SCALE_WIDE_ABOVE} THEN 2 WHEN width_raw > {K.SCALE_MIDDLE_ABOVE} THEN 1 ELSE 0 END)""",
    "ps AS (SELECT *, exp(l-max(l) OVER w)/sum(exp(l-m)) OVER w AS p FROM (SELECT *, max(l) OVER (PARTITION BY part) AS m FROM lg) WINDOW w AS (PARTITION BY part))",
    "mn AS (SELECT part, sum(p*log10(scale)) AS mean FROM ps GROUP BY part)") + f"""SELECT part, arg_max(unit, p) AS unit, arg_max(scale, p) AS scale, round(max(mean), 9) AS log10_mean,
round(sqrt(sum(p*(log10(scale)-mean)*(log10(scale)-mean))), 6) AS log10_sd, round(-sum(CASE WHEN p > 0 THEN p*ln(p) ELSE 0 END), 9) AS entropy, 1-max(p) > {posterior.AMBIGUOUS} AS ambiguous,
round(max(p) FILTER (unit = 'mm'), 9) AS p_mm, round(max(p) FILTER (unit = 'cm'), 9) AS p_cm, round(max(p) FILTER (unit = 'm'), 9) AS p_m FROM ps JOIN mn USING (part) GROUP BY part""")
def _(spark, sf):
    found = posterior.scale_posterior(scale_prior(part_extents(spark, sf)))
    share = lambda unit: F.element_at(F.filter("posterior", lambda h: h["label"] == unit), 1)["prob"]
    return found.select(
        "part", "unit", "scale", r("log10_mean"), r("log10_sd", 6), r("entropy"), "ambiguous", *[r(share(u), 9, f"p_{u}") for u in ("mm", "cm", "m")])


# --- steps compared --------------------------------------------------------------

@query("wear_consistency", cte(
    "rw AS (SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS y, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem)",
    "mn AS (SELECT l_orderkey, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM rw GROUP BY l_orderkey)",
    "ce AS (SELECT l_orderkey, x-mx AS x, y-my AS y FROM rw JOIN mn USING (l_orderkey))",
    "su AS (SELECT l_orderkey, sum(x*x) AS x2, sum(x*x*x) AS x3, sum(x*x*x*x) AS x4, sum(x*y) AS xy, sum(x*x*y) AS xxy, sum(y*y) AS yy FROM ce GROUP BY l_orderkey)",
    "p1 AS (SELECT *, x2/n AS m0, CASE WHEN x2 > 0 THEN x3/x2 ELSE 0 END AS m1 FROM su JOIN mn USING (l_orderkey))",
    "p2 AS (SELECT *, x4-m1*x3-m0*x2 AS q2 FROM p1)",
    f"p3 AS (SELECT *, CASE WHEN x2 > 0 THEN xy/x2 ELSE 0 END AS b1, CASE WHEN q2 > {flight.FLAT}*x4 THEN (xxy-m1*xy)/q2 ELSE 0 END AS b2, CASE WHEN q2 > {flight.FLAT}*x4 THEN 3 WHEN x2 > 0 THEN 2 ELSE 1 END AS rank FROM p2)",
    "p4 AS (SELECT *, greatest(0.0, yy-b1*b1*x2-b2*b2*q2) AS sse FROM p3)",
    f"p5 AS (SELECT *, CASE WHEN n > rank AND sse > {flight.FLAT}*yy THEN sqrt(sse/(n-rank)) END AS sigma FROM p4)",
    "ev AS (SELECT l_orderkey, l_linenumber, rw.y, rw.x-mx AS d1, (rw.x-mx)*(rw.x-mx)-m1*(rw.x-mx)-m0 AS d2, my, b1, b2, n, x2, q2, rank, sigma FROM rw JOIN p5 USING (l_orderkey))",
    "lv AS (SELECT *, my+b1*d1+b2*d2 AS expected, 1.0/n+CASE WHEN rank > 1 THEN d1*d1/x2 ELSE 0 END+CASE WHEN rank > 2 THEN d2*d2/q2 ELSE 0 END AS h FROM ev)",
    "st AS (SELECT *, CASE WHEN h < 1-1e-9 THEN (y-expected)/(sigma*sqrt(1-h)) END AS s FROM lv)") + """SELECT l_orderkey, l_linenumber, round(y, 9) AS depth, round(expected, 9) AS expected, round(s, 6) AS studentised,
CASE WHEN s < -2 THEN 'LOWER' WHEN s > 2 THEN 'HIGHER' WHEN s IS NULL THEN 'UNKNOWN' ELSE 'CONSISTENT' END AS wear FROM st""")
def _(spark, sf):
    steps = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("depth"))
    found = flight.consistency(steps, ["l_orderkey"], "l_linenumber")
    return found.select("l_orderkey", "l_linenumber", r("depth"), r("expected"), r("studentised", 6), "wear")


MOMENT_SQL = """wt AS (SELECT l_partkey, count(*) AS n, sum(l_quantity*(l_extendedprice/1000.0))/sum(l_quantity) AS mean FROM lineitem GROUP BY l_partkey),
ct AS (SELECT l.l_partkey, sum(l_quantity) AS w, sum(l_quantity*power(l_extendedprice/1000.0-mean, 2))/sum(l_quantity) AS m2, sum(l_quantity*power(l_extendedprice/1000.0-mean, 3))/sum(l_quantity) AS m3,
  sum(l_quantity*power(l_extendedprice/1000.0-mean, 4))/sum(l_quantity) AS m4 FROM lineitem l JOIN wt ON wt.l_partkey = l.l_partkey GROUP BY l.l_partkey),
mt AS (SELECT l_partkey AS part, n, mean, sqrt(m2) AS spread, CASE WHEN m2 > 0 THEN m3/(m2*sqrt(m2)) END AS skewness, CASE WHEN m2 > 0 THEN m4/(m2*m2) END AS kurtosis FROM wt JOIN ct USING (l_partkey))"""
CLUSTERS, ROUNDS = 4, 8


def part_moments(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / 1000.0).alias("place"), "l_quantity")
    return clusters.profile_moments(rows, ["part"], "place", "l_quantity")


@query("step_moments", cte(MOMENT_SQL) + "SELECT part, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in clusters.MOMENTS) + " FROM mt")
def _(spark, sf):
    return part_moments(spark, sf).select("part", "n", *[r(c, 6) for c in clusters.MOMENTS])


def _clusters_sql() -> str:
    z = [f"z{i}" for i in range(4)]
    cols = ", ".join(z)
    dist = lambda a, b: "+".join(f"({a}.{c}-{b}.{c})*({a}.{c}-{b}.{c})" for c in z)
    parts = [MOMENT_SQL, "ok AS (SELECT * FROM mt WHERE skewness IS NOT NULL)", "fg AS (SELECT " + ", ".join(
        f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(clusters.MOMENTS)) + " FROM ok)",
        "z AS MATERIALIZED (SELECT part, " + ", ".join(f"CASE WHEN s{i} > 0 THEN ({c}-m{i})/s{i} ELSE 0 END AS z{i}" for i, c in enumerate(clusters.MOMENTS)) + " FROM ok, fg)",
        f"b1 AS MATERIALIZED (SELECT 0 AS k, {cols} FROM z ORDER BY {'+'.join(f'{c}*{c}' for c in z)}, part LIMIT 1)"]
    for j in range(1, CLUSTERS):
        parts.append(f"b{j + 1} AS MATERIALIZED (SELECT * FROM b{j} UNION ALL (SELECT {j}, {cols} FROM (SELECT z.part, {', '.join(f'any_value(z.{c}) AS {c}' for c in z)}, min({dist('z', 'b')}) AS d FROM z, b{j} b GROUP BY z.part) ORDER BY d DESC, part LIMIT 1))")
    parts.append(f"c0 AS (SELECT * FROM b{CLUSTERS})")
    near = "n{0} AS MATERIALIZED (SELECT part, {1}, k, d FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY d, k) AS rn FROM (SELECT z.*, c.k, {2} AS d FROM z, c{0} c)) WHERE rn = 1)"
    for j in range(ROUNDS):
        parts.append(near.format(j, cols, dist("z", "c")))
        parts.append(f"""c{j + 1} AS MATERIALIZED (SELECT k, {', '.join(f'avg({c}) AS {c}' for c in z)} FROM n{j} GROUP BY k UNION ALL SELECT e.k, {', '.join(f'f.{c}' for c in z)}
  FROM (SELECT k, row_number() OVER (ORDER BY k) AS i FROM range(0, {CLUSTERS}) q(k) WHERE k NOT IN (SELECT k FROM n{j})) e JOIN (SELECT *, row_number() OVER (ORDER BY d DESC, part) AS i FROM n{j}) f ON f.i = e.i)""")
    parts.append(near.format(ROUNDS, cols, dist("z", "c")))
    parts.append(f"sz AS (SELECT k, count(*)/(SELECT count(*) FROM n{ROUNDS}) AS share, row_number() OVER (ORDER BY count(*) DESC, k) = 1 AS main FROM n{ROUNDS} GROUP BY k)")
    return cte(*parts) + f"""SELECT mt.part, CAST(n{ROUNDS}.k AS INTEGER) AS cluster, round(sqrt(d), 6) AS distance, round(share, 9) AS share,
CASE WHEN share IS NULL THEN 'UNKNOWN' WHEN main THEN 'MAIN' WHEN share < 0.1 THEN 'REPLACED' ELSE 'VARIANT' END AS verdict FROM mt LEFT JOIN n{ROUNDS} USING (part) LEFT JOIN sz ON sz.k = n{ROUNDS}.k"""


@query("step_clusters", _clusters_sql())
def _(spark, sf):
    found = clusters.outsiders(part_moments(spark, sf), "part", clusters.MOMENTS, CLUSTERS, ROUNDS)
    return found.select("part", "cluster", r("distance", 6), r("share"), "verdict")


ORDER = ("l_shipdate", "l_orderkey", "l_linenumber")
LIMIT, GAIN, HALVINGS = 3.0, 8.0, 3


def flights(spark: SparkSession, sf: str, value: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey", *ORDER, value)


@query("replaced_steps", cte(
    f"nb AS (SELECT l_suppkey, {', '.join(ORDER)}, l_extendedprice, lag(l_extendedprice) OVER w AS before, lead(l_extendedprice) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}, l_extendedprice))",
    "gp AS (SELECT *, l_extendedprice-least(before, after) AS gap FROM nb)",
    "md AS (SELECT l_suppkey, quantile_cont(gap, 0.5) AS m FROM gp GROUP BY l_suppkey)",
    "sp AS (SELECT gp.l_suppkey, any_value(m) AS m, quantile_cont(abs(gap-m), 0.5) AS mad FROM gp JOIN md ON md.l_suppkey = gp.l_suppkey GROUP BY gp.l_suppkey)",
    f"ct AS (SELECT gp.*, CASE WHEN mad > 0 THEN (gap-m)/({flight.NORMAL_MAD}*mad) END AS contrast FROM gp JOIN sp ON sp.l_suppkey = gp.l_suppkey)") + f"""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, before, after, round(contrast, 6) AS contrast, coalesce(contrast < -{LIMIT}, false) AS replaced FROM ct""")
def _(spark, sf):
    found = flight.replaced_steps(flights(spark, sf, "l_extendedprice"), "l_suppkey", ORDER, "l_extendedprice", LIMIT)
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "before", "after", r("contrast", 6), "replaced")


def _shifts_sql() -> str:
    parts = [f"o AS MATERIALIZED (SELECT l_suppkey, row_number() OVER w AS upto, sum(l_quantity) OVER w AS total FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {', '.join(ORDER)}, l_quantity ROWS UNBOUNDED PRECEDING))",
             "v AS (SELECT l_suppkey, count(*) AS n, var_pop(l_quantity) AS v, sum(l_quantity) AS s FROM lineitem GROUP BY l_suppkey)",
             "g0 AS MATERIALIZED (SELECT l_suppkey, 0::BIGINT AS lo, n AS hi, 0.0::DOUBLE AS s_lo, s AS s_hi, true AS open FROM v)"]
    for j in range(HALVINGS):
        parts.append(f"""d{j} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_suppkey, lo ORDER BY drop DESC, upto) AS rn FROM (SELECT g.l_suppkey, lo, upto, total,
  ((total-s_lo)/(upto-lo)-(s_hi-total)/(hi-upto))*((total-s_lo)/(upto-lo)-(s_hi-total)/(hi-upto))*(upto-lo)*(hi-upto)/(hi-lo) AS drop
  FROM g{j} g JOIN o ON o.l_suppkey = g.l_suppkey WHERE open AND upto > lo AND upto < hi))""")
        parts.append(f"""t{j} AS MATERIALIZED (SELECT g.*, d.upto AS cut, d.total AS s_cut, coalesce(open AND drop >= {GAIN}*v AND drop > 0, false) AS taken
  FROM g{j} g JOIN v ON v.l_suppkey = g.l_suppkey LEFT JOIN d{j} d ON d.l_suppkey = g.l_suppkey AND d.lo = g.lo AND d.rn = 1)""")
        parts.append(f"""g{j + 1} AS MATERIALIZED (SELECT l_suppkey, lo, hi, s_lo, s_hi, false AS open FROM t{j} WHERE NOT taken UNION ALL SELECT l_suppkey, lo, cut, s_lo, s_cut, true FROM t{j} WHERE taken
  UNION ALL SELECT l_suppkey, cut, hi, s_cut, s_hi, true FROM t{j} WHERE taken)""")
    return cte(*parts) + f"SELECT l_suppkey, lo AS first, hi-1 AS last, hi-lo AS n, round((s_hi-s_lo)/(hi-lo), 9) AS mean FROM g{HALVINGS}"


@query("flight_shifts", _shifts_sql())
def _(spark, sf):
    found = flight.shifts(flights(spark, sf, "l_quantity"), "l_suppkey", ORDER, "l_quantity", GAIN, HALVINGS)
    return found.select("l_suppkey", "first", "last", "n", r("mean"))


# --- provenance ------------------------------------------------------------------

CHI2 = f"'{provenance.CHI_SQUARE_95[1]!r}'::DOUBLE"
CHI1 = f"'{provenance.CHI_SQUARE_95[0]!r}'::DOUBLE"
READINGS = """rd AS (SELECT l_partkey AS part, l_orderkey, l_linenumber, ln(l_extendedprice) AS a, l_discount+l_tax/3.0 AS b, l_discount < 0.06 AS original FROM lineitem),
el AS (SELECT part, count(*) AS n, avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS caa, covar_samp(b, a) AS cba, covar_samp(b, b) AS cbb FROM rd WHERE original GROUP BY part HAVING count(*) > 1),
d1 AS (SELECT *, CASE WHEN caa > 0 THEN caa END AS da, CASE WHEN caa > 0 THEN cba/caa ELSE 0 END AS l FROM el),
d2 AS (SELECT *, CASE WHEN cbb > 0 AND cbb-l*l*coalesce(da, 0) > 1e-9*cbb THEN cbb-l*l*coalesce(da, 0) END AS db FROM d1)"""
FAR = """CASE WHEN da IS NOT NULL THEN (a-ma)*(a-ma)/da WHEN abs(a-ma) > 1e-9*abs(ma) THEN 'inf'::DOUBLE ELSE 0.0 END
+CASE WHEN db IS NOT NULL THEN ((b-mb)-l*(a-ma))*((b-mb)-l*(a-ma))/db WHEN abs((b-mb)-l*(a-ma)) > sqrt(1e-9*cbb)+1e-9*abs(mb) THEN 'inf'::DOUBLE ELSE 0.0 END"""
FEATURES = ("a", "b")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("a"),
        (F.col("l_discount") + F.col("l_tax") / 3.0).alias("b"), (F.col("l_discount") < 0.06).alias("original"))


@query("provenance_readings", cte(READINGS, f"fr AS (SELECT rd.*, CASE WHEN n > 2 THEN {FAR} END AS d, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN {CHI2} ELSE {CHI1} END AS lim FROM rd LEFT JOIN d2 ON d2.part = rd.part)") + """
SELECT part, l_orderkey, l_linenumber, original, round(d, 6) AS distance2, d > lim AS outside FROM fr""")
def _(spark, sf):
    rows = readings(spark, sf)
    found = provenance.judge_readings(rows, provenance.ellipse(rows.where("original"), ["part"], FEATURES), ["part"], FEATURES)
    return found.select("part", "l_orderkey", "l_linenumber", "original", r("distance2", 6), "outside")


@query("provenance", cte(READINGS, f"fr AS (SELECT rd.*, CASE WHEN n > 2 THEN {FAR} END AS d, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN {CHI2} ELSE {CHI1} END AS lim FROM rd LEFT JOIN d2 ON d2.part = rd.part WHERE NOT original)",
    "su AS (SELECT part, count(*) AS n_suspects, count(*) FILTER (d > lim) AS n_outside, avg(a) AS a, avg(b) AS b FROM fr GROUP BY part)",
    f"ce AS (SELECT su.part, n, n_suspects, n_outside, CASE WHEN n > 2 THEN {FAR} END AS d, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN {CHI2} ELSE {CHI1} END AS lim FROM su LEFT JOIN d2 ON d2.part = su.part)") + """
SELECT part, coalesce(n, 0) AS n_reference, n_suspects, n_outside, round(d, 6) AS distance2,
CASE WHEN d > lim THEN 'OTHER SOURCE' WHEN d IS NULL THEN 'UNKNOWN' ELSE 'SAME SOURCE POSSIBLE' END AS verdict FROM ce""")
def _(spark, sf):
    rows = readings(spark, sf)
    found = provenance.provenance(rows.where("original"), rows.where("NOT original"), ["part"], FEATURES)
    return found.withColumn("distance2", r("distance2", 6))


# --- erosion ---------------------------------------------------------------------

EROSION_COLUMNS = ("baseline_mm", "mechanical_share", "centre", "spread", "weathering_mm", "traffic_mm", "explained")


@query("coupled_erosion", cte(*LEG, f"ln_ AS (SELECT mesh_id, j, min(x) AS x, sum(depth_mm)/{GRID} AS d FROM cell GROUP BY mesh_id, j)",
    f"bs AS (SELECT mesh_id, avg(d) FILTER (j < {GRID // 10} OR j >= {GRID - GRID // 10}) AS base FROM ln_ GROUP BY mesh_id)",
    "wn AS (SELECT c.mesh_id, sum(greatest(0.0, depth_mm-base)) AS above, sum(depth_mm) AS whole FROM cell c JOIN bs ON bs.mesh_id = c.mesh_id GROUP BY c.mesh_id)",
    "ab AS (SELECT l.*, greatest(0.0, d-base) AS above FROM ln_ l JOIN bs ON bs.mesh_id = l.mesh_id)",
    "ct AS (SELECT mesh_id, sum(above*x)/nullif(sum(above), 0) AS centre FROM ab GROUP BY mesh_id)",
    "sp AS (SELECT ab.mesh_id, any_value(centre) AS centre, sqrt(sum(above*(x-centre)*(x-centre))/nullif(sum(above), 0)) AS spread FROM ab JOIN ct ON ct.mesh_id = ab.mesh_id GROUP BY ab.mesh_id)",
    "gs AS (SELECT ab.*, centre, spread, coalesce(CASE WHEN spread > 0 THEN exp(-(x-centre)*(x-centre)/(2*spread*spread)) END, 0) AS g FROM ab JOIN sp ON sp.mesh_id = ab.mesh_id)",
    "su AS (SELECT mesh_id, any_value(centre) AS centre, any_value(spread) AS spread, count(*) AS n, avg(g) AS mg, avg(d) AS my, sum(g*g) AS gg, sum(g*d) AS gy, sum(d*d) AS yy FROM gs GROUP BY mesh_id)",
    "s1 AS (SELECT *, (gy-n*mg*my)/nullif(gg-n*mg*mg, 0) AS slope FROM su)",
    "s2 AS (SELECT *, coalesce(CASE WHEN slope <= 0 THEN 0 WHEN my-slope*mg < 0 THEN gy/nullif(gg, 0) ELSE slope END, 0) AS e1 FROM s1)",
    "s3 AS (SELECT *, greatest(0.0, my-e1*mg) AS e0 FROM s2)",
    "s4 AS (SELECT *, yy-2*e0*n*my-2*e1*gy+e0*e0*n+2*e0*e1*n*mg+e1*e1*gg AS rest, yy-n*my*my AS var FROM s3)") + """SELECT s4.mesh_id, round(base, 6) AS baseline_mm, round(coalesce(above/nullif(whole, 0), 0), 6) AS mechanical_share, round(centre, 6) AS centre, round(spread, 6) AS spread,
round(e0, 6) AS weathering_mm, round(e1, 6) AS traffic_mm, round(CASE WHEN var > 1e-12*yy THEN 1-rest/var END, 6) AS explained FROM s4 JOIN bs ON bs.mesh_id = s4.mesh_id JOIN wn ON wn.mesh_id = s4.mesh_id""")
def _(spark, sf):
    cells, ext = shipment_cells(spark, sf)
    return erosion.coupled_erosion(cells, ext).select("mesh_id", *[r(c, 6) for c in EROSION_COLUMNS])


@query("log_profile", cte(*LEG, "lj AS (SELECT mesh_id, j, min(x) AS x, count(*) AS n, avg(ln(depth_mm)) AS y, var_pop(ln(depth_mm))*count(*) AS w FROM cell WHERE depth_mm > 0 GROUP BY mesh_id, j)",
    "mn AS (SELECT mesh_id, count(*) AS m, sum(n) AS cells, sum(n*x)/sum(n) AS mx, sum(n*y)/sum(n) AS my, sum(w) AS within FROM lj GROUP BY mesh_id)",
    "ce AS (SELECT lj.mesh_id, n, x-mx AS x, y-my AS y FROM lj JOIN mn ON mn.mesh_id = lj.mesh_id)",
    "su AS (SELECT mesh_id, sum(n*x*x) AS x2, sum(n*x*x*x) AS x3, sum(n*x*x*x*x) AS x4, sum(n*x*y) AS xy, sum(n*x*x*y) AS xxy, sum(n*y*y) AS yy FROM ce GROUP BY mesh_id)",
    "p1 AS (SELECT *, x2/cells AS m0, CASE WHEN x2 > 0 THEN x3/x2 ELSE 0 END AS m1 FROM su JOIN mn USING (mesh_id))",
    "p2 AS (SELECT *, x4-m1*x3-m0*x2 AS q2 FROM p1)",
    f"p3 AS (SELECT *, CASE WHEN x2 > 0 THEN xy/x2 ELSE 0 END AS b1, CASE WHEN q2 > {flight.FLAT}*x4 THEN (xxy-m1*xy)/q2 ELSE 0 END AS b2, CASE WHEN q2 > {flight.FLAT}*x4 THEN 3 WHEN x2 > 0 THEN 2 ELSE 1 END AS rank FROM p2)",
    "p4 AS (SELECT *, CASE WHEN m > rank THEN greatest(0.0, yy-b1*b1*x2-b2*b2*q2)/(m-rank) END AS lack, CASE WHEN cells > m THEN within/(cells-m) END AS pure, rank = 3 AND b2 < 0 AS down FROM p3)",
    "p5 AS (SELECT *, cbrt(CASE WHEN pure > 0 THEN lack/pure END) AS f, 2.0/(9.0*(m-rank)) AS u, 2.0/(9.0*(cells-m)) AS v FROM p4)",
    "p6 AS (SELECT *, ((1-v)*f-(1-u))/sqrt(v*f*f+u) AS score FROM p5)") + f"""SELECT mesh_id, m AS n_columns, CAST(cells AS BIGINT) AS n_cells, round(CASE WHEN down THEN mx-(b1-b2*m1)/(2*b2) END, 6) AS centre,
round(CASE WHEN down THEN sqrt(-0.5/b2) END, 6) AS spread, round(lack, 6) AS lack, round(pure, 6) AS pure, round(score, 6) AS score,
CASE WHEN score IS NULL THEN 'UNKNOWN' WHEN NOT down THEN 'NO TRACK' WHEN score > {erosion.ONE_SIDED_95!r} THEN 'NOT GAUSSIAN' ELSE 'SINGLE TRACK' END AS verdict FROM p6""")
def _(spark, sf):
    cells, _ = shipment_cells(spark, sf)
    return erosion.log_profile(cells).select(
        "mesh_id", "n_columns", "n_cells", r("centre", 6), r("spread", 6), r("lack", 6), r("pure", 6), r("score", 6), "verdict")
