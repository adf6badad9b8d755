"""Operators on small hand-made inputs."""

import json
import math

import brute
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from footfall import cli
from footfall.functions import constants as K
from footfall.functions import text as X
from footfall.operators import grid as Gr, mixture, traffic as T, uncertainty as U
from footfall.operators.keyed import KeyTable, attach, settle, with_ordinals
from footfall.operators.quantiles import average_ranks, exact_quantiles, spearman_squared
from footfall.session import materialize
from footfall.sinks import charts, report
from footfall.sources import obj
from footfall.sources.materials import with_material, with_material_prior


# --- keyed tables, ranks, quantiles ----------------------------------------------

def skewed(spark, n=3000):
    rng = np.random.default_rng(0)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.3, 1.25, rng.lognormal(0, 3, n))
    pdf = pd.DataFrame({"mesh_id": key, "vid": np.arange(n) * 50, "v": value, "t": rng.integers(0, 20, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_attach_gives_the_same_rows_on_every_route(spark):
    _, df = skewed(spark)
    small = settle(df.groupBy("mesh_id").agg(F.max("v").alias("top"), F.count("*").alias("n")).where("mesh_id != 'c'"))
    cut = small.with_hot("n", limit=0, most=100)
    assert {r.mesh_id: r["_parts"] for r in cut.hot.df.collect()}["hot"] > 10
    for how in ("inner", "left", "left_anti"):
        want = sorted(map(tuple, attach(df, small, how=how).collect()), key=str)
        for table in (small, cut):
            got = attach(df, table, how=how, spread=["vid"], limit=0)
            assert sorted(map(tuple, got.collect()), key=str) == want
    plans = [attach(df, t, limit=0)._jdf.queryExecution().optimizedPlan().toString() for t in (small, cut)]
    assert "_part" not in plans[0] and "_part" in plans[1]


def test_ordinals(spark):
    pdf, df = skewed(spark)
    pdf["want"] = pdf.sort_values("vid").groupby("mesh_id").cumcount()
    df = df.withColumn("vid", F.col("vid") * 100)
    got = with_ordinals(df, "vid").toPandas().merge(pdf.assign(vid=pdf.vid * 100), on="vid")
    assert len(got) == len(pdf) and (got["ord"] == got["want"]).all()


@pytest.mark.parametrize("bound", [10**6, 500, 1])
def test_quantiles_match_numpy_on_every_route(spark, bound):
    pdf, df = skewed(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {r.mesh_id: r for r in exact_quantiles(df, "v", probs, bound=bound).collect()}
    for key, group in pdf.groupby("mesh_id"):
        assert got[key].n == len(group)
        np.testing.assert_array_equal(got[key].q, np.quantile(group.v, probs))


def test_ranks_and_spearman(spark):
    pdf, df = skewed(spark)
    got = {(r.mesh_id, r.v): r["rank"] for r in average_ranks(df, "v", ["mesh_id"]).collect()}
    rho = {(r.mesh_id, r.column): r.rho2 for r in spearman_squared(df.withColumn("one", F.lit(1.0)), ["v", "one"], "t", ["mesh_id"]).collect()}
    for key, group in pdf.groupby("mesh_id"):
        for value, rank in zip(group.v, brute.average_rank(group.v.to_numpy())):
            assert got[key, value] == rank
        assert rho[key, "v"] == pytest.approx(brute.rho2(group.v.to_numpy(), group.t.to_numpy()), abs=1e-10)
        assert rho[key, "one"] == 0


# --- text ------------------------------------------------------------------------

@pytest.mark.parametrize("value", [0.0055, 2.675, 161.83, 1.4e11, 7.25e-11, 0.0761, 76.1, 0.0, 999.5, 12345.678, 0.0001234, 99950.0, 1e-5])
def test_numbers_print_like_c(spark, value):
    c = F.lit(value)
    row = spark.range(1).select(
        X.fixed(c, 3).alias("f"), X.sci(c, 2).alias("e"), X.general(c, 3).alias("g"), X.percent(c, 1).alias("p"),
        X.fixed(c, 1, grouped=True).alias("k"), X.shortest(c).alias("r"),
    ).first()
    assert row.f == f"{value:.3f}" and row.e == f"{value:.2e}" and row.g == f"{value:.3g}"
    assert row.p == f"{value:.1%}" and row.k == f"{value:,.1f}" and row.r == repr(value)


def test_endless_numbers(spark):
    row = spark.range(1).select(X.fixed(F.lit(math.nan), 2).alias("a"), X.sci(F.lit(-math.inf), 2).alias("b")).first()
    assert (row.a, row.b) == ("nan", "-inf")


# --- OBJ -------------------------------------------------------------------------

OBJ = """# scan
o part
v 0 0 0
v 1 0 0 1.0
 v  1\t1 0

v 0 1 0
v 0.5 1.5 2e-1
vt 0 0
vn 0 0 1
g side
f 1/1/1 2/2/1 3/3/1
f 1 2 3 4
f 1//1 2//1 3//1 4//1 5//1
f 1 2
usemtl stone
"""


def test_obj_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text(OBJ)
    (tmp_path / "b.obj").write_text(OBJ)
    mesh = obj.read_obj(spark, f"{tmp_path}/*.obj", 0.5)
    v = mesh.vertices.orderBy("mesh_id", "vid").collect()
    assert len(v) == 10 and v[0].mesh_id.endswith("a.obj")
    assert [(r.x, r.y, r.z) for r in v[:5]] == [(0, 0, 0), (0.5, 0, 0), (0.5, 0.5, 0), (0, 0.5, 0), (0.25, 0.75, 0.1)]
    f = [tuple(r)[1:] for r in mesh.faces.where(F.col("mesh_id").endswith("a.obj")).orderBy("fid").collect()]
    assert f == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 0, 2, 3), (3, 0, 1, 2), (4, 0, 2, 3), (5, 0, 3, 4)]
    assert mesh.normals.count() == 2


def test_obj_split_files_keep_line_order(spark, tmp_path):
    n = 4000
    lines = [f"v {k} {k * 2} {k * 3}" for k in range(n)] + [f"f {k + 1} {k + 2} {k + 3}" for k in range(n - 2)]
    (tmp_path / "big.obj").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 9000)
    try:
        rows = obj.obj_lines(spark, str(tmp_path / "big.obj"))
        assert rows.select("chunk").distinct().count() > 5
        mesh = obj.parse_obj(rows)
        v = mesh.vertices.orderBy("vid").collect()
        f = mesh.faces.orderBy("fid").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.vid, r.x) for r in v] == [(k, float(k)) for k in range(n)]
    assert [(r.fid, r.v0, r.v2) for r in f] == [(k, k, k + 2) for k in range(n - 2)]


@pytest.mark.parametrize("bad", ["v 0 0 0\nv 1 0 0\nv 1 1 0\nf -1 -2 -3\n", "v 0 0 0\nv 1 0 0\nv 1 1 0\nf 1 2 9\n"])
def test_bad_vertex_numbers_fail(spark, tmp_path, bad):
    from footfall.operators.mesh import triangles
    (tmp_path / "x.obj").write_text(bad)
    with pytest.raises(PySparkException):
        triangles(obj.read_obj(spark, str(tmp_path / "x.obj"))).collect()


def test_empty_mesh_is_refused(spark, tmp_path):
    (tmp_path / "x.obj").write_text("# nothing\n")
    with pytest.raises(ValueError):
        obj.read_obj(spark, str(tmp_path / "x.obj"))


# --- traffic ---------------------------------------------------------------------

def steps(spark, **cols):
    row = {"volume": 1e-6, "max_depth": 50.0} | cols
    return T.traffic_volume(spark.createDataFrame([row])).first()


def test_equal_rates_in_either_unit_give_equal_steps(spark):
    a = steps(spark, k_spec_value=1e-6, k_spec_units="mm3_per_Nm")
    b = steps(spark, k_spec_value=1e-15, k_spec_units="m2_per_N")
    assert a.total_steps == pytest.approx(b.total_steps, rel=1e-9) and a.k_spec_si == pytest.approx(1e-15)
    assert a.total_steps == pytest.approx(1e-6 / (1e-15 * 700 * 1.7 * 0.002))
    assert a.daily_500y == pytest.approx(a.total_steps / 182500)


def test_wrong_units_warn(spark):
    row = steps(spark, volume=1e-3, k_spec_value=1e-6, k_spec_units="m2_per_N")
    assert any("Per-step wear volume 2.38e-06 m³" in w for w in row.warnings) and row.per_step_wear_volume > 1e-9


def test_unknown_units_fail(spark):
    with pytest.raises(PySparkException):
        steps(spark, k_spec_value=1.0, k_spec_units="furlong")


def test_older_material_column_wins(spark):
    row = steps(spark, k_spec_mm3_per_Nm=1e-6, k_spec_value=3.0, k_spec_units="m2_per_N")
    assert (row.k_spec_value, row.k_spec_units) == (1e-6, "mm3_per_Nm")


def test_no_wear_no_traffic(spark):
    row = steps(spark, volume=0.0, k_spec_value=1e-6, k_spec_units="mm3_per_Nm")
    assert row.total_steps == 0 and row.daily_50y == 0 and row.warnings == []


def test_materials(spark):
    rows = with_material(spark.createDataFrame([(m[0],) for m in K.MATERIALS], "material string")).collect()
    assert {r.material: r.k_spec_value for r in rows} == {m[0]: m[2] for m in K.MATERIALS}
    with pytest.raises(PySparkException):
        with_material(spark.createDataFrame([("cheese",)], "material string")).collect()
    oak = spark.createDataFrame([("Oak",)], "material string")
    assert with_material_prior(oak).first().prior_name == "wood"
    with pytest.raises(PySparkException):
        with_material_prior(oak, compat=True).collect()


def lanes(spark, w_lane=0.55, shy=0.2, **cols):
    row = {"mesh_id": "m", "n_modes": 1, "kurtosis": 3.5, "means": [0.5], "w_nom": 1.0, "drift": False} | cols
    schema = "mesh_id string, n_modes int, kurtosis double, means array<double>, w_nom double, drift boolean"
    return T.simultaneity(spark.createDataFrame([row], schema), w_lane, shy).first()


@pytest.mark.parametrize("cols, pattern, count, m_max", [
    (dict(w_nom=0.4), K.SINGLE, 1, 0),
    (dict(w_nom=1.0), K.SINGLE, 1, 1),
    (dict(w_nom=2.0, n_modes=0, means=None, kurtosis=None), K.NO_DATA, 0, 2),
    (dict(w_nom=2.0), K.SINGLE, 1, 2),
    (dict(w_nom=2.0, n_modes=2, means=[0.4, 1.4]), K.TWO_LANES, 2, 2),
    (dict(w_nom=2.0, n_modes=2, means=[0.9, 1.1]), K.SINGLE_FEET, 1, 2),
    (dict(w_nom=2.0, n_modes=2, means=[0.2, 1.9]), K.TWO_UNCERTAIN, 2, 2),
    (dict(w_nom=2.0, n_modes=2, means=[0.2]), K.UNKNOWN, 0, 2),
    (dict(w_nom=2.0, n_modes=3, means=[0.2, 0.9, 1.5]), K.SINGLE_COMPLEX, 1, 2),
    (dict(w_nom=2.6, n_modes=3, means=[0.2, 0.9, 1.5]), K.MULTI, 3, 4),
])
def test_lane_rules(spark, cols, pattern, count, m_max):
    row = lanes(spark, **cols)
    assert (row.pattern, row.n_lanes, row.m_max_two_abreast) == (pattern, count, m_max)
    assert row.single_file_possible


def test_narrow_surface_and_drift_wording(spark):
    row = lanes(spark, shy=0.1, w_nom=0.4, drift=True)
    assert row.w_eff == pytest.approx(0.2) and "single file" in row.rationale and "TEMPORAL DRIFT" in row.rationale
    assert "always possible" in row.description


@pytest.mark.parametrize("ratio, skew, label, confidence, back", [
    (1.5, 0.0, "DESCENT", 75.0, 1 / 1.5), (3.0, 0.0, "DESCENT", 95.0, 1 / 3), (0.5, 0.0, "ASCENT", 75.0, 1 / 0.6),
    (1.0, 1.0, "DESCENT (moderate)", 80.0, 1 / 1.1), (1.0, -3.0, "ASCENT (moderate)", 120.0, 1 / 1.1),
    (1.0, 0.5, "BIDIRECTIONAL (balanced)", 70.0, 1 / 1.1), (1.3, 0.0, "BIDIRECTIONAL (balanced)", 70.0, 1 / 1.3),
    (0.8, None, "BIDIRECTIONAL (balanced)", 70.0, 1 / 0.9),
])
def test_direction_rules(spark, ratio, skew, label, confidence, back):
    rows = spark.createDataFrame([(ratio, skew)], "nosing_wear_ratio double, skewness double")
    row = T.directionality(rows).first()
    assert (row.dominant_direction, row.confidence) == (label, pytest.approx(confidence))
    assert row.ascent_descent_ratio == pytest.approx(back)


@pytest.mark.parametrize("width, scale, unit, factor", [
    (800.0, 1.0, "mm", 0.001), (100.0, 1.0, "cm", 0.01), (1.2, 1.0, "m", 1.0), (20.0, 1.0, "unknown", None),
    (300.0, 1.0, "unknown", None), (800.0, 0.001, "scaled", 0.001),
])
def test_units(spark, width, scale, unit, factor):
    row = T.likely_units(spark.createDataFrame([(width, scale)], "width_raw double, scale double")).first()
    assert (row.likely_units, row.suggested_scale) == (unit, factor)


# --- grid, drift, mixture --------------------------------------------------------

def ridge():
    """Depth grid whose upper rows peak at 0.3 and lower rows at 0.7."""
    x = np.linspace(0, 1, 50)
    peak = np.where(np.arange(50) > 25, 0.7, 0.3)
    return x, 100 * np.exp(-(((x[None, :] - peak[:, None]) / 0.1) ** 2))


def test_temporal_drift(spark):
    x, depth = ridge()
    depth[26:] *= 1.5
    cells = spark.createDataFrame([
        ("m", i, j, 0.0, float(x[j]), float(depth[i, j])) for i in range(50) for j in range(50) if depth[i, j] > 0
    ], "mesh_id string, i int, j int, y double, x double, depth_mm double")
    positive, peaks = depth[depth > 0], []
    for q in (0.6, 0.75, 0.9):
        side = np.where(depth >= np.quantile(positive, q), depth, 0).sum(axis=0)
        peaks.append((x * side).sum() / side.sum())
    for width, shy in ((1.0, 0.1), (1.0, 0.4), (0.4, 0.2)):
        row = Gr.temporal_drift(cells, spark.createDataFrame([("m", width)], "mesh_id string, w_nom double"), shy).first()
        w_eff = width - 2 * shy
        shift = (max(peaks) - min(peaks)) / w_eff if w_eff > 0 else 0
        np.testing.assert_allclose([row.peak_0, row.peak_1, row.peak_2], peaks, rtol=1e-9)
        assert row.shift_ratio == pytest.approx(shift) and row.drift == (shift > 0.15)


def clouds(spark, sizes, seed=3):
    """Points of meshes of given sizes, with their extents as the queries settle them."""
    rng = np.random.default_rng(seed)
    rows = [(m, *map(float, rng.random(3))) for m, n in sizes.items() for _ in range(n)]
    points = spark.createDataFrame(rows, "mesh_id string, w double, d double, u double").repartition(5)
    ext = points.groupBy("mesh_id").agg(
        *[f(c).alias(f"{c}_{f.__name__}") for c in "wd" for f in (F.min, F.max)], F.max("u").alias("u_max"), F.count(F.lit(1)).alias("n_vertices"))
    return points, settle(ext, "extents", most_vertices=F.max("n_vertices"), vertices=F.sum("n_vertices"))


@pytest.mark.parametrize("sizes", [{"a": 30, "b": 5, "c": 1}, {"a": 30, "full": 400}, {"full": 400, "other": 300}])
def test_heights_are_the_same_on_every_route(spark, sizes):
    points, ext = clouds(spark, sizes)
    plain = KeyTable(ext.df, ext.rows)
    got, want = (sorted(map(tuple, Gr.surface_heights(points, e, 6).collect())) for e in (ext, plain))
    assert got == want and len(got) > 0


def test_points_of_sparse_meshes_are_shuffled_before_they_are_repeated(spark):
    points, ext = clouds(spark, {"a": 30, "b": 5})
    cells, _ = Gr.legacy_cells(points, ext, 6)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning")  # read from the top: no shuffle after it


def test_profiles_read_the_cells_once(spark):
    points, ext = clouds(spark, {"a": 30, "b": 5})
    cells = materialize(Gr.legacy_cells(points, ext, 6)[0], "cells")
    folder = cells.inputFiles()[0].rsplit("/", 1)[0]
    profile = Gr.lateral_profile(cells, ext, 6)
    assert not any(f.startswith(folder) for f in profile.inputFiles())  # what is left to do reads sums by column
    sums = cells.groupBy("mesh_id", "j").agg(F.sum(F.round(F.col("depth_mm") * 1e6)).alias("v")).toPandas()
    share = {(r.mesh_id, r.j): r.v / sums.v[sums.mesh_id == r.mesh_id].sum() for r in sums.itertuples()}
    rows = profile.collect()
    assert len(rows) == 12
    for r in rows:
        assert r.share == pytest.approx(share.get((r.mesh_id, r.j), 0.0), abs=1e-12)


def profile_rows(spark, shapes):
    x = np.linspace(0, 2, 100)
    rows = []
    for name, parts in shapes.items():
        y = sum(w * np.exp(-(((x - m) / s) ** 2) / 2) for m, s, w in parts)
        share = y / y.sum()
        rows += [(name, j, float(x[j]), float(share[j]), int(share[j] * 1000)) for j in range(100)]
    return spark.createDataFrame(rows, "mesh_id string, j int, x double, share double, weight long")


def test_mixture_finds_the_number_of_lanes(spark):
    shapes = {"one": [(1.0, 0.2, 1.0)], "two": [(0.5, 0.1, 1.0), (1.5, 0.12, 0.8)], "three": [(0.3, 0.05, 1), (1.0, 0.05, 1), (1.7, 0.05, 1)]}
    profile = profile_rows(spark, shapes)
    got = {r.mesh_id: r for r in mixture.lateral_mixture(profile).collect()}
    for name, parts in shapes.items():
        row = got[name]
        assert row.n_modes == len(parts)
        np.testing.assert_allclose(row.means, [p[0] for p in parts], atol=0.02)
        np.testing.assert_allclose(row.stds, [p[1] for p in parts], atol=0.02)
        assert sum(row.weights) == pytest.approx(1)
    one = profile.where("mesh_id = 'one'").toPandas()
    data = np.repeat(one.x.to_numpy(), one.weight)
    var = data.var() + mixture.VARIANCE_FLOOR
    loglik = (-0.5 * (np.log(2 * np.pi * var) + (data - data.mean()) ** 2 / var)).sum()
    assert got["one"].bic == pytest.approx(-2 * loglik + 2 * np.log(len(data)), rel=1e-6)


def test_thin_profile_has_no_mixture(spark):
    rows = spark.createDataFrame([("m", 0, 0.0, 0.0, 4), ("m", 1, 1.0, 0.0, 5)], "mesh_id string, j int, x double, share double, weight long")
    row = mixture.lateral_mixture(rows).first()
    assert row.n_modes == 0 and row.means is None


def test_weighted_moments_match_replication(spark):
    profile = profile_rows(spark, {"m": [(0.5, 0.1, 1.0), (1.4, 0.3, 0.8)]})
    pdf, row = profile.toPandas(), Gr.lateral_moments(profile).first()
    data = np.repeat(pdf.x.to_numpy(), pdf.weight)
    c = data - data.mean()
    assert row.skewness == pytest.approx((c**3).mean() / (c**2).mean() ** 1.5)
    assert row.kurtosis == pytest.approx((c**4).mean() / (c**2).mean() ** 2 - 3)


# --- uncertainty -----------------------------------------------------------------

def test_draw_sequence_reproduces_the_published_direction():
    draws = U._draw_one(0.001, [], 100, 1e-6, 0.7, 100, 42)
    p = 1 / (1 + np.exp(draws["slope"] * (0.9999443515989347 - draws["threshold"])))
    assert p == pytest.approx(0.5480037329901373, abs=1e-12)
    assert 0.0005 < np.mean(draws["scale"]) < 0.002 and set(draws["hypothesis"]) == {"user"}
    assert all(1.0 <= g <= 2.5 for g in draws["grf"]) and min(draws["k_spec"]) > 0 and min(draws["slip"]) > 0
    steps = 7.252236438461526e-11 / (np.array(draws["k_spec"]) * 1e-9 * 700 * draws["grf"] * np.array(draws["slip"]))
    assert np.median(steps) == pytest.approx(29647.29, rel=0.01)


def test_draws_are_repeatable_tables(spark):
    prior = U.scale_prior(spark.createDataFrame([("a", 800.0, None), ("b", 0.5, None), ("c", 5.0, 0.001)], "mesh_id string, width_raw double, user_scale double"))
    got = {r.mesh_id: r for r in prior.collect()}
    assert [h.prob for h in got["a"].hypotheses] == [0.7, 0.2, 0.1] and [h.prob for h in got["b"].hypotheses] == [0.1, 0.2, 0.7]
    config = prior.withColumns({"n_planes": F.lit(9), "k_spec_median": F.lit(1e-6), "log_std": F.lit(0.7)})
    a, b = (U.monte_carlo_draws(config, 30, 5).orderBy("mesh_id", "s").toPandas() for _ in range(2))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 90 and set(a[a.mesh_id == "c"].hypothesis) == {"user"} and a.b.between(0, 8).all()


def samples_frame(spark, n=100):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({
        "mesh_id": "m", "s": np.arange(n), "k_spec": rng.lognormal(-14, 0.5, n), "scale": rng.lognormal(-7, 0.1, n),
        "grf": rng.normal(1.7, 0.2, n), "slip": rng.lognormal(-6.2, 0.3, n), "volume": rng.uniform(1e-6, 1e-5, n),
        "max_depth": rng.random(n), "mean_depth": rng.random(n), "nosing_ratio": rng.uniform(0.5, 0.8, n),
        "hypothesis": rng.choice(["mm", "cm"], n),
    })
    pdf["traffic"] = 1e-10 / (pdf.k_spec * pdf.grf * pdf.slip)
    pdf["prob_ascent"] = 1 / (1 + np.exp(5 * (pdf.nosing_ratio - 1)))
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def summary(spark):
    pdf, df = samples_frame(spark)
    widths = spark.createDataFrame([("m", 800.0)], "mesh_id string, width double")
    quality = spark.createDataFrame([("m", True)], "mesh_id string, weak_fit boolean")
    out = U.summarize(df, widths, quality, len(pdf), 42).withColumns({"material": F.lit("granite"), "scale": F.lit(1.0)})
    return pdf, out, out.first()


def test_summaries(summary):
    pdf, _, row = summary
    for name, values in (("volume", pdf.volume), ("total_steps", pdf.traffic), ("daily_200y", pdf.traffic / 73000), ("prob_ascent", pdf.prob_ascent)):
        d = row[name]
        np.testing.assert_allclose([d.mean, d.median, d.std], [values.mean(), values.median(), values.std(ddof=0)], rtol=1e-9)
        np.testing.assert_allclose([*d.ci_50, *d.ci_95], np.percentile(values, [25, 75, 2.5, 97.5]), rtol=1e-9)
    medians = [row[f"daily_{y}y"].median for y in K.HORIZONS_YEARS]
    assert medians == sorted(medians, reverse=True)
    assert row.simple_classification == "ASCENT" and row.classification.startswith("ASCENT (")
    assert row.weak_plane_fit and row.scale_ambiguous and row.axis_ambiguous
    assert sum(row.scale_hypothesis_posterior.values()) == pytest.approx(1)


def test_sensitivity(summary):
    pdf, _, row = summary
    t = np.log1p(pdf.traffic)
    raw = {c: brute.rho2(pdf[c], t) for c in ("k_spec", "scale", "grf", "slip")}
    raw["plane"] = max(0.02, 0.3 * brute.rho2(pdf.volume, t))
    for c, v in raw.items():
        assert row.sensitivity[c] == pytest.approx(v / sum(raw.values()), rel=1e-9)
    assert sum(row.sensitivity.values()) == pytest.approx(1) and row.traffic_dominated_by == max(raw, key=raw.get)


def test_nan_sample_spoils_the_summary(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", 2.0)], "mesh_id string, v double")
    d = U.distributions(df, ["v"]).first().v
    assert math.isnan(d.median) and math.isnan(d.ci_95.hi)
    kind = spark.range(1).select(U.direction_class(F.lit(math.nan), F.lit(math.nan)).alias("k")).first().k
    assert kind == "AMBIGUOUS"


@pytest.mark.parametrize("lo, hi, kind", [(0.6, 0.9, "ASCENT"), (0.1, 0.4, "DESCENT"), (0.3, 0.7, "AMBIGUOUS")])
def test_direction_class(spark, lo, hi, kind):
    row = spark.range(1).select(U.direction_class(F.lit(lo), F.lit(hi)).alias("k"), U.direction_label(F.lit((lo + hi) / 2), F.lit(lo), F.lit(hi)).alias("t")).first()
    assert row.k == kind and row.t.startswith(kind)


def test_summary_of_one_to_ten(spark):
    d = U.distributions(spark.createDataFrame([("m", float(v)) for v in range(1, 11)], "mesh_id string, v double"), ["v"])
    row = d.select("v", U.format_with_ci("v").alias("a"), U.format_compact("v").alias("b")).first()
    assert row.v.mean == row.v.median == 5.5 and row.a == "5.50 [1.23 - 9.78]" and row.b == "5.50 [3.25-7.75]"


# --- sinks -----------------------------------------------------------------------

def test_json_document(summary, tmp_path):
    pdf, out, row = summary
    report.write_documents(report.uncertainty_document(out), f"{tmp_path}/doc", foldered=True)
    files = list((tmp_path / "doc" / "mesh_id=m").glob("*.txt"))
    doc = json.loads("".join(p.read_text() for p in files))
    assert doc["metadata"]["n_samples"] == 100 and doc["metadata"]["material"] == "granite"
    assert set(doc["geometry"]["volume_m3"]) == {"median", "mean", "ci_50", "ci_95"}
    assert doc["traffic_conditional"]["dominant_source"] == row.traffic_dominated_by
    assert doc["traffic_conditional"]["daily_50y"]["median"] == pytest.approx(row.daily_50y.median)
    assert set(doc["traffic_conditional"]["sensitivity"]) == set(K.SENSITIVITY_SOURCES)
    assert doc["directionality"]["simple_classification"] == "ASCENT" and doc["flags"]["weak_plane_fit"] is True


def test_uncertainty_charts(summary):
    _, out, row = summary
    bars = charts.tornado(out).orderBy("place").collect()
    assert [b.share for b in bars] == sorted((b.share for b in bars), reverse=True) and bars[0].is_dominant
    lines = charts.traffic_intervals(out).collect()
    assert [r.horizon for r in lines] == ["50y", "100y", "200y", "500y", "1000y"] and lines[0].log_scale
    panel = charts.direction_panel(out).first()
    assert panel.heading == "↑ ASCENT" and panel.bar_lo == pytest.approx(0.1 + 0.8 * row.prob_ascent.ci_95.lo)
    assert "Monte Carlo samples: 100" in charts.uncertainty_text(out).first().text


def test_command_line(spark, tmp_path, capsys):
    v, f = brute.height_field(14, 0.9, 1.4)
    lines = [f"v {x:.17g} {y:.17g} {z:.17g}" for x, y, z in v * 1000] + ["f " + " ".join(str(k + 1) for k in t) for t in f]
    (tmp_path / "step.obj").write_text("\n".join(lines))
    out = tmp_path / "out"
    code = cli.main([str(tmp_path / "step.obj"), "--measured-width-m", "0.9", "--material", "marble", "-o", str(out), "--uncertainty", "--n-samples", "20"])
    assert code == 0
    short = json.loads(next((out / "short_report").glob("*.json")).read_text())["text"]
    assert short.startswith("SURFACE WEAR REPORT\nMaterial: marble\nTraffic: ") and "Pattern: SINGLE FILE" in short
    doc = json.loads(json.loads(next((out / "uncertainty").glob("*.json")).read_text())["text"])
    lines = json.loads(next((out / "uncertainty_lines").glob("*.json")).read_text())["text"]
    assert "P(ascent): " in lines and "Daily over 50 years: " in lines
    assert doc["metadata"]["scale_hypothesis_posterior"] == {"user": 1.0} and doc["metadata"]["scale"] == pytest.approx(0.001)
    names = {p.name for p in (out / "charts").iterdir()}
    assert {"wear_heatmap", "lateral_distribution", "longitudinal_profile", "summary_dashboard", "traffic_assumptions", "uncertainty_tornado"} <= names
    curves = spark.read.parquet(f"{out}/charts/lateral_distribution")
    assert all(r.series == "Observed Wear" or r.series.startswith("GMM Component") for r in curves.select("series").distinct().collect())
    assert "Heuristic" in spark.read.parquet(f"{out}/charts/longitudinal_profile_info").first().title
    assert cli.main([str(tmp_path / "step.obj"), "--use-legacy-wear-volume", "--scale", "0.001"]) == 0
    assert "legacy_grid" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "missing.obj")]) == 1
