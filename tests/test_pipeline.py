import brute
import numpy as np
import pytest
from meshes import to_mesh

from footfall.functions import constants as K
from footfall.operators import clamped, grid as Gr, mesh as M, plane as P, uncertainty as U
from footfall.plans import pipeline as PL
from footfall.sinks import charts, report

G = 24
NAMES = ("one", "two", "flat", "tilted", "tiny")


def surfaces():
    rng = np.random.default_rng(7)
    one = brute.height_field(30)
    two = brute.height_field(34, 1.8, 2.2, ((0.5, 0.15, 0.015), (1.3, 0.15, 0.012)), 2e-4, 2)
    flat = brute.height_field(12, troughs=(), noise=0.0)
    turned = brute.height_field(28, troughs=((0.4, 0.2, 0.01),), seed=5)
    tilted = (turned[0][:, [2, 0, 1]] + 0.02 * turned[0][:, [0]] * np.array([1.0, 0, 0]), turned[1])
    tiny = (rng.normal(0, 1, (8, 3)), np.array([[0, 1, 2], [3, 4, 5], [5, 6, 7], [0, 0, 1]]))
    return dict(zip(NAMES, (one, two, flat, tilted, tiny)))


@pytest.fixture(scope="module")
def world(spark):
    named = surfaces()
    surface = PL.load(to_mesh(spark, named), PL.Config(grid=G))
    wear = PL.analyze_wear(surface)
    results = {r.mesh_id: r for r in PL.estimate_traffic(wear, surface.config).collect()}
    turned = {}
    for name, (v, f) in named.items():
        turned[name] = (v[:, list(brute.axes_of(v, f))], f)
    return surface, wear, results, turned, named


@pytest.mark.parametrize("name", NAMES)
def test_frame_matches_inference(world, name):
    surface, _, _, _, named = world
    row = {r.mesh_id: r for r in surface.frame.df.collect()}[name]
    assert (row.width_axis, row.depth_axis, row.up_axis) == brute.axes_of(*named[name])
    assert row.n_vertices == len(named[name][0]) and row.n_faces == len(named[name][1])


@pytest.mark.parametrize("name", NAMES)
def test_plane_and_volume(world, name):
    _, _, results, turned, _ = world
    pts, f = turned[name]
    want, got = brute.robust_plane(pts), results[name]
    assert got.plane_method == want["method"]
    assert got.candidates_used == want["used"]
    assert got.inlier_fraction == pytest.approx(want["fraction"])
    np.testing.assert_allclose([got.a, got.b, got.c], want["plane"], rtol=1e-8, atol=1e-11)
    assert got.rms_error_mm == pytest.approx(want["rms"], abs=1e-8)
    mask = brute.tread(pts, f)
    assert got.tread_count == mask.sum()
    assert got.excluded_fraction == pytest.approx(1 - mask.mean())
    np.testing.assert_allclose(
        [got.volume, got.max_depth, got.mean_depth], brute.volume(pts, f[mask], want["plane"]), rtol=1e-6, atol=1e-12
    )


@pytest.mark.parametrize("name", NAMES)
def test_grid_and_profiles(world, name):
    surface, wear, results, turned, _ = world
    pts, _ = turned[name]
    a, b, c = brute.robust_plane(pts)["plane"]
    want, xs, ys = brute.depth_grid(pts, lambda x, y: a * x + b * y + c, G)
    got = np.zeros((G, G))
    for r in Gr.dense_grid(wear.cells, surface.frame, G).where(f"mesh_id = '{name}'").collect():
        got[r.i, r.j] = r.depth_mm
        assert (r.x, r.y) == pytest.approx((xs[r.j], ys[r.i]))
    np.testing.assert_allclose(got, want, atol=1e-7)
    rows = want.sum(axis=1)
    front, mid, back = rows[:G // 4].mean(), rows[G // 4:3 * G // 4].mean(), rows[3 * G // 4:].mean()
    np.testing.assert_allclose(
        [results[name].nosing_wear, results[name].center_wear, results[name].back_wear], [front, mid, back], atol=1e-6
    )
    assert results[name].nosing_wear_ratio == pytest.approx(front / mid if mid > 1e-9 else 0, abs=1e-6)


def test_modes(world):
    results = world[2]
    assert results["one"].n_modes >= 1
    assert results["two"].n_modes >= 2
    assert sum(results["two"].weights) == pytest.approx(1)


def test_unworn_surface_reads_as_ascent(world):
    flat = world[2]["flat"]
    assert flat.volume == pytest.approx(0, abs=1e-12)
    assert (flat.nosing_wear_ratio, flat.dominant_direction, flat.n_modes) == (0, "ASCENT", 0)
    assert flat.confidence == pytest.approx(95) and flat.ascent_descent_ratio == pytest.approx(10)


def test_legacy_volume(world):
    surface, _, _, turned, _ = world
    cells, ref = Gr.legacy_cells(surface.points, surface.frame, G)
    got = {r.mesh_id: r for r in Gr.legacy_volume(cells, surface.frame, G).collect()}
    refs = {r.mesh_id: r.reference_height for r in ref.df.collect()}
    for name, (pts, _) in turned.items():
        lo, hi = pts[:, 0].min(), pts[:, 0].max()
        edge = pts[(pts[:, 0] < lo + 0.1 * (hi - lo)) | (pts[:, 0] > hi - 0.1 * (hi - lo)), 2]
        h = np.percentile(edge, 95)
        assert refs[name] == pytest.approx(h)
        want, xs, ys = brute.depth_grid(pts, lambda x, y: h, G)
        cell = (xs[-1] - xs[0]) / (G - 1) * (ys[-1] - ys[0]) / (G - 1)
        assert got[name].volume == pytest.approx(want.sum() / 1000 * cell, rel=1e-9, abs=1e-15)
        assert got[name].max_depth == pytest.approx(want.max(), abs=1e-9)


def reference_bootstrap(inliers, reps, seed):
    rng = np.random.default_rng([seed, 0, 0])  # the stream of the first block
    return np.array([brute.ols(inliers[rng.choice(len(inliers), len(inliers), replace=True)]) for _ in range(reps)])


def test_bootstrap_repeats_seeded_draws(world):
    surface, _, _, turned, _ = world
    fit = surface.fit(K.RANSAC_ITERS, K.RANSAC_THRESH_MM)
    support, rows = P.bootstrap_support(surface.points, surface.frame, fit)
    samples, quality = P.bootstrap_planes(support, rows, 20, 42)
    got = samples.orderBy("mesh_id", "b").toPandas()
    weak = {r.mesh_id: r for r in quality.collect()}
    for name in ("one", "two", "tilted"):
        want = brute.robust_plane(turned[name][0])
        mine = got[got.mesh_id == name][["pa", "pb", "pc"]].to_numpy()
        np.testing.assert_allclose(mine, reference_bootstrap(want["inliers"], 20, 42), rtol=1e-6, atol=1e-10)
        assert weak[name].inlier_fraction == pytest.approx(want["fraction"])
    tiny = got[got.mesh_id == "tiny"]
    assert len(tiny) == 20 and weak["tiny"].rms_error_mm == 0
    plane = brute.robust_plane(turned["tiny"][0])["plane"]
    noise = np.random.default_rng(42).normal(0, 0.1 * np.abs(plane) + 1e-6, (20, 3))
    np.testing.assert_allclose(tiny[["pa", "pb", "pc"]].to_numpy(), plane + noise, rtol=1e-9)


def test_bootstrap_over_many_blocks_keeps_sample_size(world):
    surface = world[0]
    fit = surface.fit(K.RANSAC_ITERS, K.RANSAC_THRESH_MM)
    support, rows = P.bootstrap_support(surface.points, surface.frame, fit)
    samples, _ = P.bootstrap_planes(support, rows, 60, 42, size=16)
    whole, _ = P.bootstrap_planes(support, rows, 60, 42)
    a, b = (s.where("mesh_id = 'two'").toPandas()[["pa", "pb", "pc"]] for s in (samples, whole))
    assert len(a) == 60
    np.testing.assert_allclose(a.mean(), b.mean(), atol=4 * b.std().max())
    np.testing.assert_allclose(a.std(), b.std(), rtol=0.6)


def test_block_shares_sum_to_draws():
    for n, size in ((1000, 64), (130, 64), (65, 64), (10, 64)):
        blocks = -(-n // size)
        total = sum(P._block_draws(n, k, size, 50, 3) for k in range(blocks))
        assert (total == n).all()


def test_monte_carlo_matches_loop(world):
    surface, _, _, turned, _ = world
    n = 40
    samples = PL.propagate(surface, n, 42, samples_only=True).toPandas()
    for name in ("one", "two", "tilted"):
        pts, f = turned[name]
        planes = reference_bootstrap(brute.robust_plane(pts)["inliers"], n, 42)
        mine = samples[samples.mesh_id == name].sort_values("s")
        width = np.ptp(pts[:, 0])
        prior = K.SCALE_MIDDLE if width > 1 else K.SCALE_NARROW
        draws = U._draw_one(None, prior, n, 1e-6, 0.7, n, 42)
        assert list(mine.hypothesis) == draws["hypothesis"]
        mask = brute.tread(pts, f)
        for k, (_, row) in enumerate(mine.iterrows()):
            plane = planes[draws["b"][k]]
            vol, top, mean = brute.volume(pts, f[mask], plane)
            np.testing.assert_allclose([row.volume, row.max_depth, row.mean_depth], [vol, top, mean], rtol=1e-6)
            with np.errstate(all="ignore"):
                ratio = brute.nosing(pts, plane, draws["scale"][k])
            np.testing.assert_allclose(row.nosing_ratio, ratio, rtol=1e-6)
            steps = vol / (draws["k_spec"][k] * 1e-9 * 700 * draws["grf"][k] * draws["slip"][k])
            assert row.traffic == pytest.approx(steps, rel=1e-6)


def test_clamped_sums_do_not_depend_on_blocks(world):
    surface = world[0]
    tread = surface.segmented(25.0, (0.01, 0.99)).where("is_tread")
    rng = np.random.default_rng(3)
    planes = [(n, k, *rng.normal(0, 0.02, 2).tolist(), 0.16 + float(rng.normal(0, 0.01)), 1.0) for n in ("one", "two", "flat") for k in range(12)]
    params = surface.mesh.vertices.sparkSession.createDataFrame(planes, "mesh_id string, pid long, a double, b double, c double, s double")
    small = clamped.volume_by_plane(tread, params, surface.frame, 32).orderBy("mesh_id", "pid").toPandas()
    pts, f = world[3]["one"]
    mask = brute.tread(pts, f)
    for row in small[small.mesh_id == "one"].itertuples():
        _, _, a, b, c, _ = planes[row.pid]
        np.testing.assert_allclose(row[3:], brute.volume(pts, f[mask], (a, b, c)), rtol=1e-9)
    near = clamped.nosing_by_plane(surface.points, params, surface.frame, 32)
    for r in near.where("mesh_id = 'one'").collect():
        _, _, a, b, c, _ = planes[r.pid]
        with np.errstate(all="ignore"):
            np.testing.assert_allclose(np.float64(r.front) / r.centre, brute.nosing(pts, (a, b, c), 1.0), rtol=1e-9)


def test_blocks_do_not_change_the_fit(world):
    surface = world[0]
    fit = P.fit_planes(surface.points, surface.frame, 60, 2.0, block=16)
    base = P.fit_planes(surface.points, surface.frame, 60, 2.0)
    cols = ["mesh_id", "a", "b", "c", "inlier_count", "method"]
    a, b = (x.plane.df.select(cols).orderBy("mesh_id").collect() for x in (fit, base))
    assert a == b


def test_weak_fits_are_refitted_with_defaults(world):
    surface, _, _, turned, _ = world
    strict = P.fit_planes(surface.points, surface.frame, 50, 1e-7)
    support, rows = P.bootstrap_support(surface.points, surface.frame, strict, 50, 1e-7)
    got = {r.mesh_id: r for r in rows.df.collect()}
    sizes = {r.mesh_id: r["count"] for r in support.groupBy("mesh_id").count().collect()}
    want = brute.robust_plane(turned["one"][0])
    np.testing.assert_allclose([got["one"].a, got["one"].b, got["one"].c], want["plane"], rtol=1e-8)
    assert sizes["one"] == len(want["inliers"]) and got["one"].pool == want["used"]
    assert sizes["tiny"] == got["tiny"].pool == 8


def test_report_wording(world):
    surface, wear, results, _, _ = world
    rows = PL.estimate_traffic(wear, surface.config)
    full = {r.mesh_id: r.text.split("\n") for r in report.report(rows).collect()}
    one = results["one"]
    for line in (
        "SURFACE WEAR REPORT", "Material: Granite", f"  Inlier fraction: {one.inlier_fraction:.1%}",
        f"Total estimated footsteps: {one.total_steps:.2e}", f"  If  50 years old:  {one.daily_50y:.3f} footsteps/day",
        f"  If 1000 years old: {one.daily_1000y:.3f} footsteps/day", f"Confidence: {one.confidence:.1f}%",
        "  TRAFFIC VOLUME WARNINGS:", f"Effective width: {one.w_eff:.2f} m",
    ):
        assert line in full["one"]
    assert "  TRAFFIC VOLUME WARNINGS:" not in full["flat"]
    info = {r.mesh_id: r.text for r in charts.heatmap_info(rows).collect()}["one"]
    assert f"Volume: {one.volume:.3g} m³" in info and f"Volume: {one.volume * 1000:.1f} L" in info
    page = {r.mesh_id: r for r in charts.traffic_assumptions(rows).collect()}
    assert page["flat"].is_limited and page["flat"].warnings_text == ""
    assert page["one"].banner == "⚠ CALIBRATION LIMITED ⚠" and "• Extremely high" in page["one"].warnings_text
