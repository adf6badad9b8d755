"""Extensions of the model against plain restatements and known answers."""

import itertools
import json
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import clusters, flight, posterior, sobol
from footfall.operators.uncertainty import scale_prior


def close(a, b, tol=1e-9):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=tol, abs_tol=tol))


# --- Sobol -----------------------------------------------------------------------

SIGMAS = {"p": 0.3, "q": 0.5, "r": 0.1}


def log_normals(inputs):
    return {x: (lambda u, v, s=s: F.exp(F.lit(s) * F.col("wide") * sobol.normal(u, v))) for x, s in inputs.items()}


def product(x):
    return x["p"] * x["q"] / x["r"]


def brute_indices(runs, wide):
    names = sobol.names(SIGMAS)
    u = {c: np.mod((np.arange(runs) + 1) * a + 0.5, 1.0) for c, a in zip(names, sobol.steps(len(names)))}
    x = {s: {k: np.exp(SIGMAS[k] * wide * np.sqrt(-2 * np.log(u[f"u_{s}_{k}"])) * np.cos(2 * np.pi * u[f"v_{s}_{k}"])) for k in SIGMAS} for s in "ab"}
    f = lambda v: v["p"] * v["q"] / v["r"]
    mixed = lambda base, other, k: f(x[base] | {k: x[other][k]})
    block = np.arange(runs) % sobol.BLOCKS

    def indices(at):
        ya, yb = f(x["a"])[at], f(x["b"])[at]
        both = np.concatenate([ya, yb])
        var = (both**2).mean() - both.mean() ** 2
        first = {k: (yb * (mixed("a", "b", k)[at] - ya)).mean() / var for k in SIGMAS}
        out = {("first", k): v for k, v in first.items()}
        out |= {("total", k): ((ya - mixed("a", "b", k)[at]) ** 2).mean() / 2 / var for k in SIGMAS}
        return out | {("pair", f"{p}*{q}"): (mixed("b", "a", p)[at] * mixed("a", "b", q)[at] - ya * yb).mean() / var - first[p] - first[q]
                      for p, q in itertools.combinations(SIGMAS, 2)}

    whole = indices(np.full(runs, True))
    without = [indices(block != b) for b in range(sobol.BLOCKS)]
    return {k: (v, math.sqrt((sobol.BLOCKS - 1) * np.var([w[k] for w in without]))) for k, v in whole.items()}


def test_sobol_indices(spark):
    keys = spark.createDataFrame([("wide", 1.0), ("narrow", 0.2), ("still", 0.0)], "mesh_id string, wide double")
    rows = sobol.pick_freeze(keys.crossJoin(sobol.design(spark, list(SIGMAS), 4096)), log_normals(SIGMAS), product)
    found = sobol.sobol_indices(rows, list(SIGMAS)).collect()
    assert len(found) == 3 * 9
    want = {"wide": brute_indices(4096, 1.0), "narrow": brute_indices(4096, 0.2)}
    for r in found:
        if r.mesh_id == "still":
            assert r.value is None
            continue
        value, error = want[r.mesh_id][r.effect, r.source]
        assert abs(r.value - value) < 1e-9 and abs(r.error - error) < 1e-9
    # the exact indices of a product of lognormals
    e = {k: math.exp(s * s) for k, s in SIGMAS.items()}
    whole = math.prod(e.values()) - 1
    exact = {("first", k): (v - 1) / whole for k, v in e.items()} | {("total", k): (v - 1) * math.prod(w for j, w in e.items() if j != k) / whole for k, v in e.items()}
    exact |= {("pair", f"{p}*{q}"): (e[p] - 1) * (e[q] - 1) / whole for p, q in itertools.combinations(SIGMAS, 2)}
    for r in found:
        if r.mesh_id == "wide":
            assert abs(r.value - exact[r.effect, r.source]) < max(0.03, 4 * r.error)


# --- plane -----------------------------------------------------------------------

def plane_points(seed, n, mesh, slopes=(0.03, -0.02), noise=0.004):
    rnd = np.random.default_rng(seed)
    w, d = rnd.random(n) * 1.2, rnd.random(n) * 0.3
    return [(mesh, int(i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(w, d, slopes[0] * w + slopes[1] * d + 0.5 + noise * rnd.standard_normal(n)))]


POINTS = "mesh_id string, vid long, w double, d double, u double"


def test_plane_posterior(spark):
    rows = plane_points(1, 400, "a") + plane_points(2, 7, "b") + [("line", i, 0.1 * i, 0.2 * i, 0.3 * i) for i in range(5)] + [("one", 0, 1.0, 2.0, 3.0)]
    found = {r.mesh_id: r for r in posterior.plane_posterior(posterior.plane_moments(spark.createDataFrame(rows, POINTS)), 1e-6).collect()}
    for mesh in "ab":
        x = np.array([r[2:] for r in rows if r[0] == mesh])
        at = x[:, :2] - x[:, :2].mean(axis=0)
        s = at.T @ at + 1e-6 * np.eye(2)
        beta = np.linalg.solve(s, at.T @ x[:, 2])
        sse = ((x[:, 2] - x[:, 2].mean()) ** 2).sum() - beta @ (at.T @ x[:, 2])
        variance, cov = sse / (len(x) - 3), np.linalg.inv(s)
        r = found[mesh]
        want = [*beta, x[:, 2].mean(), math.sqrt(variance), *np.sqrt(variance * np.diag(cov)), math.sqrt(variance / len(x)), cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1])]
        got = [r.slope_w, r.slope_d, r.height, r.sigma, r.slope_w_sd, r.slope_d_sd, r.height_sd, r.slopes_correlation]
        assert all(close(a, b, 1e-7) for a, b in zip(got, want))
    line, one = found["line"], found["one"]
    assert close(0.1 * line.slope_w + 0.2 * line.slope_d, 0.3, 1e-4) and line.height == pytest.approx(0.6)  # rises along the line as its points do
    assert (one.slope_w, one.slope_d, one.height, one.sigma) == (0.0, 0.0, 3.0, None)


def test_chains_agree_with_the_closed_form(spark):
    points = spark.createDataFrame(plane_points(3, 300, "a") + plane_points(4, 40, "b"), POINTS)
    moments = posterior.plane_moments(points)
    exact = {r.mesh_id: r for r in posterior.plane_posterior(moments).collect()}
    found = {(r.mesh_id, r.name): r for r in posterior.chain_summary(posterior.plane_chains(moments, steps=6100)).collect()}
    for mesh, e in exact.items():
        for name, mean, sd in (("slope_w", e.slope_w, e.slope_w_sd), ("slope_d", e.slope_d, e.slope_d_sd), ("height", 0.0, e.height_sd)):
            r = found[mesh, name]
            assert r.rhat < 1.02 and r.effective > 300 and 0.15 < r.accepted < 0.5
            assert abs(r.mean - mean) < 5 * sd / math.sqrt(r.effective) and abs(r.sd / sd - 1) < 0.15
        s = found[mesh, "log_sigma"]
        assert abs(s.mean - math.log(e.sigma)) < 5 * s.sd / math.sqrt(s.effective) + 0.03


def test_steepest_slope_cuts_the_posterior(spark):
    moments = posterior.plane_moments(spark.createDataFrame(plane_points(5, 100, "a", slopes=(0.03, 0.0), noise=0.02), POINTS))
    free = {r.name: r for r in posterior.chain_summary(posterior.plane_chains(moments, steps=2100)).collect()}
    cut = {r.name: r for r in posterior.chain_summary(posterior.plane_chains(moments, steps=2100, steepest=0.031)).collect()}
    assert cut["slope_w"].mean < free["slope_w"].mean and cut["slope_w"].mean < 0.031


def test_too_few_points_have_no_chain(spark):
    moments = posterior.plane_moments(spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0), ("a", 1, 1.0, 0.0, 1.0)], POINTS))
    assert posterior.chain_summary(posterior.plane_chains(moments)).count() == 0


# --- orientation and scale -------------------------------------------------------

def test_orientation_is_averaged(spark):
    rnd = np.random.default_rng(6)
    vertices = [("m", i, *map(float, x)) for i, x in enumerate(rnd.random((90, 3)) * [1.2, 0.3, 0.05])]
    tris = [("m", k, *[c for v in range(3) for c in vertices[3 * k + v][2:]]) for k in range(30)]
    vertices += [("bare", i, float(i), float(i * i), 0.0) for i in range(4)]
    names = ", ".join(f"{a}{k} double" for k in range(3) for a in "xyz")
    found = {r.mesh_id: r for r in posterior.orientation_marginal(
        spark.createDataFrame(vertices, "mesh_id string, vid long, x double, y double, z double"), spark.createDataFrame(tris, f"mesh_id string, fid long, {names}"), contrast=0.3).collect()}
    corner = np.array([t[2:] for t in tris]).reshape(-1, 3, 3)
    n = np.cross(corner[:, 1] - corner[:, 0], corner[:, 2] - corner[:, 0])
    mean = np.abs(n / (np.linalg.norm(n, axis=1, keepdims=True) + 1e-10)).mean(axis=0)
    p = np.exp(0.3 * 30 * (mean - mean.max()))
    p /= p.sum()
    at = np.array([v[2:] for v in vertices if v[0] == "m"])
    each = []
    for up in range(3):
        flat = [k for k in range(3) if k != up]
        x = np.column_stack([at[:, flat], np.ones(len(at))])
        beta = np.linalg.lstsq(x, at[:, up], rcond=None)[0]
        size = sorted(np.ptp(at[:, flat], axis=0))
        each.append([size[0], size[1], np.sqrt(((at[:, up] - x @ beta) ** 2).mean()), math.degrees(math.atan(np.hypot(*beta[:2])))])
    each, r = np.array(each), found["m"]
    for k, name in enumerate(("width", "depth", "residual", "tilt")):
        m = p @ each[:, k]
        assert close(r[name], m, 1e-7) and close(r[f"{name}_sd"], math.sqrt(p @ (each[:, k] - m) ** 2), 1e-6)
    assert [r.p_x, r.p_y, r.p_z] == pytest.approx(p) and close(r.entropy, -(p * np.log(p)).sum(), 1e-9) and r.up == "XYZ"[p.argmax()] and r.ambiguous == (p.max() < 0.95)
    assert found["bare"].n_faces == 0 and found["bare"].p_x == pytest.approx(1 / 3) and found["bare"].up == "X" and found["bare"].ambiguous


def test_scale_posterior(spark):
    rows = [("mm", 1150.0, 310.0, None), ("cm", 118.0, 29.0, None), ("m", 1.3, 0.28, None), ("odd", 20.0, 8.0, None), ("given", 1.3, 0.28, 1.0), ("none", None, None, None), ("flat", 0.0, 0.3, None)]
    found = {r.mesh_id: r for r in posterior.scale_posterior(scale_prior(spark.createDataFrame(rows, "mesh_id string, width_raw double, depth_raw double, user_scale double"))).collect()}
    for name, width, depth, _ in rows:
        r = found[name]
        logs = [math.log(h.prob) + sum(-0.5 * (math.log(x * h.scale / m) / s) ** 2 for x, (m, s) in ((width, posterior.TREAD_WIDTH), (depth, posterior.TREAD_DEPTH)) if x) for h in r.hypotheses]
        p = np.exp(np.array(logs) - max(logs))
        p /= p.sum()
        want = sorted(zip(-p, [h.scale for h in r.hypotheses]))
        assert [h.scale for h in r.posterior] == [s for _, s in want] and [h.prob for h in r.posterior] == pytest.approx([-q for q, _ in want])
        assert r.ambiguous == (p.max() < 0.95) and close(r.entropy, -sum(q * math.log(q) for q in p if q > 0), 1e-9)
        assert close(r.log10_mean, p @ np.log10([h.scale for h in r.hypotheses]), 1e-9)
        shown = json.loads(r.posterior_json)
        assert list(shown) == [h.label for h in r.posterior] and sum(shown.values()) == pytest.approx(1, abs=2e-4)
    assert [found[n].unit for n in ("mm", "cm", "m")] == ["mm", "cm", "m"] and not found["mm"].ambiguous


# --- clusters --------------------------------------------------------------------

def test_profile_moments(spark):
    rnd = np.random.default_rng(7)
    rows = [(f"s{k}", float(x), float(w)) for k in range(5) for x, w in zip(rnd.random(40), rnd.random(40))]
    rows += [("point", 1.0, 2.0), ("point", 1.0, 3.0), ("none", 1.0, 0.0), ("none", 2.0, None), ("s0", None, 5.0), ("s0", 3.0, -1.0)]
    found = {r.k: r for r in clusters.profile_moments(spark.createDataFrame(rows, "k string, x double, w double"), ["k"], "x", "w").collect()}
    for k in range(5):
        x, w = np.array([r[1:] for r in rows if r[0] == f"s{k}" and r[1] is not None and r[2] > 0]).T
        mean = np.average(x, weights=w)
        m2, m3, m4 = (np.average((x - mean) ** p, weights=w) for p in (2, 3, 4))
        assert [found[f"s{k}"][c] for c in clusters.MOMENTS] == pytest.approx([mean, math.sqrt(m2), m3 / m2**1.5, m4 / m2**2])
        assert found[f"s{k}"].n == 40
    assert (found["point"].spread, found["point"].skewness) == (0.0, None) and found["none"].mean is None and found["none"].n == 0


def brute_means(x, k, rounds):
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    d = lambda c: ((z[:, None, :] - np.array(c)[None]) ** 2).sum(axis=2)
    centres = [z[(z**2).sum(axis=1).argmin()]]
    while len(centres) < k:
        centres.append(z[d(centres).min(axis=1).argmax()])
    for _ in range(rounds):
        near = d(centres).argmin(axis=1)
        far = list(np.argsort(-d(centres).min(axis=1), kind="stable"))
        centres = [z[near == j].mean(axis=0) if (near == j).any() else z[far.pop(0)] for j in range(k)]
    return d(centres).argmin(axis=1), np.sqrt(d(centres).min(axis=1))


def test_clusters(spark):
    rnd = np.random.default_rng(8)
    x = np.concatenate([rnd.normal(0, 1, (60, 2)), rnd.normal(6, 0.5, (25, 2)), rnd.normal([-8, 9], 0.3, (4, 2))])
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(1000, None, 1.0)]
    found = {r.i: r for r in clusters.outsiders(spark.createDataFrame(rows, "i long, p double, q double"), "i", ["p", "q"], 3, 6).collect()}
    near, far = brute_means(x, 3, 6)
    assert [found[i].cluster for i in range(len(x))] == near.tolist() and [found[i].distance for i in range(len(x))] == pytest.approx(far.tolist())
    assert {found[i].verdict for i in range(60)} == {"MAIN"} and {found[i].verdict for i in range(60, 85)} == {"VARIANT"}
    assert {found[i].verdict for i in range(85, 89)} == {"REPLACED"} and found[1000].verdict == "UNKNOWN" and found[1000].cluster is None


def test_fewer_rows_than_clusters(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0)], "i long, p double")
    found = {r.i: r for r in clusters.outsiders(rows, "i", ["p"], 5, 3).collect()}
    assert found[1].cluster == found[2].cluster != found[3].cluster
    assert clusters.outsiders(rows.limit(0), "i", ["p"]).count() == 0


def test_empty_cluster_takes_the_farthest_row(spark, monkeypatch):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 1, 2, 3, 50])], "i long, p double")
    monkeypatch.setattr(clusters, "starts", lambda *a: [[0.0], [90.0]])
    found = {r.i: r.cluster for r in clusters.k_means(rows, "i", ["p"], 2, 4)[0].collect()}
    assert found[4] == 1 and {found[i] for i in range(4)} == {0}


# --- flights ---------------------------------------------------------------------

STEPS = "f string, step double, depth double"


def test_consistency(spark):
    rnd = np.random.default_rng(9)
    rows = []
    for k in range(6):
        x = np.arange(12 + k)
        y = 5 + 0.4 * x - 0.03 * x**2 + rnd.normal(0, 0.2, len(x))
        y[4] -= 2.0 * (k % 2)
        rows += [(f"f{k}", float(a), float(b)) for a, b in zip(x, y)]
    rows += [("two", 1.0, 3.0), ("two", 2.0, 4.0), ("same", 1.0, 3.0), ("same", 1.0, 5.0), ("same", 1.0, 4.5), ("exact", 0.0, 0.0), ("exact", 1.0, 1.0), ("exact", 2.0, 4.0),
             ("exact", 3.0, 9.0), ("exact", 4.0, 16.0), ("gap", 1.0, None), ("gap", 2.0, 1.0), ("apart", 1.0, 1.0), ("apart", 1.0, 2.0), ("apart", 1.0, 4.0), ("apart", 9.0, 7.0)]
    found = defaultdict(list)
    for r in flight.consistency(spark.createDataFrame(rows, STEPS), ["f"]).collect():
        found[r.f].append(r)
    assert sum(map(len, found.values())) == len(rows)
    for k in range(6):
        own = sorted(found[f"f{k}"], key=lambda r: r.step)
        x, y = np.array([r.step for r in own]), np.array([r.depth for r in own])
        a = np.column_stack([np.ones(len(x)), x, x * x])
        beta, h = np.linalg.lstsq(a, y, rcond=None)[0], np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
        e = y - a @ beta
        t = e / (math.sqrt(e @ e / (len(x) - 3)) * np.sqrt(1 - h))
        assert [r.expected for r in own] == pytest.approx((a @ beta).tolist()) and [r.studentised for r in own] == pytest.approx(t.tolist(), rel=1e-6)
        assert [r.wear for r in own] == ["LOWER" if v < -2 else "HIGHER" if v > 2 else "CONSISTENT" for v in t]
        assert own[4].wear == "LOWER" or k % 2 == 0
    for name in ("two", "exact", "gap"):
        assert {r.wear for r in found[name]} == {"UNKNOWN"} and all(r.studentised is None for r in found[name])
    same = np.array([3.0, 5.0, 4.5])
    want = (same - same.mean()) / (same.std(ddof=1) * math.sqrt(2 / 3))
    assert sorted(r.studentised for r in found["same"]) == pytest.approx(sorted(want))
    apart = sorted(found["apart"], key=lambda r: (r.step, r.depth))
    assert apart[3].studentised is None and apart[3].expected == pytest.approx(7.0) and apart[0].studentised is not None


@pytest.fixture()
def many_ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_replaced_steps_across_ranges(spark, many_ranges):
    rnd = np.random.default_rng(10)
    rows = [("long", float(i), float(v)) for i, v in enumerate(rnd.normal(10, 1, 400))] + [("short", float(i), 5.0 + i) for i in range(3)] + [("one", 0.0, 1.0), ("flat", 0.0, 2.0), ("flat", 1.0, 2.0)]
    rows[77] = ("long", 77.0, -5.0)
    rows.append(("long", 5.0, None))
    found = defaultdict(list)
    for r in flight.replaced_steps(spark.createDataFrame(rows, STEPS).repartition(5), "f", ["step"], "depth").collect():
        found[r.f].append(r)
    for name, own in found.items():
        own.sort(key=lambda r: r.step)
        y = [r.depth for r in own]
        before, after = [None, *y[:-1]], [*y[1:], None]
        assert [r.before for r in own] == before and [r.after for r in own] == after
        gaps = [v - min(x for x in (b, a) if x is not None) if (b, a) != (None, None) else None for v, b, a in zip(y, before, after)]
        known = [g for g in gaps if g is not None]
        if name == "long":
            mid = np.median(known)
            mad = flight.NORMAL_MAD * np.median(np.abs(np.array(known) - mid))
            assert [r.contrast for r in own] == pytest.approx([(g - mid) / mad for g in gaps])
            assert own[77].replaced and sum(r.replaced for r in own) < 12
    assert found["one"][0].contrast is None and not found["one"][0].replaced and found["flat"][0].contrast is None


def brute_shifts(y, gain, rounds):
    def split(lo, hi, left):
        if left:
            best, at = 0.0, None
            for c in range(lo + 1, hi):
                d = (np.mean(y[lo:c]) - np.mean(y[c:hi])) ** 2 * (c - lo) * (hi - c) / (hi - lo)
                if d > best + 1e-12:
                    best, at = d, c
            if at is not None and best >= gain * np.var(y):
                return split(lo, at, left - 1) + split(at, hi, left - 1)
        return [(lo, hi - 1, hi - lo, float(np.mean(y[lo:hi])))]

    return split(0, len(y), rounds)


def test_shifts_across_ranges(spark, many_ranges):
    rnd = np.random.default_rng(11)
    flights = {
        "two": np.concatenate([rnd.normal(0.5, 0.02, 150), rnd.normal(0.3, 0.02, 90)]),
        "four": np.concatenate([rnd.normal(m, 0.3, n) for m, n in ((0, 60), (4, 30), (2, 80), (7, 50))]),
        "none": rnd.normal(0, 1, 120), "flat": np.full(9, 2.0), "one": np.array([3.0])}
    rows = [(k, float(i), float(v)) for k, y in flights.items() for i, v in enumerate(y)] + [("one", 9.0, None)]
    found = defaultdict(list)
    for r in flight.shifts(spark.createDataFrame(rows, STEPS).repartition(4), "f", ["step"], "depth", 12.0).collect():
        found[r.f].append(tuple(r)[1:])
    for k, y in flights.items():
        got, want = sorted(found[k]), brute_shifts(y, 12.0, 3)
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert [g[:2] for g in sorted(found["two"])] == [(0, 149), (150, 239)] and len(found["four"]) == 4 and len(found["none"]) == 1
