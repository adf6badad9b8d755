"""Ellipses of readings, weathering against traffic and the log-profile test against plain restatements."""

import math
from collections import defaultdict

import numpy as np
import pytest

from footfall.operators import erosion, flight, provenance
from footfall.operators.keyed import settle

SCHEMA = "q string, kind string, a double, b double, c double"


def quarry(seed, n, mean, name, kind):
    rnd = np.random.default_rng(seed)
    mix = np.array([[1.0, 0.6, 0.0], [0.0, 0.5, 0.2], [0.0, 0.0, 0.3]])
    return [(name, kind, *map(float, mean + x @ mix)) for x in rnd.normal(size=(n, 3))]


def test_readings_against_the_ellipse(spark):
    rows = quarry(1, 60, [5, 1, 2], "full", "old") + quarry(2, 12, [5, 1, 2], "full", "new") + quarry(3, 10, [9, 1, 2], "full", "new")
    rows += quarry(4, 3, [0, 0, 0], "few", "old") + quarry(5, 2, [0, 0, 0], "few", "new") + [("none", "new", 1.0, 1.0, 1.0), ("full", "old", None, 1.0, 1.0), ("full", "new", 1.0, None, 1.0)]
    rows += [("flat", "old", float(i), 2.0 * i + 1, float(i * i)) for i in range(8)]  # b follows from a
    rows += [("flat", "new", 3.5, 8.0, 12.0), ("flat", "new", 3.5, 8.1, 12.0), ("still", "old", 1.0, 2.0, 3.0), ("still", "old", 1.0, 2.0, 3.0), ("still", "old", 1.0, 2.0, 3.0), ("still", "old", 1.0, 2.0, 3.0),
             ("still", "new", 1.0, 2.0, 3.0), ("still", "new", 1.0, 2.5, 3.0)]
    table = spark.createDataFrame(rows, SCHEMA)
    names = ["a", "b", "c"]
    shape = provenance.ellipse(table.where("kind = 'old'"), ["q"], names)
    judged = provenance.judge_readings(table, shape, ["q"], names).collect()
    assert len(judged) == len(rows)
    old = np.array([r[2:] for r in rows if r[0] == "full" and r[1] == "old" and None not in r])
    inverse = np.linalg.inv(np.cov(old.T))
    for r in judged:
        x = [r.a, r.b, r.c]
        if r.q in ("few", "none") or None in x:
            assert r.distance2 is None and r.outside is None
        elif r.q == "full":
            d = (x - old.mean(axis=0)) @ inverse @ (x - old.mean(axis=0))
            assert r.distance2 == pytest.approx(d) and r.outside == (d > provenance.CHI_SQUARE_95[2])
        elif r.q == "flat":
            flat = np.array([(k[2], k[4]) for k in rows if k[:2] == ("flat", "old")])
            at = np.array([r.a, r.c]) - flat.mean(axis=0)
            want = at @ np.linalg.inv(np.cov(flat.T)) @ at if abs(r.b - 2 * r.a - 1) < 1e-9 else math.inf
            assert r.distance2 == pytest.approx(want) and r.outside == (want > provenance.CHI_SQUARE_95[1])
        else:
            assert r.distance2 == (0.0 if r.b == 2.0 else math.inf) and r.outside == (r.b != 2.0)
    found = {r.q: r for r in provenance.provenance(table.where("kind = 'old'"), table.where("kind = 'new'"), ["q"], names).collect()}
    new = np.array([r[2:] for r in rows if r[:2] == ("full", "new") and None not in r])
    d = (new.mean(axis=0) - old.mean(axis=0)) @ inverse @ (new.mean(axis=0) - old.mean(axis=0))
    full = found["full"]
    assert (full.n_reference, full.n_suspects) == (60, 22) and full.distance2 == pytest.approx(d) and 10 <= full.n_outside < 22
    assert found["few"].verdict == found["none"].verdict == "UNKNOWN" and found["none"].n_reference == 0
    assert found["still"].verdict == "OTHER SOURCE"


def test_other_and_same_source(spark):
    rows = quarry(6, 80, [5, 1, 2], "x", "old") + quarry(7, 9, [5, 1, 2], "x", "new") + quarry(8, 80, [5, 1, 2], "y", "old") + quarry(9, 9, [5, 5, 2], "y", "new")
    table = spark.createDataFrame(rows, SCHEMA)
    found = {r.q: r.verdict for r in provenance.provenance(table.where("kind = 'old'"), table.where("kind = 'new'"), ["q"], ["a", "b"]).collect()}
    assert found == {"x": "SAME SOURCE POSSIBLE", "y": "OTHER SOURCE"}


def grids(spark, shapes, g=20):
    rows, boxes = [], []
    for mesh, depth in shapes.items():
        boxes.append((mesh, 0.0, 1.9, 0.0, 1.0))
        for i in range(g):
            for j in range(g):
                if depth[i, j] > 0:
                    rows.append((mesh, i, j, i / (g - 1), 0.1 * j, float(depth[i, j])))
    ext = settle(spark.createDataFrame(boxes, "mesh_id string, w_min double, w_max double, d_min double, d_max double"), "box")
    return spark.createDataFrame(rows, "mesh_id string, i int, j int, y double, x double, depth_mm double"), ext


def shapes(g=20):
    rnd = np.random.default_rng(12)
    x = np.arange(g) * 0.1
    track = np.exp(-((x - 0.8) ** 2) / (2 * 0.25**2))
    lanes = np.exp(-((x - 0.5) ** 2) / (2 * 0.1**2)) + np.exp(-((x - 1.4) ** 2) / (2 * 0.1**2))
    noise = lambda: np.exp(rnd.normal(0, 0.05, (g, g)))
    holes = np.where(rnd.random((g, g)) < 0.3, 0.0, 1.0)
    return {
        "weather": np.full((g, g), 2.0), "feet": 9.0 * track * noise(), "both": 1.5 + 6.0 * track + rnd.normal(0, 0.1, (g, g)), "lanes": 8.0 * lanes * noise() + 1e-3,
        "holes": 5.0 * track * noise() * holes, "edges": (3.0 - 2.0 * track) * noise(), "bare": np.zeros((g, g)),
    }


def test_weathering_and_traffic(spark):
    given, g = shapes(), 20
    cells, ext = grids(spark, given)
    found = {r.mesh_id: r for r in erosion.coupled_erosion(cells, ext, g).collect()}
    assert set(found) == set(given)
    x = np.arange(g) * 0.1
    for mesh, depth in given.items():
        depth, r = np.maximum(depth, 0.0), found[mesh]
        line = depth.mean(axis=0)
        base = np.concatenate([line[:2], line[-2:]]).mean()
        assert r.baseline_mm == pytest.approx(base)
        assert r.mechanical_share == pytest.approx(np.maximum(depth - base, 0).sum() / depth.sum() if depth.any() else 0.0, abs=1e-12)
        above = np.maximum(line - base, 0)
        if above.sum() == 0:
            assert r.centre is None and r.spread is None and r.traffic_mm == 0.0 and r.weathering_mm == pytest.approx(line.mean())
            continue
        centre = (above * x).sum() / above.sum()
        spread = math.sqrt((above * (x - centre) ** 2).sum() / above.sum())
        assert (r.centre, r.spread) == (pytest.approx(centre), pytest.approx(spread))
        k = np.exp(-((x - centre) ** 2) / (2 * spread**2))
        best = min(((line - a - b * k) @ (line - a - b * k), a, b) for a, b in (
            tuple(np.linalg.lstsq(np.column_stack([np.ones(g), k]), line, rcond=None)[0]), (line.mean(), 0.0), (0.0, (k @ line) / (k @ k))) if a >= 0 and b >= 0)
        assert (r.weathering_mm, r.traffic_mm) == (pytest.approx(best[1], abs=1e-9), pytest.approx(best[2], abs=1e-9))
        assert r.explained == pytest.approx(1 - best[0] / ((line - line.mean()) ** 2).sum(), abs=1e-9)
    assert abs(found["both"].weathering_mm - 1.5) < 0.5 and abs(found["both"].traffic_mm - 6.0) < 0.5 and found["edges"].traffic_mm >= 0


def test_log_profile(spark):
    given, g = shapes(), 20
    cells, _ = grids(spark, given)
    found = {r.mesh_id: r for r in erosion.log_profile(cells).collect()}
    assert set(found) == set(given) - {"bare"}
    for mesh, r in found.items():
        depth = given[mesh]
        y = np.where(depth > 0, np.log(np.where(depth > 0, depth, 1)), np.nan)
        j = np.flatnonzero((depth > 0).any(axis=0))
        n, mean = (depth > 0).sum(axis=0)[j], np.nanmean(y[:, j], axis=0)
        x = 0.1 * j
        a = np.column_stack([np.ones(len(j)), x, x * x])
        w = np.sqrt(n)
        beta = np.linalg.lstsq(a * w[:, None], mean * w, rcond=None)[0]
        lack = (n * (mean - a @ beta) ** 2).sum() / (len(j) - 3)
        pure = np.nansum((y[:, j] - mean) ** 2) / (n.sum() - len(j))
        assert (r.n_columns, r.n_cells) == (len(j), n.sum()) and r.lack == pytest.approx(lack, abs=1e-9) and r.pure == pytest.approx(pure, abs=1e-12)
        if mesh == "weather":
            assert r.verdict == "UNKNOWN" and r.score is None
            continue
        f, u, v = np.cbrt(lack / pure), 2 / (9 * (len(j) - 3)), 2 / (9 * (n.sum() - len(j)))
        assert r.score == pytest.approx(((1 - v) * f - (1 - u)) / math.sqrt(v * f * f + u), rel=1e-6)
        if beta[2] < 0:
            assert r.centre == pytest.approx(-beta[1] / (2 * beta[2])) and r.spread == pytest.approx(math.sqrt(-0.5 / beta[2]))
        else:
            assert r.centre is None and r.spread is None
    assert found["feet"].verdict == "SINGLE TRACK" and found["holes"].score < 3 < found["lanes"].score and abs(found["feet"].centre - 0.8) < 0.02 and abs(found["feet"].spread - 0.25) < 0.02
    assert found["lanes"].verdict == "NOT GAUSSIAN" and found["edges"].verdict == "NO TRACK"


def test_weighted_trend(spark):
    rnd = np.random.default_rng(13)
    rows = [(k, float(x), float(y), float(w)) for k in "ab" for x, y, w in zip(rnd.random(15), rnd.random(15), rnd.random(15))] + [("a", 1.0, 1.0, 0.0), ("a", 1.0, None, 1.0), ("c", 1.0, 2.0, None)]
    found = {r.k: r for r in flight.trend(spark.createDataFrame(rows, "k string, x double, y double, w double"), ["k"], "x", "y", "w").collect()}
    own = defaultdict(list)
    for k, x, y, w in rows[:30]:
        own[k].append((x, y, w))
    assert set(found) == set(own)
    for k, r in found.items():
        x, y, w = np.array(own[k]).T
        s = np.sqrt(w)
        beta, sse = np.linalg.lstsq(np.column_stack([s, s * x, s * x * x]), s * y, rcond=None)[:2]
        assert r.b2 == pytest.approx(beta[2]) and r.b1 - r.b2 * (r.m1 + 2 * r.x_mean) == pytest.approx(beta[1]) and r.sse == pytest.approx(sse[0]) and r.n == 15
