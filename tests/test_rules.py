"""Rules in place of seeded draws: fixed rounds of the mixture and given draw counts of the bootstrap."""

import numpy as np
import pytest

from footfall.operators import mixture, plane as P
from footfall.operators.keyed import settle


def plain_rounds(x, n, k, rounds):
    """The mixture of one histogram, component by component."""
    cum = np.cumsum(n)
    centre = [x[np.searchsorted(cum, (c + 0.5) / k * cum[-1])] for c in range(k)]
    resp = np.zeros((len(x), k))
    resp[np.arange(len(x)), [min(range(k), key=lambda c: (abs(v - centre[c]), c)) for v in x]] = 1
    for i in range(rounds + 1):
        mass = [(n * resp[:, c]).sum() + 10 * np.finfo(float).eps for c in range(k)]
        mean = [(n * resp[:, c] * x).sum() / mass[c] for c in range(k)]
        var = [(n * resp[:, c] * (x - mean[c]) ** 2).sum() / mass[c] + mixture.VARIANCE_FLOOR for c in range(k)]
        dens = np.array([m / sum(mass) * np.exp(-((x - mu) ** 2) / (2 * v)) / np.sqrt(2 * np.pi * v) for m, mu, v in zip(mass, mean, var)]).T
        resp = dens / dens.sum(axis=1, keepdims=True)
    return mean, var, [m / sum(mass) for m in mass], -2 * (n * np.log(dens.sum(axis=1))).sum() + (3 * k - 1) * np.log(n.sum())


@pytest.mark.parametrize("k", [1, 2, 3])
def test_fixed_rounds_of_the_mixture(k):
    rnd = np.random.default_rng(1)
    x = np.linspace(0, 1, 40)
    n = np.stack([np.floor(50 * np.exp(-((x - c) ** 2) / 0.01) + 40 * np.exp(-((x - 0.8) ** 2) / 0.02) + rnd.integers(0, 3, 40)) for c in (0.2, 0.3)])
    got = mixture.fit_mixtures(np.stack([x, x]), n, k, rounds=5)
    for row in range(2):
        want = plain_rounds(x, n[row], k, 5)
        for a, b in zip(got, want):
            assert np.allclose(a[row], b, rtol=1e-8)


@pytest.mark.parametrize("size", [1 << 17, 7])
def test_given_draw_counts_of_the_bootstrap(spark, size):
    rnd = np.random.default_rng(2)
    at = rnd.random((40, 3))
    rows = [("m", i, *map(float, v)) for i, v in enumerate(at)]
    points = spark.createDataFrame(rows, "mesh_id string, vid long, w double, d double, u double")
    planes = settle(spark.createDataFrame([("m", 0.0, 0.0, 0.5, 40)], "mesh_id string, a double, b double, c double, pool long"), "plane")
    times = lambda ords, reps: ((np.arange(reps)[:, None] * 5 + ords[None, :] * 3) % 4).astype(float)
    found = {r.b: (r.pa, r.pb, r.pc) for r in P.bootstrap_planes(points, planes, 6, size=size, times=times)[0].collect()}
    for b in range(6):
        w = np.sqrt(times(np.arange(40), 6)[b])
        want = np.linalg.lstsq(np.column_stack([at[:, 0], at[:, 1], np.ones(40)]) * w[:, None], at[:, 2] * w, rcond=None)[0]
        assert np.allclose(found[b], want)
