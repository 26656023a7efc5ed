"""Replicates of a partial correlation made together against one after another, and ridge fits of few columns."""

import time

import numpy as np

from kinetable.operators import probes, resample


def test_many_partial_correlations_are_the_single_ones_and_faster():
    r = np.random.default_rng(1)
    for k in range(30):
        n = int(r.integers(1, 60))
        v = {c: np.round(r.normal(size=n), 1) for c in ("prediction", "reference_value", "covariate")}
        if k % 5 == 0:
            v["covariate"][:] = 1.0
        if k % 3 == 0:
            v["prediction"][r.random(n) < 0.2] = np.nan
        w = r.poisson(1, (20, n))
        want = [np.nan if (x := resample.partial_rho(v, row)) is None else x for row in w]
        assert np.allclose(resample.many_partial_rho(v, w.astype(float)), want, equal_nan=True, atol=1e-12)
    w = r.poisson(1, (250, n)).astype(float)
    start = time.perf_counter()
    resample.many_partial_rho(v, w)
    middle = time.perf_counter()
    for row in w:
        resample.partial_rho(v, row)
    assert middle - start < (time.perf_counter() - middle) / 2


def test_ridge_by_columns_and_by_rows_is_the_plain_solution():
    r = np.random.default_rng(3)
    for n, d in ((40, 6), (6, 40)):
        x, y, z = r.normal(size=(n, d)), r.normal(size=(n, 3)), r.normal(size=(5, d))
        path = probes.RidgePath(x, y)
        assert len(path.values) == 6
        for penalty in (1.0, 100.0):
            plain = z @ np.linalg.solve(x.T @ x + penalty * np.eye(d), x.T @ (y - y.mean(0))) + y.mean(0)
            assert np.allclose(path.predict(z, penalty), plain)
