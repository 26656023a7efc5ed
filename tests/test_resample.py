"""Bootstrap statistics against their plain forms on expanded rows."""

import math
import statistics as st
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import resample


def plain_ranks(v):
    return np.array([sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v])


def plain_rho(x, y):
    return float(np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1])


def expanded(v, w):
    return {k: np.repeat(a, w) for k, a in v.items()}


def test_replicates_of_the_reference():
    assert resample.B == 2000


@pytest.mark.parametrize("seed", range(8))
def test_weighted_statistics_equal_expanded_ones(seed):
    r = np.random.default_rng(seed)
    n = 12
    v = {"prediction": r.integers(0, 6, n) / 2, "reference_value": r.integers(1, 7, n) / 2, "covariate": r.integers(0, 5, n) * 1.0, "score_tolerance": np.full(n, 0.3), "score_floor": np.full(n, 1.0)}
    v |= {"numerator": r.integers(0, 9, n) * 1.0, "denominator": r.integers(-1, 4, n) * 1.0, "value": v["prediction"], "other": r.integers(0, 6, n) / 2, "other_reference": v["reference_value"]}
    w = r.integers(0, 4, n)
    e = expanded(v, w)
    assert math.isclose(resample.rho(v, w), plain_rho(e["prediction"], e["reference_value"]))
    assert math.isclose(resample.delta_rho(v, w), plain_rho(e["prediction"], e["reference_value"]) - plain_rho(e["other"], e["other_reference"]), abs_tol=1e-12)
    assert math.isclose(resample.median(v, w), st.median(e["value"])) and math.isclose(resample.mean(v, w), e["value"].mean())
    ratios = [a / b for a, b in zip(e["numerator"], e["denominator"], strict=True) if b > 0]
    assert math.isclose(resample.ratio(v, w), st.median(ratios))

    def score(p, y):
        return 10.0 * sum((abs(p - y) - 0.3) / max(abs(y), 1.0) < s for s in resample.STEPS)

    med = st.median(e["reference_value"])
    want = np.mean([score(p, y) - score(med, y) for p, y in zip(e["prediction"], e["reference_value"], strict=True)])
    assert math.isclose(resample.margin(v, w), want, abs_tol=1e-9)
    xy, xz, yz = plain_rho(e["prediction"], e["reference_value"]), plain_rho(e["prediction"], e["covariate"]), plain_rho(e["reference_value"], e["covariate"])
    assert math.isclose(resample.partial_rho(v, w), (xy - xz * yz) / math.sqrt((1 - xz**2) * (1 - yz**2)))


def test_undefined_statistics():
    one = np.ones(3)
    assert resample.rho({"prediction": one, "reference_value": np.arange(3.0)}, one) is None
    assert resample.ratio({"numerator": one, "denominator": -one}, one) is None
    assert resample.margin({"prediction": one * np.nan, "reference_value": one, "score_tolerance": one, "score_floor": one}, one) is None


def test_interval_needs_nine_tenths(spark):
    rows = [("c", k, float(k == 0), float(k)) for k in range(5)]
    df = spark.createDataFrame(rows, "cell string, cl int, prediction double, reference_value double")
    got = resample.bootstrap(df, ["cell"], "cl", ["prediction", "reference_value"], resample.rho, b=400).first()
    assert got.defined < 360 and got.lo is None and got.hi is None and got.point is not None and got.clusters == 5


STATS = {
    "mean": (resample.mean, ["value"]), "median": (resample.median, ["value"]), "rho": (resample.rho, ["prediction", "reference_value"]), "ratio": (resample.ratio, ["numerator", "denominator"]),
    "delta_rho": (resample.delta_rho, ["prediction", "reference_value", "other", "other_reference"]), "common": (resample.common_delta_rho, ["prediction", "reference_value", "other", "other_reference"]), "margin": (resample.margin, ["prediction", "reference_value", "score_tolerance", "score_floor"]),
    "partial": (resample.partial_rho, ["prediction", "reference_value", "covariate"]),
}


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Cells with continuous and tied values, missing answers, one cluster only, and fewer rows than a statistic needs."""
    r = np.random.default_rng(12)
    rows = []
    for cell, n, clusters in (("many", 120, 9), ("own", 40, 40), ("one", 25, 1), ("few", 2, 2)):
        for i in range(n):
            v = [round(float(x), 1) if i % 2 else float(x) for x in r.normal(3, 2, 7)]
            rows.append((cell, i % clusters, None if i % 11 == 3 else v[0], v[1], v[2], v[3], v[4], None if i % 7 == 2 else v[5], 0.3, 1.0, v[6]))
    return spark.createDataFrame(rows, "cell string, cl int, prediction double, reference_value double, other double, other_reference double, numerator double, denominator double, score_tolerance double, score_floor double, covariate double").withColumn("value", F.col("prediction"))


@pytest.mark.parametrize("name", STATS)
def test_cells_that_nobody_holds_give_the_same(odd_rows, name):
    stat, values = STATS[name]
    one, two = (sorted(tuple(r) for r in resample.bootstrap(odd_rows, ["cell"], "cl", values, stat, b=30, limit=limit).collect()) for limit in (resample.LIMIT, 30))
    assert len(one) == 4 and len(one) == len(two)
    for a, b in zip(one, two, strict=True):
        assert a[:2] == b[:2] and a[-1] == b[-1]
        assert a[2:5] == pytest.approx(b[2:5], abs=1e-9)


def test_binomial_quantiles_are_exact():
    for n, k in ((1, 0), (7, 3), (60, 1), (200, 199), (500, 250), (9, 9)):
        mass = [math.comb(n, i) * k**i * (n - k) ** (n - i) for i in range(n + 1)]
        for u in (1e-9, 0.0249, 0.5, 0.975, 1 - 1e-9):
            want = next(i for i in range(n + 1) if sum(mass[: i + 1]) >= Fraction(u) * n**n)
            assert resample.binomial_quantile(u, n, k) == want
    big = 10**12
    assert abs(resample.binomial_quantile(0.975, big, big // 4) - (big / 4 + 1.959964 * math.sqrt(big * 3 / 16))) < 5


def plain_trials(rep, draw):
    def mixed(h):
        for _ in range(2):
            h = (h ^ (h >> 16)) * 73244475 % 2**32
        return h ^ (h >> 16)

    return mixed((mixed(draw % 2**32) + rep * 2654435761 + (draw >> 32) * 40503) % 2**32)


def test_binomial_replicates_draw_every_trial(spark):
    cells = [("few", 7, 3), ("one", 1, 0), ("all", 9, 9), ("none", 0, 0), (None, 400, 150), ("run", resample._RUN, 300), ("runs", resample._RUN + 4000, 20000)]
    b = resample.BLOCK + 30
    found = resample.binomial_bootstrap(spark.createDataFrame(cells, "cell string, n long, k long"), ["cell"], "k", "n", b).collect()
    want = set()
    for cell, n, k in cells:
        if n:
            vs = sorted(int((plain_trials(rep, np.arange(n)) < k / n * 2**32).sum()) / n for rep in range(1, b + 1))
            want.add((cell, n, k / n, vs[int(0.025 * b)], vs[int(0.975 * b) - 1]))
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_binomial_interval_of_unknown_successes_is_null(spark):
    found = resample.binomial_bootstrap(spark.createDataFrame([("a", 5, None)], "cell string, n long, k long"), ["cell"], "k", "n", 40)
    assert [tuple(r) for r in found.collect()] == [("a", 5, None, None, None)]


@pytest.mark.parametrize(("n", "k"), [(20, 7), (375, 125), (3750, 1250), (3750, 10), (30000, 15000)])
def test_drawn_replicates_spread_as_binomial_ones(n, k):
    v = np.sort(resample._wins(np.arange(1, resample.BINOMIAL + 1), 0, n, k / n))
    sd = math.sqrt(k * (1 - k / n))
    assert abs(v.mean() - k) < 0.15 * sd and 0.9 < v.std() / sd < 1.1
    for at, u in ((25, 0.025), (974, 0.975)):
        assert abs(v[at] - resample.binomial_quantile(u, n, k)) <= 1 + 0.3 * sd


def test_trials_in_sql_are_those_in_numpy():
    duckdb = pytest.importorskip("duckdb")
    odd = [(rep, draw) for rep in (1, 2, 1000) for draw in (0, 1, 65535, 65536, 2**32 - 1, 2**32, 5 * 2**32 + 7)]
    found = duckdb.sql(f"SELECT rep, draw, h FROM ({resample.trials_sql('(VALUES ' + ', '.join(f'({r}::BIGINT, {d}::BIGINT)' for r, d in odd) + ') v(rep, draw)')})").fetchall()
    assert sorted(found) == sorted((r, d, plain_trials(r, d)) for r, d in odd)
    assert all(resample.trials(np.array([r]), np.array([d]))[0, 0] == h for r, d, h in found)
