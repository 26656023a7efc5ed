"""Positions of two views, robust maps and assignments, number prefixes and halves by plain restatements."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from kinetable.operators import boxes, paired, poses, rules


def test_positions_at_the_same_instants(spark):
    players = spark.createDataFrame([("a", t, f, 10.0 * t + f, 5.0, 4.0, 20.0) for t in (1, 2) for f in range(1, 121)], "seq string, track int, frame int, x double, y double, w double, h double")
    clips = spark.createDataFrame([("a", 29.97, 120), ("b", 25.0, 20)], "seq string, fps double, length int")
    maps = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 2.0)], "seq string, " + ", ".join(f"h{i}{j} double" for i in range(3) for j in range(3)))
    views = spark.createDataFrame([("a", "e", "side"), ("b", "e", "top")], "seq string, pair string, view string")
    got = {(r.t, r.track): (r.x, r.y) for r in boxes.view_positions(players, clips, maps, views).collect()}
    times = [0.5 * i for i in range(1, 7) if 0.5 * i <= 120 / 29.97 - 1]
    assert {t for t, _ in got} == set(times)  # a clip under a second and a half has no instant
    for t in times:
        f = round(t * 29.97) + 1
        assert got[t, 2] == pytest.approx(((20 + f + 2) / 2, 12.5))


def test_matched_distances_of_uneven_sides(spark):
    r = np.random.default_rng(2)
    rows = [("p", "side", 0.5, *map(float, r.normal(size=2))) for _ in range(4)] + [("p", "top", 0.5, *map(float, r.normal(size=2))) for _ in range(3)] + [("p", "side", 1.0, 0.0, 0.0)]
    got = boxes.cross_view(spark.createDataFrame(rows, "pair string, view string, t double, x double, y double"), "view", ("side", "top")).collect()
    assert [(x.t, x.n_a, x.n_b) for x in got] == [(0.5, 4, 3)]
    a, b = ([np.array(x[3:]) for x in rows if x[1] == v and x[2] == 0.5] for v in ("side", "top"))
    best = min((sorted(np.linalg.norm(a[i] - b[j]) for j, i in enumerate(p)) for p in itertools.permutations(range(4), 3)), key=sum)
    assert got[0].matched == pytest.approx(best[1])


def test_fit_prefers_the_nearer_of_equally_large_agreements():
    h = np.array([[0.01, 0.001, -5.3], [0.0005, 0.02, -3.015], [0.00001, 0.0004, 0.9997]])
    image = np.array([[x + dx, y + dy] for x, y in ((1865, 301), (1905, 301), (2187, 361), (2224, 341)) for dx in (0, 22) for dy in (20, 184)], float)
    q = np.c_[image, np.ones(len(image))] @ h.T
    pitch = q[:, :2] / q[:, 2:]
    pitch[5] += (40, -40)
    for seed in range(5):
        found, n = poses.fit(image, pitch, seed=seed)
        assert n == 15 and np.allclose(found, h / h[2, 2], atol=1e-6)
    assert poses.fit(image[:4], pitch[:4])[0] is None


def plain_greedy(values):
    """Digit after digit: the most frequent next character of what begins alike."""
    prefix = ""
    while True:
        going = Counter(v[len(prefix)] for v in values if v.startswith(prefix) and len(v) > len(prefix))
        if not going or sum(v == prefix for v in values) > max(going.values()):
            return float(prefix)
        prefix += min(c for c, n in going.items() if n == max(going.values()))


def test_prefix_greedy(spark):
    r = np.random.default_rng(9)
    groups = {f"g{k}": [f"{x:.1f}" for x in np.round(r.gamma(2, 3 + 20 * (k % 3), size=r.integers(1, 60)), 1)] for k in range(25)} | {"neg": ["-1.5", "-1.5", "12.0"], "ends": ["1.2", "1.2", "1.2", "1.25"]}
    rows = [(g, v, n) for g, vs in groups.items() for v, n in Counter(vs).items()]
    got = {x.g: x.greedy for x in paired.prefix_greedy(spark.createDataFrame(rows, "g string, v string, n long"), ["g"], "v", "n").collect()}
    assert got == {g: plain_greedy(vs) for g, vs in groups.items()}


def test_mcnemar_of_many_discordant_items(spark):
    cases = [(0, 0), (3, 9), (5, 5), (0, 40), (10_000_000, 10_001_500), (200, 100_000_000)]
    got = [r.p for r in spark.createDataFrame(cases, "b long, c long").coalesce(1).select(paired.mcnemar_p("b", "c").alias("p")).collect()]
    for (b, c), p in zip(cases[:4], got, strict=False):
        n, k = b + c, min(b, c)
        assert p == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n))
    z = (10_001_500 - 10_000_000 - 1) / math.sqrt(20_001_500)
    assert got[4] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3) and got[5] == 0.0


def test_noninferiority_verdict(spark):
    plan = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "a"), ("h2", "c"), ("h3", "a")], "hypothesis string, k string")
    cells = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "k string, rho double")
    reference = spark.createDataFrame([("a", 0.55), ("b", 0.3), ("c", 0.2)], "k string, rho double")
    got = {r.hypothesis: (r.cells, r.k, r.verdict) for r in rules.noninferiority_verdict(plan, cells, reference, ["k"]).collect()}
    assert got == {"h1": (2, 1, "fails"), "h2": (2, 1, "pending"), "h3": (1, 1, "holds")}
