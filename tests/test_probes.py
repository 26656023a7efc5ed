"""The nested probe against a plain restatement: a loop over folds, features, penalties and replicates with one solve each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import probes

PENALTIES = (0.5, 20.0, 500.0)


@pytest.fixture(scope="module")
def items():
    r = np.random.default_rng(6)
    out = []
    for cell in ("a", "b"):
        base = r.normal(size=(48, 5))
        y = base[:, 0] - 0.5 * base[:, 1] + 0.2 * r.normal(size=48)
        for i in range(48):
            for feature, vec in (("one", base[i, :3]), ("two", base[i, 2:]), ("noise", r.normal(size=4))):
                out.append((cell, feature, i, i % 2, i // 4, False, [float(x) for x in vec], float(y[i])))
                if i % 3 == 0:
                    out.append((cell, feature, i, i % 2, i // 4, True, [float(x) / 2 for x in vec], float(y[i])))
    return out


def solved(x, y, z, penalty):
    """Predictions of rows ``z`` by the primal normal equations."""
    m = y.mean()
    return z @ np.linalg.solve(x.T @ x + penalty * np.eye(x.shape[1]), x.T @ (y - m)) + m


def plain(rows, times):
    """{(rep, item, still): (feature, penalty, guess, y)} of one cell."""
    out = {}
    ids = sorted({r[2] for r in rows})
    info = {r[2]: r for r in rows}
    clip, grp, y = (np.array([info[i][k] for i in ids]) for k in (3, 4, 7))
    ys = probes.shuffled(y, clip, times)
    outer = probes.dealt(grp, probes.FOLDS, 1)
    feats = {}
    for f in ("noise", "one", "two"):
        own = {r[2]: r[6] for r in rows if r[1] == f and not r[5]}
        x = np.array([own[i] for i in ids])
        mean, sd = x.mean(0), x.std(0) + 1e-6
        feats[f] = ((x - mean) / sd, {r[2]: (np.array(r[6]) - mean) / sd for r in rows if r[1] == f and r[5]})
    for k in range(probes.FOLDS):
        tr, te = np.flatnonzero(outer != k), np.flatnonzero(outer == k)
        inner = probes.dealt(grp[tr], probes.FOLDS, 2 + k)
        for t in range(times + 1):
            best = None
            for f, (x, _) in feats.items():
                for penalty in PENALTIES:
                    guess = np.empty(len(tr))
                    for p in range(probes.FOLDS):
                        a, b = tr[inner != p], tr[inner == p]
                        guess[inner == p] = solved(x[a], ys[a, t], x[b], penalty)
                    r2 = 1 - ((guess - ys[tr, t]) ** 2).sum() / ((ys[tr, t] - ys[tr, t].mean()) ** 2).sum()
                    if best is None or r2 > best[0] + 1e-12:
                        best = (r2, f, penalty)
            _, f, penalty = best
            x, mirrors = feats[f]
            for i, g in zip(te, solved(x[tr], ys[tr, t], x[te], penalty), strict=True):
                out[t, ids[i], False] = (f, penalty, g, ys[i, t])
            if t == 0:
                for i in te:
                    if ids[i] in mirrors:
                        out[0, ids[i], True] = (f, penalty, solved(x[tr], ys[tr, 0], mirrors[ids[i]][None], penalty)[0], y[i])
    return out


def rho(a, b):
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    return np.corrcoef(ranks(np.array(a)), ranks(np.array(b)))[0, 1]


def test_nested_choice_predictions_and_null(spark, items):
    times = 6
    df = spark.createDataFrame(items, "cell string, feature string, item int, clip int, grp int, still boolean, vec array<double>, y double")
    predictions, summary = probes.nested_ridge(df, ["cell"], times, penalties=PENALTIES)
    got = {"a": {}, "b": {}}
    for r in predictions.collect():
        got[r.cell][r.rep, r.item, r.still] = (r.feature, r.penalty, r.guess, r.y)
    told = {r.cell: r for r in summary.collect()}
    for cell in "ab":
        want = plain([r for r in items if r[0] == cell], times)
        assert got[cell].keys() == want.keys()
        for k, (f, penalty, guess, y) in want.items():
            assert got[cell][k][:2] == (f, penalty) and got[cell][k][2:] == pytest.approx((guess, y), abs=1e-8)
        of = lambda rep, still, only=None: rho(*zip(*((w[2], w[3]) for k, w in want.items() if k[0] == rep and k[2] == still and (only is None or k[1] in only)), strict=True))  # noqa: B023, E731
        mirrored = {k[1] for k in want if k[2]}
        row = told[cell]
        assert row.n == 48 and row.rho == pytest.approx(of(0, False)) and row.rho_still == pytest.approx(of(0, True)) and row.rho_full == pytest.approx(of(0, False, mirrored))
        assert row.p99 == pytest.approx(np.percentile([of(t, False) for t in range(1, times + 1)], 99))
        assert row.holds == (row.rho >= 0.3 and row.rho > row.p99) and row.needs_motion == (row.rho_still <= row.rho_full - 0.3)


def test_permutations_stay_within_a_clip_and_groups_within_a_fold():
    clip, y = np.array([0, 1] * 20), np.arange(40.0)
    ys = probes.shuffled(y, clip, 3)
    for c in (0, 1):
        assert all(sorted(ys[clip == c, t]) == sorted(y[clip == c]) for t in range(4))
    assert (ys[:, 1] != y).any() and (ys[:, 1] != ys[:, 2]).any()
    grp = np.repeat(np.arange(13), 3)
    fold = probes.dealt(grp, 5, 1)
    assert all(len(set(fold[grp == g])) == 1 for g in range(13)) and set(fold) == set(range(5))


def test_one_group_or_a_constant_target_gives_no_correlation(spark):
    rows = [("c", "f", i, 0, 0, False, [float(i), 1.0], float(i)) for i in range(6)] + [("d", "f", i, 0, i, False, [float(i), 1.0], 2.0) for i in range(6)]
    df = spark.createDataFrame(rows, "cell string, feature string, item int, clip int, grp int, still boolean, vec array<double>, y double")
    _, summary = probes.nested_ridge(df, ["cell"], 2)
    got = {r.cell: r for r in summary.collect()}
    assert "c" not in got and got["d"].rho is None and not got["d"].holds
    assert probes.nested_ridge(df.where(F.lit(False)), ["cell"], 2)[1].count() == 0
