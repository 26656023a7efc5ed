"""Ranks, quantiles and the best constant of cells that are spread over all partitions, against plain restatements."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import ranks, stats


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    out = [("hot", float(x), float(y)) for x, y in r.normal(size=(4000, 2))]
    out += [("hot", 1.0, float(i)) for i in range(1500)]  # one value of over a quarter of the rows
    out += [("tied", float(i % 5), float(i % 3)) for i in range(100)] + [("one", 2.0, 3.0), ("void", None, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("flat", 1.0, 5.0)]
    return spark.createDataFrame(out, "cell string, x double, y double").repartition(7), out


def of(out, cell):
    return [(x, y) for c, x, y in out if c == cell and x is not None and y is not None]


def plain_ranks(v):
    order = sorted(v)
    first = {}
    for i, x in enumerate(order):
        first.setdefault(x, [i, i])[1] = i
    return [sum(first[x]) / 2 + 1 for x in v]


def test_running_sums_and_next_values(spark, rows):
    counts = rows[0].where("x is not null").groupBy("cell", "x").agg(F.count(F.lit(1)).alias("n"))
    got = ranks.running(counts, ["cell"], "x", "n", next_value=True)
    parts = got.select("_before").count()
    assert parts == counts.count()
    for cell in ("hot", "tied", "one"):
        seen = sorted((r.x, r.n, r._before, r._t, r._next) for r in got.where(F.col("cell") == cell).collect())
        values = sorted(x for x, _ in of(rows[1], cell))
        assert [s[0] for s in seen] == sorted(set(values)) and all(s[3] == len(values) for s in seen)
        assert [s[2] for s in seen] == list(np.cumsum([0] + [s[1] for s in seen])[:-1])
        assert [s[4] for s in seen] == [s[0] for s in seen][1:] + [None]


def test_a_hot_cell_is_in_many_partitions(spark, rows):
    counts = rows[0].where("x is not null").groupBy("cell", "x").agg(F.count(F.lit(1)).alias("n"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = counts.repartitionByRange("cell", "x").withColumn("p", F.spark_partition_id()).where("cell = 'hot'").groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(placed) >= 4 and max(r["count"] for r in placed) < 2000


def test_correlations(rows):
    got = {r.cell: r for r in stats.rank_correlations(rows[0], ["cell"], {"rho": ("x", "y")}).collect()}
    assert set(got) == {"hot", "tied", "one", "flat"} and got["one"].rho is None and got["flat"].rho is None
    for cell in ("hot", "tied"):
        x, y = zip(*of(rows[1], cell), strict=True)
        assert got[cell].n == len(x) and got[cell].rho == pytest.approx(np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1], abs=1e-12)


def test_weights_are_repetitions(spark, rows):
    weighted = rows[0].withColumn("w", 1 + F.pmod(F.xxhash64("x", "y"), F.lit(3)))
    repeated = weighted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "w")))
    one, two = (sorted(tuple(r) for r in d.collect()) for d in (stats.rank_correlations(weighted, ["cell"], {"rho": ("x", "y")}, "w"), stats.rank_correlations(repeated, ["cell"], {"rho": ("x", "y")})))
    assert [a[:2] for a in one] == [b[:2] for b in two] and all(a[2] == pytest.approx(b[2], abs=1e-12) for a, b in zip(one, two, strict=True))
    one, two = (sorted(tuple(r) for r in ranks.quantiles(d, ["cell"], {"m": ("x", ranks.middle())}, w).collect()) for d, w in ((weighted, "w"), (repeated, None)))
    assert one == two


def test_quantiles(rows):
    t = F.col("_t")
    wanted = {"median": ("x", ranks.middle()), "q1": ("x", ranks.linear(0.25)), "p99": ("y", ranks.linear(0.99)), "tenth": (F.col("x") + F.col("y"), ranks.index(F.floor(0.1 * t)))}
    got = {r.cell: r for r in ranks.quantiles(rows[0], ["cell"], wanted).collect()}
    for cell in ("hot", "tied", "one", "flat"):
        x, y = (np.array(v) for v in zip(*of(rows[1], cell), strict=True))
        r = got[cell]
        assert r.median == pytest.approx(statistics.median(x)) and r.q1 == pytest.approx(np.percentile(x, 25)) and r.p99 == pytest.approx(np.percentile(y, 99))
        assert r.tenth == pytest.approx(sorted(x + y)[math.floor(0.1 * len(x))])
    assert got["void"].median is None and got["void"].p99 == 1.0


def test_best_constant_of_one_large_cell(spark):
    r = np.random.default_rng(5)
    truth = np.r_[r.normal(5, 2, 700), np.full(60, 4.25)]
    df = spark.createDataFrame([("c", float(y), 0.05, 1.0) for y in truth], "cell string, reference_value double, score_tolerance double, score_floor double")
    got = stats.best_constant(df, ["cell"]).first()

    def score(c):
        relative = (np.abs(c - truth) - 0.05) / np.maximum(np.abs(truth), 1.0)
        return 10.0 * sum((relative < s).sum() for s in stats.fn.STEPS) / len(truth)

    assert got.tmra == pytest.approx(score(got.constant))
    assert got.tmra >= max(score(c) for c in np.linspace(0, 10, 4001)) - 1e-9
