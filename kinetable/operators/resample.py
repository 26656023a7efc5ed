"""Bootstrap intervals over clusters. Draws come from integer arithmetic, so that any engine repeats them.

A cell is first reduced to counts of distinct (cluster, values). Cells with up to ``LIMIT`` of them are resampled in numpy, replicates being
dealt in blocks, each a task of its own. Of larger cells nothing is gathered: each replicate is a cell of its own, its rows weighted by
how often their cluster was drawn, and the distributed statistics of ``stats`` and ``ranks`` take (cell, replicate) as their cell. Both
ways use the same draws and give the same results."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..functions.answers import STEPS
from ..sources.shared import settled
from .ranks import middle, quantiles, running
from .stats import partial_spearman, spearman

#: Replicates; the index picks of the interval are those of 2.5 % and 97.5 % of the defined ones, of which 90 % are needed.
B = 2000
BLOCK = 250
#: Replicates of a binomial share.
BINOMIAL = 1000
#: Distinct (cluster, values) of a cell up to which its replicates are made in one task each block.
LIMIT = 1 << 20
#: Draws that are listed at a time.
_RUN = 1 << 16
_MOD = 1 << 32
#: Factor of the mixing of trials; below 2^31, so that products fit signed longs.
_MIX = 73244475


def draw_sql(rep: str, draw: str) -> str:
    """A number in [0, 2^32) of replicate and draw, as SQL; ``uniform`` is the same in numpy."""
    h = f"(({rep} * 2654435761 + {draw} * 40503 + 12345) % {_MOD})"
    h = f"(({h} * 1664525 + 1013904223) % {_MOD})"
    h = f"(CAST(floor({h} / 65536) AS BIGINT) + ({h} % 65536) * 65536)"
    return f"(({h} * 22695477 + 1) % {_MOD})"


def uniform(rep: np.ndarray, draw: np.ndarray) -> np.ndarray:
    h = (rep.astype(np.uint64) * np.uint64(2654435761) + draw.astype(np.uint64) * np.uint64(40503) + np.uint64(12345)) % np.uint64(_MOD)
    h = (h * np.uint64(1664525) + np.uint64(1013904223)) % np.uint64(_MOD)
    h = h // np.uint64(65536) + (h % np.uint64(65536)) * np.uint64(65536)
    return (h * np.uint64(22695477) + np.uint64(1)) % np.uint64(_MOD)


def trials_sql(source: str) -> str:
    """``source`` (rep, draw from 0, ...) with h, a number in [0, 2^32) of replicate and trial, as SQL; ``trials`` is the same in numpy. Along the
    draws of one replicate ``draw_sql`` is a lattice, so that counts of trials would not vary as chance does (0.15 of the binomial deviation at
    3,750 trials, 1.4 at 20)."""

    def mixed(s: str) -> str:
        for _ in range(2):
            s = f"SELECT * REPLACE (xor(h, h >> 16) * {_MIX} % {_MOD} AS h) FROM ({s})"
        return f"SELECT * REPLACE (xor(h, h >> 16) AS h) FROM ({s})"

    inner = mixed(f"SELECT *, draw % {_MOD} AS h FROM {source}")
    return mixed(f"SELECT * REPLACE ((h + rep * 2654435761 + (draw >> 32) * 40503) % {_MOD} AS h) FROM ({inner})")


def _mixed(h: np.ndarray) -> np.ndarray:
    for _ in range(2):
        h = (h ^ (h >> np.uint32(16))) * np.uint32(_MIX)
    return h ^ (h >> np.uint32(16))


def trials(rep: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Rows of replicates, columns of draws."""
    rep, draw = rep.astype(np.uint64), draw.astype(np.uint64)
    low = lambda x: (x & np.uint64(_MOD - 1)).astype(np.uint32)
    at = _mixed(low(draw)) + low(draw >> np.uint64(32)) * np.uint32(40503)
    return _mixed(at + low(rep * np.uint64(2654435761))[:, None])


# --- statistics of weighted rows: (columns as arrays, weights) -> number or None ------------------------------------------


def _ranks(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Average ranks of values that occur ``w`` times each."""
    _, which = np.unique(x, return_inverse=True)
    total = np.bincount(which, w)
    return (np.cumsum(total) - total + (total + 1) / 2)[which]


def weighted_rho(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float | None:
    ok = (w > 0) & ~np.isnan(x) & ~np.isnan(y)
    x, y, w = x[ok], y[ok], w[ok]
    if w.sum() < 3:
        return None
    a, b, n = _ranks(x, w), _ranks(y, w), w.sum()
    a, b = a - (w * a).sum() / n, b - (w * b).sum() / n
    below = (w * a * a).sum() * (w * b * b).sum()
    return float((w * a * b).sum() / np.sqrt(below)) if below > 1e-9 else None


def weighted_median(x: np.ndarray, w: np.ndarray) -> float | None:
    ok = (w > 0) & ~np.isnan(x)
    x, w = x[ok], w[ok]
    if not len(x):
        return None
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(w[order])
    at = np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right")
    return float(x[order][at].mean())


def _score(p: np.ndarray, y: np.ndarray, t: np.ndarray, e: np.ndarray) -> np.ndarray:
    relative = (np.abs(p - y) - t) / np.maximum(np.abs(y), e)
    return np.where(np.isnan(p), 0.0, 10.0 * sum((relative < s).astype(float) for s in STEPS))


def mean(v: dict, w: np.ndarray) -> float | None:
    """Mean of ``value``, a missing one counting as 0."""
    return float((w * np.nan_to_num(v["value"])).sum() / w.sum()) if w.sum() else None


def rho(v: dict, w: np.ndarray) -> float | None:
    """Rank correlation of ``prediction`` and ``reference_value``."""
    return weighted_rho(v["prediction"], v["reference_value"], w)


def median(v: dict, w: np.ndarray) -> float | None:
    """Median of ``value``."""
    return weighted_median(v["value"], w)


def ratio(v: dict, w: np.ndarray) -> float | None:
    """Median of numerator over denominator where both are parsed and the denominator is positive."""
    ok = ~np.isnan(v["numerator"]) & (np.nan_to_num(v["denominator"]) > 0)
    return weighted_median(np.where(ok, v["numerator"], np.nan) / np.where(ok, v["denominator"], 1.0), w)


def delta_rho(v: dict, w: np.ndarray) -> float | None:
    """Difference of the rank correlations of two arms, each on its own parsed items."""
    a, b = weighted_rho(v["prediction"], v["reference_value"], w), weighted_rho(v["other"], v["other_reference"], w)
    return None if a is None or b is None else a - b


def common_delta_rho(v: dict, w: np.ndarray) -> float | None:
    """The same on the items parsed in both arms."""
    both = np.where(np.isnan(v["prediction"]) | np.isnan(v["other"]), 0, w)
    return delta_rho(v, both)


def margin(v: dict, w: np.ndarray) -> float | None:
    """Mean score less that of always answering the median truth, over parsed items."""
    ok = ~np.isnan(v["prediction"]) & (w > 0)
    if not ok.any():
        return None
    y, t, e, u = v["reference_value"][ok], v["score_tolerance"][ok], v["score_floor"][ok], w[ok]
    best = weighted_median(y, u)
    own, constant = (float((u * _score(p, y, t, e)).sum() / u.sum()) for p in (v["prediction"][ok], np.full(len(y), best)))
    return own - constant


def partial_rho(v: dict, w: np.ndarray) -> float | None:
    """Rank correlation of prediction and truth given ``covariate``."""
    ok = ~np.isnan(v["prediction"]) & ~np.isnan(v["reference_value"]) & ~np.isnan(v["covariate"]) & (w > 0)
    if w[ok].sum() < 4:
        return None
    x, y, z = (v[c][ok] for c in ("prediction", "reference_value", "covariate"))
    xy, xz, yz = weighted_rho(x, y, w[ok]), weighted_rho(x, z, w[ok]) or 0.0, weighted_rho(y, z, w[ok]) or 0.0
    rest = (1 - xz * xz) * (1 - yz * yz)
    return None if xy is None or rest <= 1e-12 else float((xy - xz * yz) / np.sqrt(rest))


# --- the same of many replicates at once: (columns as arrays, weights (replicates, rows)) -> numbers, NaN for None ---------


def _many_ranks(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    values, which = np.unique(x, return_inverse=True)
    order = np.argsort(which, kind="stable")
    total = np.add.reduceat(w[:, order], np.searchsorted(which[order], np.arange(len(values))), axis=1)
    return (np.cumsum(total, 1) - total + (total + 1) / 2)[:, which]


def many_rho(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``weighted_rho`` of values without NaN."""
    n, sums = w.sum(1), lambda *of: np.einsum(",".join(["ij"] * len(of)) + "->i", *of)
    with np.errstate(all="ignore"):
        a, b = (r - (sums(w, r) / n)[:, None] for r in (_many_ranks(x, w), _many_ranks(y, w)))
        below = sums(w, a, a) * sums(w, b, b)
        return np.where((n >= 3) & (below > 1e-9), sums(w, a, b) / np.sqrt(below), np.nan)


def many_partial_rho(v: dict, w: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(v["prediction"]) & ~np.isnan(v["reference_value"]) & ~np.isnan(v["covariate"])
    if not ok.any():
        return np.full(len(w), np.nan)
    (x, y, z), w = (v[c][ok] for c in ("prediction", "reference_value", "covariate")), w[:, ok]
    xy, xz, yz = many_rho(x, y, w), np.nan_to_num(many_rho(x, z, w)), np.nan_to_num(many_rho(y, z, w))
    rest = (1 - xz * xz) * (1 - yz * yz)
    with np.errstate(all="ignore"):
        return np.where((w.sum(1) >= 4) & (rest > 1e-12), (xy - xz * yz) / np.sqrt(rest), np.nan)


_MANY = {partial_rho: many_partial_rho}
#: Weights that are held at a time.
_WEIGHTS = 1 << 19


# --- the same of rows weighted by _n, as (cell, v), for cells of any size ---------------------------------------------------


def _spread_mean(rows: DataFrame, cell: list[str]) -> DataFrame:
    return rows.groupBy(*cell).agg((F.sum(F.col("_n") * F.coalesce("value", F.lit(0.0))) / F.sum("_n")).alias("v"))


def _spread_rho(rows: DataFrame, cell: list[str]) -> DataFrame:
    return _weighted_rho(rows, cell, "prediction", "reference_value", "v")


def _weighted_rho(rows: DataFrame, cell: list[str], x: str, y: str, name: str) -> DataFrame:
    return spearman(rows, cell, x, y, "_n").select(*cell, F.col("rho").alias(name))


def _spread_median(rows: DataFrame, cell: list[str]) -> DataFrame:
    return quantiles(rows, cell, {"v": ("value", middle())}, "_n")


def _spread_ratio(rows: DataFrame, cell: list[str]) -> DataFrame:
    return quantiles(rows, cell, {"v": (F.when(F.col("denominator") > 0, F.try_divide("numerator", "denominator")), middle())}, "_n")


def _spread_delta_rho(rows: DataFrame, cell: list[str]) -> DataFrame:
    a, b = _weighted_rho(rows, cell, "prediction", "reference_value", "a"), _weighted_rho(rows, cell, "other", "other_reference", "b")
    return a.join(b, cell).select(*cell, (F.col("a") - F.col("b")).alias("v"))


def _spread_common(rows: DataFrame, cell: list[str]) -> DataFrame:
    return _spread_delta_rho(rows.where("prediction is not null and other is not null"), cell)


def _spread_margin(rows: DataFrame, cell: list[str]) -> DataFrame:
    parsed = rows.where("prediction is not null")
    best = quantiles(parsed, cell, {"best": ("reference_value", middle())}, "_n")
    score = lambda p: F.sum(F.col("_n") * F.coalesce(fn.tmra_scaled(F.col(p), F.col("reference_value"), F.col("score_tolerance"), F.col("score_floor")), F.lit(0.0)))
    return parsed.join(best, cell).groupBy(*cell).agg(((score("prediction") - score("best")) / F.sum("_n")).alias("v"))


def _spread_partial(rows: DataFrame, cell: list[str]) -> DataFrame:
    return partial_spearman(rows, cell, "prediction", "reference_value", "covariate", "_n").select(*cell, F.col("partial").alias("v"))


_SPREAD = {mean: _spread_mean, rho: _spread_rho, median: _spread_median, ratio: _spread_ratio, delta_rho: _spread_delta_rho, common_delta_rho: _spread_common, margin: _spread_margin, partial_rho: _spread_partial}


# --- resampling -------------------------------------------------------------------------------------------------------------


def _intervals(reps: DataFrame, cell: list[str], b: int) -> DataFrame:
    """(cell, point, lo, hi, defined) from (cell, rep, v), rep 0 being the point."""
    g = reps.groupBy(*cell).agg(F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("point"), F.max("clusters").alias("clusters"), F.sort_array(F.collect_list(F.when(F.col("rep") > 0, F.col("v")))).alias("_vs"))
    n = F.size("_vs")
    pick = lambda k: F.when(n >= 0.9 * b, F.get("_vs", k.cast("int")))
    return g.select(*cell, "clusters", "point", pick(F.floor(0.025 * n)).alias("lo"), pick(F.floor(0.975 * n) - 1).alias("hi"), n.alias("defined"))


def _replicates(counts: DataFrame, cell: list[str], values: list[str], stat: Callable, b: int) -> DataFrame:
    """(cell, rep, clusters, v) of cells that a task can hold."""
    blocks = counts.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-b // BLOCK) - 1))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = {c: part[c].to_numpy(float) for c in values}
        times, (_, which) = part["_n"].to_numpy(), np.unique(part["_cluster"].to_numpy(), return_inverse=True)
        block, clusters = int(part["_block"].iloc[0]), int(which.max()) + 1
        out = [(0, stat(v, times))] if block == 0 else []
        if stat in _MANY:
            reps = np.arange(block * BLOCK + 1, min((block + 1) * BLOCK, b) + 1)
            step = max(1, _WEIGHTS // len(part))
            for some in (reps[i : i + step] for i in range(0, len(reps), step)):
                drawn = (uniform(some[:, None], np.arange(1, clusters + 1)[None]) * np.uint64(clusters) >> np.uint64(32)).astype(np.int64)
                drawn += np.arange(len(some))[:, None] * clusters
                often = np.bincount(drawn.ravel(), minlength=len(some) * clusters).reshape(len(some), clusters)
                out += zip(some, _MANY[stat](v, (often[:, which] * times).astype(float)), strict=True)
        for rep in range(block * BLOCK + 1, min((block + 1) * BLOCK, b) + 1) if stat not in _MANY else ():
            drawn = uniform(np.full(clusters, rep), np.arange(1, clusters + 1)) * np.uint64(clusters) >> np.uint64(32)
            out.append((rep, stat(v, times * np.bincount(drawn.astype(np.int64), minlength=clusters)[which])))
        first = {c: part[c].iloc[0] for c in cell}
        return pd.DataFrame({**{c: [x] * len(out) for c, x in first.items()}, "rep": [r for r, _ in out], "clusters": clusters, "v": [x for _, x in out]}).astype({"v": float})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.select(*cell).schema)
    return blocks.groupBy(*cell, "_block").applyInPandas(run, f"{schema}, rep int, clusters long, v double")


def _spread_replicates(counts: DataFrame, cell: list[str], stat: Callable, b: int) -> DataFrame:
    """The same of cells that nobody holds: clusters are numbered in their order, each draw is a row, and the rows of a drawn cluster enter
    the replicate as often as it was drawn."""
    ids = running(counts.select(*cell, "_cluster").distinct().withColumn("_one", F.lit(1)), cell, "_cluster", "_one")
    ids = settled(ids.select(*cell, "_cluster", F.col("_before").alias("_j"), F.col("_t").alias("clusters")))
    size = ids.groupBy(*cell).agg(F.max("clusters").alias("clusters")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(b))))
    runs = size.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("clusters") - 1) / _RUN))))
    last = F.least(F.col("clusters"), (F.col("_run") + 1) * _RUN)
    draws = runs.repartition(*cell, "rep", "_run").select(*cell, "clusters", "rep", F.explode(F.sequence(F.col("_run") * _RUN + 1, last)).alias("_d"))
    drawn = draws.select(*cell, "rep", F.shiftrightunsigned(_draw(F.col("rep"), F.col("_d")) * F.col("clusters"), 32).alias("_j"))
    used = drawn.groupBy(*cell, "rep", "_j").agg(F.count(F.lit(1)).alias("_times")).unionByName(ids.select(*cell, F.lit(0).alias("rep"), "_j", F.lit(1).cast("long").alias("_times")))
    rows = counts.join(ids, [*cell, "_cluster"]).join(used, [*cell, "_j"]).withColumn("_n", F.col("_n") * F.col("_times")).drop("_times")
    found = _SPREAD[stat](rows, [*cell, "rep"])
    every = size.select(*cell, "clusters", "rep").unionByName(ids.groupBy(*cell).agg(F.max("clusters").alias("clusters")).withColumn("rep", F.lit(0)))
    return every.join(found, [*cell, "rep"], "left").select(*cell, "rep", "clusters", "v")


def bootstrap(rows: DataFrame, cell: list[str], cluster: str, values: list[str], stat: Callable, b: int = B, limit: int = LIMIT) -> DataFrame:
    """(cell, clusters, point, lo, hi, defined): whole clusters are drawn with replacement ``b`` times; ``stat`` is one of the statistics above
    and takes the columns ``values``. The interval is null if under 90 % of the replicates are defined."""
    counts = rows.groupBy(*cell, F.col(cluster).alias("_cluster"), *(F.col(v).cast("double").alias(v) for v in values)).agg(F.count(F.lit(1)).alias("_n"))
    counts = settled(counts)
    large = counts.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).select(*cell)
    if large.isEmpty():
        reps = _replicates(counts, cell, values, stat, b)
    else:
        reps = _replicates(counts.join(large, cell, "left_anti"), cell, values, stat, b).unionByName(_spread_replicates(counts.join(large, cell, "left_semi"), cell, stat, b))
    return _intervals(reps.withColumn("v", F.when(~F.isnan("v"), F.col("v"))), cell, b)


def bootstrap_items(rows: DataFrame, cell: list[str], item: str, values: list[str], stat: Callable, b: int = B) -> DataFrame:
    """Every item is its own cluster."""
    return bootstrap(rows, cell, item, values, stat, b)


def time_block(f0: Column, fps: Column, seconds: int) -> Column:
    """Cluster of windows by the seconds in which they start."""
    return F.floor(f0 / fps / seconds)


def binomial_quantile(u: float, n: int, k: int) -> int:
    """The smallest number of successes whose cumulative probability of ``n`` trials with share k / n is at least ``u``. Probabilities are
    built from the mode outwards; beyond 40 standard deviations none is left, so this costs the square root of n."""
    if k <= 0 or k >= n:
        return max(0, min(k, n))
    p = k / n
    reach = int(40 * np.sqrt(n * p * (1 - p))) + 10
    low, high = max(0, k - reach), min(n, k + reach)
    x = np.arange(low, high)
    steps = np.log((n - x) / (x + 1)) + np.log(p / (1 - p))  # of the logarithm from x to x + 1
    mass = np.r_[0.0, np.cumsum(steps)]
    mass = np.exp(mass - mass.max())
    upto = np.cumsum(mass) / mass.sum()
    return low + int(np.searchsorted(upto, u, "left"))


def _wins(rep: np.ndarray, first: int, last: int, share: float) -> np.ndarray:
    """How many of the trials ``first`` to ``last`` (left out) of each replicate succeed; a few thousand are drawn at a time."""
    won, most = np.zeros(len(rep), np.int64), 1 << 14
    for at in range(first, last, most):
        draw = np.arange(at, min(last, at + most))
        step = max(1, most // len(draw))
        for r in range(0, len(rep), step):
            won[r : r + step] += np.count_nonzero(trials(rep[r : r + step], draw) < share * _MOD, axis=1)
    return won


def binomial_bootstrap(rows: DataFrame, cell: list[str], k: str, n: str, b: int = BINOMIAL) -> DataFrame:
    """(cell, n, share, lo, hi): index-picked interval of a share k of n from ``b`` binomial replicates, each the share of successes among n drawn
    trials. ``rows`` has one row a cell; no trials, no row; a null k has no interval. Trials are drawn in runs, replicates in blocks, each (cell,
    block, run) a row of its own, so that the trials of a large cell are spread over tasks."""
    cells = rows.where(F.col(n) > 0).select(*cell, F.col(n).alias("n"), F.try_divide(k, n).alias("share"))
    runs = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-b // BLOCK) - 1)))).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    # A number of partitions is given because rows are few and small for their work, and would be put together in one task.
    dealt = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell, "_block", "_run")

    @F.pandas_udf("array<long>")
    def wins(block: pd.Series, run: pd.Series, n: pd.Series, share: pd.Series) -> pd.Series:
        reps = [np.arange(x * BLOCK + 1, min((x + 1) * BLOCK, b) + 1) for x in block]
        return pd.Series([_wins(r, x * _RUN, min(int(y), (x + 1) * _RUN), z) for r, x, y, z in zip(reps, run, n, share, strict=True)])

    won = dealt.select(*cell, "n", "share", "_block", F.posexplode(wins("_block", "_run", "n", "share")).alias("_place", "_won"))
    reps = won.groupBy(*cell, "n", "share", "_block", "_place").agg(F.sum("_won").alias("_won"))
    g = reps.groupBy(*cell, "n", "share").agg(F.sort_array(F.collect_list("_won")).alias("_vs"))
    pick = lambda at: F.when(F.col("share").isNotNull(), F.get("_vs", F.lit(at)) / F.col("n"))
    return g.select(*cell, "n", "share", pick(int(0.025 * b)).alias("lo"), pick(int(0.975 * b) - 1).alias("hi"))


def _draw(rep: Column, draw: Column) -> Column:
    h = (rep.cast("long") * 2654435761 + draw.cast("long") * 40503 + 12345) % _MOD
    h = (h * 1664525 + 1013904223) % _MOD
    h = F.floor(h / 65536).cast("long") + (h % 65536) * 65536
    return (h * 22695477 + 1) % _MOD
