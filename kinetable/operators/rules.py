"""Decision rules over tables of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_count_rule(cells: DataFrame, group: list[str], value: str, high: float, low: float, need: int, live: int) -> DataFrame:
    """(group, live, highs, lows, verdict): S if at least ``need`` live cells reach ``high``, N if as many stay at ``low`` or
    under; else limited with fewer than ``live`` live cells, I otherwise. Degenerate cells don't count; a group with an
    undefined cell is incomplete."""
    ok = ~F.col("degenerate")
    g = cells.groupBy(*group).agg(
        F.count_if(ok).alias("live"), F.count_if(ok & (F.col(value) >= high)).alias("highs"), F.count_if(ok & (F.col(value) <= low)).alias("lows"), F.count_if(F.col(value).isNull()).alias("_none")
    )
    verdict = F.when(F.col("_none") > 0, "incomplete").when(F.col("highs") >= need, "S").when(F.col("lows") >= need, "N").when(F.col("live") < live, "limited").otherwise("I")
    return g.withColumn("verdict", verdict).drop("_none")


def replication_rule(cells: DataFrame, group: list[str], degenerate: Column, passes: Column, fails: Column, need: int = 3) -> DataFrame:
    """(group, live, passed, failed, verdict): of the cells that aren't degenerate ``need`` must pass (replicates) or fail
    (fails), else it is intermediate; LIMITED with fewer than ``need`` live cells."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    live = ~sure(degenerate)
    g = cells.groupBy(*group).agg(F.count_if(live).alias("live"), F.count_if(live & sure(passes)).alias("passed"), F.count_if(live & sure(fails)).alias("failed"))
    return g.withColumn("verdict", F.when(F.col("live") < need, "LIMITED").when(F.col("passed") >= need, "replicates").when(F.col("failed") >= need, "fails").otherwise("intermediate"))


def arithmetic_rule(contrasts: DataFrame, group: list[str], arm: str, tuned: str, mixed: str, alpha: float = 0.01) -> DataFrame:
    """(group, verdict) from (group, arm, only_arm, only_base, p): replicates if the tuned arm is significantly below the base and
    the mixed one isn't, fails if the tuned one isn't, else intermediate."""
    below = (F.col("only_base") > F.col("only_arm")) & (F.col("p") < alpha)
    at = lambda a: F.bool_or(F.when(F.col(arm) == a, below))
    g = contrasts.groupBy(*group).agg(at(tuned).alias("_t"), at(mixed).alias("_m"))
    return g.select(*group, F.when(~F.col("_t"), "fails").when(~F.col("_m"), "replicates").otherwise("intermediate").alias("verdict"))


def seed_label(verdicts: DataFrame, group: list[str], verdict: str, seeds: int = 3) -> DataFrame:
    """(group, label) over the seeds of a rule from its verdicts replicates, fails and others."""
    count = lambda v: F.count_if(F.col(verdict) == v)
    g = verdicts.groupBy(*group).agg(F.count(verdict).alias("n"), count("replicates").alias("r"), count("fails").alias("f"))
    label = (
        F.when(F.col("n") < seeds, "pending").when(F.col("r") == seeds, "holds at all three seeds").when((F.col("r") == 2) & (F.col("f") == 0), "holds at two of three seeds")
        .when((F.col("f") >= 2) & (F.col("r") == 0), "fails across seeds").when((F.col("r") >= 1) & (F.col("f") >= 1), "seed-dependent").otherwise("not established")
    )
    return g.select(*group, label.alias("label"))


def converts(cells: DataFrame) -> DataFrame:
    """``cells`` (parse_rate, degenerate, rho, ratio, factor) with whether a cell converts units, by the narrow and the
    registered band around its factor."""
    base = (F.col("parse_rate") >= 0.5) & ~F.col("degenerate") & F.coalesce(F.col("rho") >= 0.30, F.lit(False))
    r, f = F.col("ratio"), F.col("factor")
    inside = lambda k: base & F.coalesce(r.between(f / k, f * k), F.lit(False))
    return cells.withColumn("converts", inside(1.5)).withColumn("converts_registered", inside(2.0))


def hypotheses(plan: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """(hypothesis, cells, k, verdict): how many required cells convert. ``plan``: (hypothesis, need, fail_max, keys), one row a
    required cell; a hypothesis with a cell that isn't in ``cells`` (keys, converts) is pending."""
    g = plan.join(cells.select(*keys, "converts"), keys, "left").groupBy("hypothesis", "need", "fail_max")
    g = g.agg(F.count(F.lit(1)).alias("cells"), F.count_if("converts").alias("k"), F.count_if(F.col("converts").isNull()).alias("absent"))
    verdict = F.when(F.col("absent") > 0, "pending").when(F.col("k") >= F.col("need"), "holds").when(F.col("k") <= F.col("fail_max"), "fails").otherwise("intermediate")
    return g.select("hypothesis", "cells", "k", verdict.alias("verdict"))


def noninferiority(cells: DataFrame, reference: DataFrame, keys: list[str], margin: float = 0.10) -> DataFrame:
    """(keys, rho, reference_rho, ok): correlations at most ``margin`` under those of a reference; false where either is undefined."""
    j = cells.select(*keys, "rho").join(reference.select(*keys, F.col("rho").alias("reference_rho")), keys)
    return j.withColumn("ok", F.coalesce(F.col("rho") >= F.col("reference_rho") - margin, F.lit(False)))


def noninferiority_verdict(plan: DataFrame, cells: DataFrame, reference: DataFrame, keys: list[str], margin: float = 0.10) -> DataFrame:
    """(hypothesis, cells, k, verdict): whether a hypothesis holds in all of its cells, one row of ``plan`` (hypothesis, keys) each; fails if one is
    inferior, pending while one is absent from either side."""
    judged = noninferiority(cells, reference, keys, margin).select(*keys, "ok")
    g = plan.join(judged, keys, "left").groupBy("hypothesis").agg(F.count(F.lit(1)).alias("cells"), F.count_if("ok").alias("k"), F.count_if(F.col("ok").isNull()).alias("_absent"))
    return g.select("hypothesis", "cells", "k", F.when(F.col("_absent") > 0, "pending").when(F.col("k") == F.col("cells"), "holds").otherwise("fails").alias("verdict"))


def label_verdict(spread: DataFrame, cell: list[str], pool: str, new: str, old: str) -> DataFrame:
    """(cell, old_mean, new_mean, difference, widest_range, exceeds) from seed spreads (cell, pool, mean, range): whether the two
    pools' means differ by more than the wider range of seeds."""
    at = lambda p, v: F.max(F.when(F.col(pool) == p, F.col(v)))
    g = spread.groupBy(*cell).agg(at(old, "mean").alias("old_mean"), at(new, "mean").alias("new_mean"), at(old, "range").alias("_o"), at(new, "range").alias("_n")).where("_o is not null and _n is not null")
    g = g.withColumn("difference", F.col("new_mean") - F.col("old_mean")).withColumn("widest_range", F.greatest("_o", "_n")).drop("_o", "_n")
    return g.withColumn("exceeds", F.abs("difference") > F.col("widest_range"))


def motion_rule(cells: DataFrame, group: list[str], delta: str, distinct: str, expected: int, need: int = 3) -> DataFrame:
    """(group, cells, defined, positive, verdict): whether answers depend on motion. Pending with fewer cells than expected; only cells with more
    than two answers and a difference count; LIMITED under ``need`` of them, holds if as many are positive, else fails."""
    ok = F.col(delta).isNotNull() & (F.col(distinct) > 2)
    g = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("cells"), F.count_if(ok).alias("defined"), F.count_if(ok & (F.col(delta) > 0)).alias("positive"))
    return g.withColumn("verdict", F.when(F.col("cells") < expected, "pending").when(F.col("defined") < need, "LIMITED").when(F.col("positive") >= need, "holds").otherwise("fails"))


def graded_rule(cells: DataFrame, group: list[str], expected: int = 2) -> DataFrame:
    """(group, k, verdict) of cells (converts): fixed if all convert, partial if some do, else not fixed; pending if one is absent."""
    g = cells.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count_if("converts").alias("k"))
    return g.select(*group, "k", F.when(F.col("_n") < expected, "pending").when(F.col("k") == expected, "fixed").when(F.col("k") > 0, "partial").otherwise("not fixed").alias("verdict"))
