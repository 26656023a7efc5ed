"""Pools: held-out events, samples, summaries and consistency between families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .generate import hash_order
from .ranks import middle, quantiles


def lowest(items: DataFrame, group: list[str], order: list[Column], wanted: DataFrame, n: str) -> DataFrame:
    """Of each group the ``n`` items that come first in ``order`` (a hash, or keys that tell all items apart), ``n`` from ``wanted`` (group, n).

    A group may hold most of the items, so it is cut by a hash first: only the first ``n`` of each cut can be among the first
    of all, and only these are ranked together."""
    ordered = items.withColumns({f"_o{i}": c for i, c in enumerate(order)}).join(wanted.select(*group, F.col(n).alias("_want")), group)
    keys = [f"_o{i}" for i in range(len(order))]
    some = ordered.withColumn("_cut", F.pmod(F.xxhash64(*keys), F.lit(256)))
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_cut").orderBy(*keys))).where("_k <= _want")
    out = some.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*keys))).where("_k <= _want")
    return out.select(*items.columns)


def _all_groups(items: DataFrame, group: list[str], n: int) -> DataFrame:
    return items.select(*group).distinct().withColumn("_n", F.lit(n))


def event_holdout(items: DataFrame, held_out: DataFrame, event: str, frames: str = "frames", n_frames: int = 4, prefix: str = "") -> DataFrame:
    """Items with exactly ``n_frames`` frames whose event group isn't held out; ``prefix`` goes before the frames' names."""
    kept = items.where(F.size(frames) == n_frames).join(held_out.select(event).distinct(), event, "left_anti")
    return kept.withColumn(frames, F.transform(frames, lambda f: F.concat(F.lit(prefix), f.cast("string")))) if prefix else kept


def holdout_overlap(items: DataFrame, held_out: DataFrame, event: str) -> DataFrame:
    """(event): event groups of a pool that are held out; a pool with any is to be refused."""
    return items.select(event).distinct().join(held_out.select(event).distinct(), event, "left_semi")


def dev_clip(items: DataFrame, trained: DataFrame, clip: str, seq: str = "seq") -> DataFrame:
    """Items of one clip under the scoring keys (category, seq, track, f0, f1), empty if any pool trained on the clip."""
    own = items.where(F.col(seq) == clip).join(trained.select(seq).distinct(), seq, "left_anti")
    return own.select("category", seq, "track", "f0", "f1", "answer")


def select_per_stratum(items: DataFrame, stratum: list[str], key: str, n: int) -> DataFrame:
    """The first ``n`` items of each stratum by key."""
    return lowest(items, stratum, [F.col(key)], _all_groups(items, stratum, n), "_n")


def small_strata(items: DataFrame, stratum: list[str], least: int) -> DataFrame:
    """(stratum, n): strata with fewer than ``least`` items."""
    return items.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < least)


def evenly_spaced_pick(items: DataFrame, group: list[str], order: str, limit: int) -> DataFrame:
    """Of each group's n items in order, those at the places int(i n / limit).

    Places come from a range-partitioned sort: items before a partition plus those before in it, so no group is sorted in one task."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = items.repartitionByRange(parts, *group, order).withColumn("_p", F.spark_partition_id())
    ranked = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(order)) - 1)
    sizes = ranked.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*group)
    before = F.sum("_c").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    sizes = sizes.withColumn("_before", before).withColumn("_n", F.sum("_c").over(by)).drop("_c")
    r = ranked.join(sizes, [*group, "_p"]).withColumn("_i", F.col("_before") + F.col("_k"))
    # place p is picked iff some i has floor(i n / limit) = p, i < limit
    first = F.ceil(F.col("_i") * limit / F.col("_n"))
    picked = (F.col("_n") <= limit) | ((first < limit) & (F.floor(first * F.col("_n") / limit) == F.col("_i")))
    return r.where(picked).select(*items.columns)


def sample_fixed(items: DataFrame, group: list[str], keys: list[str], n: int, seed: str = "fixed") -> DataFrame:
    """``n`` items of each group in hash order."""
    return lowest(items, group, [hash_order(seed, *keys)], _all_groups(items, group, n), "_n")


def pool_stats(items: DataFrame, cell: list[str], answer: str) -> DataFrame:
    """(cell, n, median, digit, digit_share): size, median answer and the most frequent first digit (ties: the lowest)."""
    v = items.withColumn("_v", F.col(answer).cast("double")).withColumn("_d", F.substring(answer, 1, 1))
    digits = v.groupBy(*cell, "_d").agg(F.count(F.lit(1)).alias("c")).groupBy(*cell).agg(F.min_by("_d", F.struct((-F.col("c")).alias("c"), "_d")).alias("digit"), F.max("c").alias("_c"))
    g = v.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).join(quantiles(v, cell, {"median": ("_v", middle())}), cell, "left")
    return g.join(digits, cell).select(*cell, "n", "median", "digit", (F.col("_c") / F.col("n")).alias("digit_share"))


def quotable_ranges(cells: DataFrame, group: list[str], value: str, model: str = "model") -> DataFrame:
    """(group, live, degenerate, lo, hi): range over the cells with more than two answers; the others are counted apart. A model
    without a parsed answer in any of its cells isn't valid and left out."""
    valid = cells.groupBy(model).agg(F.sum("parsed").alias("_p")).where("_p > 0").select(model)
    live = ~F.col("degenerate") & F.col(value).isNotNull()
    at = F.when(live, F.col(value))
    return cells.join(valid, model, "left_semi").groupBy(*group).agg(F.count_if(live).alias("live"), F.count_if("degenerate").alias("degenerate"), F.min(at).alias("lo"), F.max(at).alias("hi"))


def live_units(cells: DataFrame, keys: list[str], arms: list[str], least: int = 3) -> DataFrame:
    """(keys, live): cells whose arms all have ``least`` different answers, so that a ratio of the arms says something."""
    seen = F.count_if((F.col("n_distinct") >= least) & F.col("arm").isin(arms))
    return cells.groupBy(*keys).agg((seen == len(arms)).alias("live"))


def speed_path_consistency(items: DataFrame, keys: list[str], cell: list[str], dur: str, value: str = "prediction", reference: str | None = None) -> DataFrame:
    """(cell, n, positive, median_s, share_consistent, share_nominal, changed, identity_error): speed and path answers of one trajectory:
    S = path / (dt speed) of positive speeds, consistent if they differ by at most 0.05 (1 + dt); the same with a nominal
    duration of 2 s, how often that changes the verdict, and how far the references are from path = dt speed."""
    side = lambda f, v: F.max(F.when(F.col("category") == f, F.col(v)))
    aggs = [side("speed", value).alias("s"), side("path", value).alias("p")]
    if reference:
        aggs += [side("speed", reference).alias("rs"), side("path", reference).alias("rp")]
    w = items.where("category in ('speed', 'path')").groupBy(*cell, *keys, dur).agg(*aggs).where("s is not null and p is not null")
    s = F.when(F.col("s") > 0, F.try_divide(F.col("p"), F.col(dur) * F.col("s")))
    ok = F.abs(F.col("p") - F.col(dur) * F.col("s")) <= 0.05 * (1 + F.col(dur)) + 1e-9
    nominal = F.abs(F.col("p") - 2.0 * F.col("s")) <= 0.15 + 1e-9
    error = F.max(F.abs(F.col("rp") - F.col(dur) * F.col("rs"))) if reference else F.lit(None).cast("double")
    g = w.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count(s).alias("positive"), F.avg(ok.cast("double")).alias("share_consistent"), F.avg(nominal.cast("double")).alias("share_nominal"), F.count_if(ok != nominal).alias("changed"), error.alias("identity_error"))
    return g.join(quantiles(w, cell, {"median_s": (s, middle())}), cell, "left")
