"""Audits and data contracts: each returns violations or counts, one shuffle a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import middle, quantiles


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_isolation(df: DataFrame, scene: list[str], split: str) -> DataFrame:
    """(scene, splits): scenes that appear in more than one split; the sets hold split names only, so they stay tiny."""
    return df.groupBy(*scene).agg(F.array_sort(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1).select(*scene, F.array_join("_s", ",").alias("splits"))


def coordinate_overlap(markers: DataFrame, split: str, x: str, y: str, places: int = 8) -> DataFrame:
    """(x, y, splits): coordinates, equal after rounding, that several splits share."""
    rounded = markers.select(split, F.bround(x, places).alias("x"), F.bround(y, places).alias("y"))
    return split_isolation(rounded, ["x", "y"], split)


def letter_balance(qa: DataFrame, cell: list[str], answer: str, most: float = 0.6, least_n: int = 10) -> DataFrame:
    """(cell, n, share, ok): the largest share of one answer letter; only A and B are letters, and small cells pass."""
    letters = qa.where(F.col(answer).isin("A", "B")).groupBy(*cell, answer).agg(F.count(F.lit(1)).alias("c"))
    g = letters.groupBy(*cell).agg(F.sum("c").alias("n"), (F.max("c") / F.sum("c")).alias("share"))
    return g.withColumn("ok", (F.col("n") < least_n) | (F.col("share") <= most))


def audit_pairs(items: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair_id, reason): pairs that aren't two rows of the same text with the answers A and B and disjoint windows without a common
    frame. ``items``: (pair_id, answer, question, f0, f1, frames if there are any)."""
    frames = [F.count_distinct("_f").alias("seen"), F.count("_f").alias("shown")] if "frames" in items.columns else []
    g = items.groupBy(pair).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("answer").isin("A", "B"), F.col("answer"))).alias("answers"), F.count_distinct("question").alias("texts"), F.max("f0").alias("later"), F.min("f1").alias("sooner")
    )
    reason = F.when(F.col("n") != 2, "rows").when(F.col("answers") != 2, "answers").when(F.col("texts") != 1, "text").when(F.col("later") <= F.col("sooner"), "windows")
    if frames:
        g = g.join(items.select(pair, F.explode("frames").alias("_f")).groupBy(pair).agg(*frames), pair, "left")
        reason = reason.when(F.col("seen") < F.col("shown"), "frames")
    return g.select(pair, reason.alias("reason")).where("reason is not null")


def audit_pool(items: DataFrame) -> DataFrame:
    """(problem, n) of a pool of pairs: how far the letters are from balance, and (image_id, question) keys that repeat."""
    sides = items.agg(F.abs(F.count_if(F.col("answer") == "A") - F.count_if(F.col("answer") != "A")).alias("n")).withColumn("problem", F.lit("balance"))
    repeats = duplicate_keys(items, ["image_id", "question"]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).withColumn("problem", F.lit("repeated"))
    return sides.unionByName(repeats).select("problem", F.col("n").cast("long").alias("n"))


def confound_check(items: DataFrame, answer: str, value: str) -> DataFrame:
    """(answer, n, mean, median): whether a value that shouldn't matter differs between the answers."""
    g = items.groupBy(answer).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return g.join(quantiles(items, [answer], {"median": (value, middle())}), answer, "left")


def audit_pool_pair(left: DataFrame, right: DataFrame, keys: list[str], fixed: list[str], answer: str, groups: DataFrame, held_out: DataFrame) -> DataFrame:
    """(problem, n) of two pools that may only differ in their answers: rows without a partner, rows with another fixed field, changed
    answers (a count, not a fault), and rows of held-out event groups. ``groups``: (seq, event)."""
    a, b = left.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in [*fixed, answer]), F.lit(True).alias("_a")), right.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in [*fixed, answer]), F.lit(True).alias("_b"))
    j = a.join(b, keys, "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    counts = j.agg(F.count_if(~both).alias("unpaired"), F.count_if(both & ~same).alias("differs"), F.count_if(both & ~F.col(f"_a_{answer}").eqNullSafe(F.col(f"_b_{answer}"))).alias("changed"))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in ("unpaired", "differs", "changed")))).alias("x")).select("x.*")
    held = left.unionByName(right, allowMissingColumns=True).join(groups, "seq").join(held_out, "event", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(held.select(F.lit("held_out").alias("problem"), "n"))


def reconcile(computed: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """(keys, computed, published, ok): recomputed numbers beside a stored table, also where one side lacks the key."""
    c, p = computed.select(*keys, F.col(value).alias("computed")), published.select(*keys, F.col(value).alias("published"))
    j = c.join(p, keys, "full")
    close = F.abs(F.col("computed") - F.col("published")) <= tolerance
    return j.select(*keys, "computed", "published", F.coalesce(close, F.col("computed").isNull() & F.col("published").isNull()).alias("ok"))


def audit_prediction_log(log: DataFrame, inputs: DataFrame, parse) -> DataFrame:
    """(problem, n): rows beyond the inputs, predictions that differ from a new parse, and holes in the prefix of indexes."""
    extra = log.join(inputs, "index", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("extra"))
    again = log.where(~parse(F.col("raw_answer")).eqNullSafe(F.col("prediction"))).agg(F.count(F.lit(1)).alias("n")).withColumn("problem", F.lit("parse"))
    holes = log.agg((F.coalesce(F.max("index") + 1, F.lit(0)) - F.count_distinct("index")).alias("n")).withColumn("problem", F.lit("holes"))
    return extra.unionByName(again).unionByName(holes).select("problem", F.col("n").cast("long").alias("n"))
