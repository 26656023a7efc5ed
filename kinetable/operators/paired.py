"""Paired comparisons. Arms and modes of one item are brought side by side by one pivot on the item, not by self-joins."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import answers as fn
from .ranks import index, linear, middle, quantiles
from .stats import given, partial_spearman, rank_correlations, spearman


def side_by_side(df: DataFrame, keys: list[str], arm: str, arms: list[str], values: list[str]) -> DataFrame:
    """One row an item: {value}_{arm} columns; the first value in order of repeated rows is the largest."""
    aggs = [F.max(F.when(F.col(arm) == a, F.col(v))).alias(f"{v}_{a}") for a in arms for v in values]
    return df.groupBy(*keys).agg(*aggs)


def ratio_quartiles(ratios: DataFrame, cell: list[str], r: str) -> DataFrame:
    """(cell, n, median, q1, q3): quartiles are medians of the lower and the upper half, which exclude the middle item of an odd
    number."""
    t = F.col("_t")
    half = F.expr("_t div 2")
    q = quantiles(ratios, cell, {"median": (r, middle()), "q1": (r, middle(0, half)), "q3": (r, middle(t - half, half))})
    n = ratios.groupBy(*cell).agg(F.count(r).alias("n"))
    one = F.col("n") > 1
    return n.join(q, cell).select(*cell, "n", "median", F.when(one, F.col("q1")).alias("q1"), F.when(one, F.col("q3")).alias("q3"))


def paired_ratio(scored_rows: DataFrame, item: list[str], cell: list[str], numerator: str, denominator: str) -> DataFrame:
    """(cell, n, median, q1, q3, reference_median): item ratios of two arms, both parsed and the denominator positive."""
    wide = side_by_side(scored_rows, [*cell, *item], "arm", [numerator, denominator], ["prediction", "reference_value"])
    ok = wide.where(F.col(f"prediction_{numerator}").isNotNull() & (F.col(f"prediction_{denominator}") > 0))
    r = ok.select(*cell, (F.col(f"prediction_{numerator}") / F.col(f"prediction_{denominator}")).alias("r"), F.try_divide(f"reference_value_{numerator}", f"reference_value_{denominator}").alias("ref"))
    refs = ratio_quartiles(r.where("ref is not null"), cell, "ref").select(*cell, F.col("median").alias("reference_median"))
    return ratio_quartiles(r, cell, "r").join(refs, cell, "left")


def correlation_drop(rows: DataFrame, item: list[str], cell: list[str], full: str, other: str) -> DataFrame:
    """(cell, n, rho_full, rho_other, drop) on the items parsed in both arms."""
    wide = side_by_side(rows, [*cell, *item], "arm", [full, other], ["prediction", "reference_value"])
    both = wide.where(F.col(f"prediction_{full}").isNotNull() & F.col(f"prediction_{other}").isNotNull())
    a = spearman(both, cell, f"prediction_{full}", f"reference_value_{full}").withColumnRenamed("rho", "rho_full")
    b = spearman(both, cell, f"prediction_{other}", f"reference_value_{other}").withColumnRenamed("rho", "rho_other").drop("n")
    return a.join(b, cell).withColumn("drop", F.col("rho_full") - F.col("rho_other"))


def common_cohort(rows: DataFrame, keys: list[str], arm: str, n_arms: int) -> DataFrame:
    """Rows of the items that are parsed in all arms."""
    keep = rows.where("prediction is not null").groupBy(*keys).agg(F.count_distinct(arm).alias("_n")).where(F.col("_n") == n_arms).select(*keys)
    return rows.join(keep, keys, "left_semi")


@F.pandas_udf(T.DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p of the discordant counts; on the tiny table of results."""

    def p(b, c):
        n, k = int(b + c), int(min(b, c))
        if 2 * k >= n:
            return 1.0
        # terms from k downwards, each i / (n - i + 1) of the one before, until no more is added
        term, tail, i = 1.0, 1.0, k
        while i > 0 and term > 1e-18 * tail:
            term *= i / (n - i + 1)
            tail += term
            i -= 1
        log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) + math.log(2 * tail)
        return min(1.0, math.exp(log))

    return pd.Series([p(x, y) for x, y in zip(b, c, strict=True)])


def paired_contrast(rows: DataFrame, keys: list[str], level: str, levels: tuple[str, str], correct: str, cell: list[str]) -> DataFrame:
    """(cell, both, only_a, only_b, neither, p): two levels of a factor matched on keys."""
    a, b = levels
    wide = side_by_side(rows.withColumn(correct, F.col(correct).cast("int")), [*cell, *keys], level, [a, b], [correct]).dropna(subset=[f"{correct}_{a}", f"{correct}_{b}"])
    n = lambda x, y: F.count_if((F.col(f"{correct}_{a}") == x) & (F.col(f"{correct}_{b}") == y))
    g = wide.groupBy(*cell).agg(n(1, 1).alias("both"), n(1, 0).alias("only_a"), n(0, 1).alias("only_b"), n(0, 0).alias("neither"))
    return g.withColumn("p", mcnemar_p("only_a", "only_b"))


def paired_relational_score(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Items (pair_id, pair_role, letter, truth; null letter = missing prediction): accuracy of items and of whole pairs,
    rate of the same letter twice, rates of A, B and anything else, and missing predictions."""
    ok = F.lower(F.trim("letter")) == F.lower("truth")
    r = rows.withColumn("ok", ok.cast("int")).withColumn("l", F.lower(F.trim("letter")))
    role = lambda x, v: F.max(F.when((F.col("pair_role") == x) & F.col("l").isNotNull(), F.col(v)))
    pairs = r.groupBy(*cell, "pair_id").agg(
        role("orig", "ok").alias("o"), role("twin", "ok").alias("t"), role("orig", "l").alias("lo"), role("twin", "l").alias("lt"), F.count("l").alias("items"), F.count_if(F.col("l").isNull()).alias("missing"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("right"), F.count_if(F.col("l") == "a").alias("a"), F.count_if(F.col("l") == "b").alias("b"),
    )
    whole = F.col("o").isNotNull() & F.col("t").isNotNull()
    g = pairs.groupBy(*cell).agg(
        F.count_if(whole).alias("n_pairs"), F.sum("items").alias("n_items"), F.sum("missing").alias("n_missing"), F.try_divide(F.sum("right"), F.sum("items")).alias("item_accuracy"),
        F.try_divide(F.count_if(whole & (F.col("o") + F.col("t") == 2)), F.count_if(whole)).alias("paired_accuracy"), F.try_divide(F.count_if(whole & (F.col("lo") == F.col("lt"))), F.count_if(whole)).alias("same_letter_rate"),
        F.try_divide(F.sum("a"), F.sum("items")).alias("rate_a"), F.try_divide(F.sum("b"), F.sum("items")).alias("rate_b"),
        F.try_divide(F.sum("items") - F.sum("a") - F.sum("b"), F.sum("items")).alias("rate_other"),
    )
    return g


def item_ratio_shares(scored_rows: DataFrame, item: list[str], cell: list[str]) -> DataFrame:
    """(cell, n_items, n, median, q1, q3, share_2, share_125, distinct_cm): cm answers over a hundred metre answers of the items in both
    arms; distinct cm answers are those of all these items."""
    rows = scored_rows.withColumn("seen", F.lit(1))
    wide = side_by_side(rows, [*cell, *item], "arm", ["m", "cm"], ["prediction", "seen"]).where("seen_m = 1 and seen_cm = 1")
    r = wide.withColumn("r", F.when(F.col("prediction_m") > 0, F.col("prediction_cm") / F.when(F.col("prediction_m") > 0, 100 * F.col("prediction_m"))))
    inside = lambda a, b: F.avg(F.col("r").between(a, b).cast("double"))
    g = r.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_items"), F.count("r").alias("n"), inside(0.5, 2).alias("share_2"), inside(0.8, 1.25).alias("share_125"), F.count_distinct("prediction_cm").alias("distinct_cm"))
    q = quantiles(r, cell, {"median": ("r", linear(0.5)), "q1": ("r", linear(0.25)), "q3": ("r", linear(0.75))})
    return g.join(q, cell, "left").select(*cell, "n_items", "n", "median", "q1", "q3", "share_2", "share_125", "distinct_cm")


def cell_ranges(cells: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """(group, n_cells, {value}_lo, {value}_hi): ranges over the cells that are defined."""
    ends = [f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return cells.where(F.col(values[0]).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n_cells"), *ends)


def align_predictions(items: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with their prediction and whether there is one; of repeated predictions the greatest counts."""
    one = predictions.groupBy(*keys).agg(F.max("raw_answer").alias("raw_answer"))
    return items.join(one.withColumn("observed", F.lit(True)), keys, "left").withColumn("observed", F.coalesce("observed", F.lit(False)))


def arm_vs_base(rows: DataFrame, base: DataFrame, item: list[str], cell: list[str], correct: str) -> DataFrame:
    """(cell, only_arm, only_base, p): each arm against one base on the same items."""
    j = rows.select(*cell, *item, F.col(correct).alias("_a")).join(base.select(*item, F.col(correct).alias("_b")), item)
    g = j.groupBy(*cell).agg(F.count_if(F.col("_a") & ~F.col("_b")).alias("only_arm"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_base"))
    return g.withColumn("p", mcnemar_p("only_arm", "only_base"))


def paired_statistics(rows: DataFrame, item: list[str], cell: list[str], a: str, b: str) -> DataFrame:
    """Arm ``a`` against arm ``b`` on their common items: common, parsed, non_positive denominators and negative numerators; medians of
    the ratio, of the expected (reference) ratio and of their quotient; differences of T-MRA on the common and on the parsed
    items and of rank correlations on the parsed ones."""
    w = side_by_side(rows.withColumn("seen", F.lit(1)).withColumn("score", F.coalesce("score", F.lit(0.0))), [*cell, *item], "arm", [a, b], ["seen", "prediction", "reference_value", "score"])
    w = w.where(f"seen_{a} = 1 and seen_{b} = 1")
    both = F.col(f"prediction_{a}").isNotNull() & F.col(f"prediction_{b}").isNotNull()
    ok = both & (F.col(f"prediction_{b}") > 0)
    ratio = F.when(ok, F.col(f"prediction_{a}") / F.when(ok, F.col(f"prediction_{b}")))
    expected = F.try_divide(f"reference_value_{a}", f"reference_value_{b}")
    d = F.col(f"score_{a}") - F.col(f"score_{b}")
    g = w.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("common"), F.count_if(both).alias("parsed"),
        F.avg(d).alias("delta_tmra"), F.avg(F.when(both, d)).alias("delta_tmra_parsed"), F.count_if(both & ~ok).alias("non_positive"), F.count_if(ok & (F.col(f"prediction_{a}") < 0)).alias("negative"),
    )
    medians = quantiles(w, cell, {"ratio": (ratio, middle()), "expected": (F.when(ok, expected), middle()), "normalised": (ratio / expected, middle())})
    p = w.where(both)
    rho = [spearman(p, cell, f"prediction_{x}", f"reference_value_{x}").select(*cell, F.col("rho").alias(f"_{i}")) for i, x in enumerate((a, b))]
    return g.join(medians, cell, "left").join(rho[0].join(rho[1], cell), cell, "left").withColumn("delta_rho", F.col("_0") - F.col("_1")).drop("_0", "_1")


def reference_delta(rows: DataFrame, cell: list[str], new: str, old: str) -> DataFrame:
    """Predictions fixed, another reference: differences of T-MRA over observed and over parsed items and of rank correlation,
    new minus old. ``rows``: (cell, prediction, score_tolerance, score_floor, the two references)."""
    score = lambda y: fn.tmra_scaled(F.col("prediction"), F.col(y), F.col("score_tolerance"), F.col("score_floor"))
    d = score(new) - score(old)
    g = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("observed"), F.count("prediction").alias("parsed"), F.avg(F.coalesce(d, F.lit(0.0))).alias("delta_observed"), F.avg(d).alias("delta_parsed"))
    rho = [spearman(rows, cell, "prediction", y).select(*cell, F.col("rho").alias(f"_{i}")) for i, y in enumerate((new, old))]
    return g.join(rho[0].join(rho[1], cell), cell, "left").withColumn("delta_rho", F.col("_0") - F.col("_1")).drop("_0", "_1")


def rescore(rows: DataFrame, cell: list[str], new: str, old: str, covariate: str) -> DataFrame:
    """How a new truth changes what predictions are worth: n, rank correlation of both truths with each other, with a covariate and
    with the predictions, T-MRA over all items by both, and the correlation with the new truth given the covariate."""
    score = lambda y: F.avg(F.coalesce(fn.tmra_scaled(F.col("prediction"), F.col(y), F.col("score_tolerance"), F.col("score_floor")), F.lit(0.0)))
    out = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), score(old).alias("tmra_old"), score(new).alias("tmra_new"))
    for name, x, y in (("truths", old, new), ("old_covariate", old, covariate), ("new_covariate", new, covariate), ("old", "prediction", old), ("new", "prediction", new)):
        out = out.join(spearman(rows, cell, x, y).select(*cell, F.col("rho").alias(f"rho_{name}")), cell, "left")
    return out.join(partial_spearman(rows, cell, "prediction", new, covariate).select(*cell, F.col("partial").alias("partial_new")), cell, "left")


def truth_ratios(rows: DataFrame, cell: list[str], new: str, old: str) -> DataFrame:
    """(cell, n, p10, median, p90) of new over old truths: index-picked tenths, the usual median."""
    r = rows.where(F.col(old) > 0).select(*cell, (F.col(new) / F.col(old)).alias("r"))
    t = F.col("_t")
    q = quantiles(r, cell, {"p10": ("r", index(F.floor(0.1 * t))), "median": ("r", middle()), "p90": ("r", index(F.floor(0.9 * t) - 1))})
    return r.groupBy(*cell).agg(F.count("r").alias("n")).join(q, cell)


def valid_pairs(items: DataFrame, cell: list[str], new: str, old: str, said: str) -> DataFrame:
    """Pairs of two items (pair_id) under new labels: pairs, those whose new labels still differ, items whose labels agree, and the
    share of valid pairs answered rightly by the old and by the new labels."""
    letter = F.substring(F.upper(F.trim(F.coalesce(said, F.lit("")))), 1, 1)
    right = lambda y: F.bool_and(F.coalesce(letter == F.col(y), F.lit(False)))
    pairs = items.groupBy(*cell, "pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(new).alias("k"), F.count_distinct(new).alias("d"), F.count_if(F.col(new) == F.col(old)).alias("same"), right(old).alias("r_old"), right(new).alias("r_new")
    )
    valid = (F.col("n") == 2) & (F.col("k") == 2) & (F.col("d") == 2)
    share = lambda r: F.try_divide(F.count_if(valid & F.col(r)), F.count_if(valid))
    return pairs.groupBy(*cell).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(valid).alias("valid"), F.sum("same").alias("label_agree"), F.sum("n").alias("n_items"), share("r_old").alias("paired_old"), share("r_new").alias("paired_new"))


def frame_contrasts(cells: DataFrame, keys: list[str], mode: str, full: str, others: list[str], family: str, ordered: dict[str, list[str]], values: list[str]) -> DataFrame:
    """(keys, other, {value}): full minus another frame mode, only for valid pairs: ``ordered`` names the families for which a
    mode that only changes the order of frames says anything."""
    wide = side_by_side(cells, keys, mode, [full, *others], values)
    out = F.explode(F.array(*(F.struct(F.lit(o).alias("other"), *((F.col(f"{v}_{full}") - F.col(f"{v}_{o}")).alias(v) for v in values)) for o in others))).alias("c")
    rows = wide.select(*keys, out).select(*keys, "c.*").where(F.coalesce(*(F.col(v) for v in values)).isNotNull())
    for other, families in ordered.items():
        rows = rows.where((F.col("other") != other) | F.col(family).isin(families))
    return rows


def prior_diagnostics(rows: DataFrame, item: list[str], cell: list[str], full: str, other: str) -> DataFrame:
    """Another prior against the full arm on common parsed items: n, medians of both, their ratio, the difference of mean scores and
    the rank correlations with the full arm's truth."""
    w = side_by_side(rows, [*cell, *item], "arm", [full, other], ["prediction", "reference_value", "score"]).where(F.col(f"prediction_{full}").isNotNull() & F.col(f"prediction_{other}").isNotNull())
    g = w.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), (F.avg(f"score_{other}") - F.avg(f"score_{full}")).alias("delta_tmra"))
    medians = quantiles(w, cell, {"median_full": (f"prediction_{full}", middle()), "median_other": (f"prediction_{other}", middle())})
    g = g.join(medians, cell, "left").withColumn("ratio", F.try_divide("median_other", "median_full"))
    for name, arm in (("rho_full", full), ("rho_other", other)):
        g = g.join(spearman(w, cell, f"prediction_{arm}", f"reference_value_{full}").select(*cell, F.col("rho").alias(name)), cell, "left")
    return g


def conversion_diagnostic(rows: DataFrame, item: list[str], cell: list[str], low: float = 50.0, high: float = 200.0) -> DataFrame:
    """Centimetre answers against metre answers (both parsed, metres positive): n, share of ratios in [low, high], rank correlation of
    cm with metres and with its truth, the cm median and a hundred times the metre median."""
    w = side_by_side(rows, [*cell, *item], "arm", ["m", "cm"], ["prediction", "reference_value"]).where("prediction_cm is not null and prediction_m > 0")
    g = w.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction_cm") / F.col("prediction_m")).between(low, high).cast("double")).alias("share_converted"))
    medians = quantiles(w, cell, {"cm_median": ("prediction_cm", middle()), "m_median_x100": ("prediction_m", middle())})
    g = g.join(medians.withColumn("m_median_x100", 100 * F.col("m_median_x100")), cell, "left")
    for name, x in (("rho_cm_m", "prediction_m"), ("rho_cm_reference", "reference_value_cm")):
        g = g.join(spearman(w, cell, "prediction_cm", x).select(*cell, F.col("rho").alias(name)), cell, "left")
    return g


def exact_conversion(rows: DataFrame, item: list[str], cell: list[str], base: str, target: str, factor: float) -> DataFrame:
    """Direct answers of the target arm beside the own base answers times the exact factor, both against the target's truth: n, T-MRA
    over all items and rank correlation of each (the second is the ceiling of converting one's own reading)."""
    w = side_by_side(rows, [*cell, *item], "arm", [base, target], ["prediction", "reference_value", "score_tolerance", "score_floor"]).where(F.col(f"reference_value_{target}").isNotNull())
    w = w.withColumns({"direct": F.col(f"prediction_{target}"), "converted": F.col(f"prediction_{base}") * factor})
    score = lambda p: F.avg(F.coalesce(fn.tmra_scaled(F.col(p), *(F.col(f"{c}_{target}") for c in ("reference_value", "score_tolerance", "score_floor"))), F.lit(0.0)))
    g = w.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(score(p).alias(f"tmra_{p}") for p in ("direct", "converted")))
    for p in ("direct", "converted"):
        g = g.join(spearman(w, cell, p, f"reference_value_{target}").select(*cell, F.col("rho").alias(f"rho_{p}")), cell, "left")
    return g


def two_stage_block(rows: DataFrame, item: list[str], cell: list[str], base: str, target: str, second: str, factor: float) -> DataFrame:
    """Of the items with the target arm's truth: its direct answers, the answers of a second turn (arm ``second``) that was given the own base answer and
    the factor, and the exact conversion of that answer (the ceiling), all against the target's truth: parsed, T-MRA over all items and rank
    correlation of each; and the median ratio of second-turn to base answers over the factor."""
    values = ["prediction", "reference_value", "score_tolerance", "score_floor"]
    w = side_by_side(rows, [*cell, *item], "arm", [base, target, second], values).where(F.col(f"reference_value_{target}").isNotNull())
    told = F.col(f"prediction_{base}")
    w = w.withColumns({"direct": F.col(f"prediction_{target}"), "two_stage": F.col(f"prediction_{second}"), "ceiling": told * factor, "_r": F.when(told > 0, F.col(f"prediction_{second}") / (told * factor))})
    names = ("direct", "two_stage", "ceiling")
    score = lambda p: F.avg(F.coalesce(fn.tmra_scaled(F.col(p), *(F.col(f"{c}_{target}") for c in values[1:])), F.lit(0.0)))
    g = w.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), *(F.count(p).alias(f"parsed_{p}") for p in names), *(score(p).alias(f"tmra_{p}") for p in names))
    for p in names:
        g = g.join(spearman(w, cell, p, f"reference_value_{target}").select(*cell, F.col("rho").alias(f"rho_{p}")), cell, "left")
    return g.join(quantiles(w, cell, {"ratio": ("_r", middle())}), cell, "left")


def arm_decomposition(rows: DataFrame, item: list[str], cell: list[str], full: str, context: str, size: str) -> DataFrame:
    """Rank correlations of three arms on the items parsed in all of them, and what the steps between them change."""
    arms = [full, context, size]
    w = side_by_side(rows, [*cell, *item], "arm", arms, ["prediction", "reference_value"]).where(" and ".join(f"prediction_{a} is not null" for a in arms))
    g = w.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    for name, a in zip(("rho_full", "rho_context", "rho_size"), arms, strict=True):
        g = g.join(spearman(w, cell, f"prediction_{a}", f"reference_value_{full}").select(*cell, F.col("rho").alias(name)), cell, "left")
    return g.withColumns({"d_context": F.col("rho_context") - F.col("rho_full"), "d_size": F.col("rho_size") - F.col("rho_context"), "d_total": F.col("rho_size") - F.col("rho_full")})


def over_ratio_share(ratios: DataFrame, cell: list[str], r: str, over: float = 1.5) -> DataFrame:
    """(cell, n, median, q1, q3, share_over): linear quartiles of ratios and the share over a bound."""
    g = ratios.groupBy(*cell).agg(F.count(r).alias("n"), F.avg((F.col(r) > over).cast("double")).alias("share_over"))
    q = quantiles(ratios, cell, {"median": (r, linear(0.5)), "q1": (r, linear(0.25)), "q3": (r, linear(0.75))})
    return g.join(q, cell, "left").select(*cell, "n", "median", "q1", "q3", "share_over")


def prefix_greedy(counts: DataFrame, group: list[str], text: str, n: str) -> DataFrame:
    """(group, greedy): the number that one gets by writing digit after digit, each time the most frequent next character (the lowest of equals) among the
    texts that begin like it so far, until more of them end there than go on in any one way. ``counts``: (group, text, n), one row a distinct text.

    Every beginning of a text is a node with the count of texts below it; a node is chosen if it is the best of its parent's and the
    parent doesn't end; the longest node all of whose beginnings are chosen is the answer."""
    t = counts.select(*group, F.col(text).alias("_s"), F.col(n).alias("_c"))
    each = F.explode(F.transform(F.sequence(F.lit(1), F.length("_s")), lambda i: F.struct(i.alias("len"), F.col("_s").substr(F.lit(1), i).alias("p"), (i == F.length("_s")).alias("ends"))))
    nodes = t.select(*group, "_c", each.alias("b")).groupBy(*group, F.col("b.p").alias("p"), F.col("b.len").alias("len")).agg(F.sum("_c").alias("w"), F.sum(F.when(F.col("b.ends"), F.col("_c")).otherwise(0)).alias("ends"))
    nodes = nodes.withColumn("up", F.col("p").substr(F.lit(1), F.col("len") - 1))
    best = nodes.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "up").orderBy(F.desc("w"), "p"))).where("_r = 1")
    ended = nodes.select(*group, F.col("p").alias("up"), F.col("ends").alias("_ends"))
    chosen = best.drop("ends").join(ended, [*group, "up"], "left").where(F.coalesce("_ends", F.lit(0)) <= F.col("w")).select(*group, "p", "len")
    above = chosen.select(*group, F.col("p").alias("whole"), F.col("len").alias("_n"), F.explode(F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: F.col("p").substr(F.lit(1), i))).alias("p"))
    path = above.join(chosen, [*group, "p"]).groupBy(*group, "whole", "_n").agg(F.count(F.lit(1)).alias("_k")).where("_k = _n")
    return path.groupBy(*group).agg(F.max_by("whole", "_n").try_cast("double").alias("greedy"))


def mode_match(rows: DataFrame, targets: DataFrame, cell: list[str], item: list[str]) -> DataFrame:
    """How often a cm answer is what a reading would give: ``rows`` (cell, item, reading, answer), ``targets`` (cell, target in cm).

    A target belongs to the nearest reading of its cell (the lower of two), and each reading predicts the most frequent of its
    targets (the lowest of equals; the cell's where it has none); further the cell's mode, the target nearest to a hundred
    readings, a hundred readings, and the numbers that ``prefix_greedy`` writes from a reading's or the cell's targets. Readings and targets are answers with one decimal, so their distinct values are few:
    both sweeps are over distinct values."""
    grid = rows.select(*cell, F.col("reading").alias("v")).distinct()
    counts = targets.groupBy(*cell, "target").agg(F.count(F.lit(1)).alias("c"))
    best = lambda g: g.agg(F.max(F.struct("c", (-F.col("target")).alias("t"))).alias("m"))
    overall = best(counts.groupBy(*cell)).select(*cell, (-F.col("m.t")).alias("global_mode"))

    def nearest(points: DataFrame, p: str, places: DataFrame, v: str, out: str) -> DataFrame:
        """Each point with the nearest place of its cell, the lower of two, from the last place before and the first after it."""
        both = points.select(*cell, F.col(p).alias("x"), F.lit(True).alias("is_p")).unionByName(places.select(*cell, F.col(v).alias("x"), F.lit(False).alias("is_p")))
        order = Window.partitionBy(*cell).orderBy("x")
        here = F.when(~F.col("is_p"), F.col("x"))
        both = both.withColumn("lo", F.max(here).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.min(here).over(order.rangeBetween(0, Window.unboundedFollowing)))
        near = F.when(F.col("lo").isNull() | (F.col("hi") - F.col("x") < F.col("x") - F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
        return both.where("is_p").select(*cell, F.col("x").alias(p), near.alias(out)).distinct()

    buckets = nearest(counts.withColumn("metres", F.col("target") / 100).select(*cell, "metres"), "metres", grid, "v", "reading")
    inside = counts.withColumn("metres", F.col("target") / 100).join(buckets, [*cell, "metres"])
    by_reading = best(inside.groupBy(*cell, "reading")).select(*cell, "reading", (-F.col("m.t")).alias("mode"))
    hundred = grid.select(*cell, F.col("v").alias("reading"), (100 * F.col("v")).alias("cm"))
    near = nearest(hundred, "cm", counts, "target", "nearest").join(hundred, [*cell, "cm"]).select(*cell, "reading", "nearest")
    spelt = inside.withColumn("_text", fn.one_decimal(F.col("target")))
    greedy = prefix_greedy(spelt, [*cell, "reading"], "_text", "c").withColumnRenamed("greedy", "own_prefix")
    whole = prefix_greedy(counts.withColumn("_text", fn.one_decimal(F.col("target"))), cell, "_text", "c").withColumnRenamed("greedy", "cell_prefix")
    j = rows.join(by_reading, [*cell, "reading"], "left").join(overall, cell, "left").join(near, [*cell, "reading"], "left").join(greedy, [*cell, "reading"], "left").join(whole, cell, "left")
    own = F.when(F.col("mode").isNotNull(), F.col("own_prefix")).otherwise(F.col("cell_prefix"))
    hit = lambda c: F.avg(F.coalesce(F.abs(c - F.col("answer")) < 0.05, F.lit(False)).cast("double"))
    return j.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), hit(F.coalesce("mode", "global_mode")).alias("conditional_mode"), hit(F.col("global_mode")).alias("global_mode"), hit(F.col("nearest")).alias("nearest_target"), hit(fn.one_decimal(100 * F.col("reading")).cast("double")).alias("exact_x100"),
        hit(own).alias("conditional_prefix"), hit(F.col("cell_prefix")).alias("global_prefix"),
    )


def reader_partials(rows: DataFrame, cell: list[str], prediction: str, world: str, px: str, height: str) -> DataFrame:
    """(cell, n, world_given_px, px_given_world, world_given_height): whether a reader's answers follow the world's motion or the pixels', by rank
    partial correlations; intervals come from ``resample.bootstrap_items`` with ``partial_rho``."""
    r = rank_correlations(rows, cell, {"pw": (prediction, world), "pp": (prediction, px), "ph": (prediction, height), "wp": (world, px), "wh": (world, height)})
    n = F.col("n")
    return r.select(*cell, "n", given("pw", "pp", "wp", n).alias("world_given_px"), given("pp", "pw", "wp", n).alias("px_given_world"), given("pw", "ph", "wh", n).alias("world_given_height"))


def dissociation(text: DataFrame, visual: DataFrame, keys: list[str], value: str, ratio: str) -> DataFrame:
    """(keys, text_n, text_median, text_q1, text_q3, visual_n, visual_median): a checkpoint's ratios on text items beside those on visual ones, also where it
    has only one kind."""
    t = text.groupBy(*keys).agg(F.count(value).alias("text_n")).join(quantiles(text, keys, {"text_median": (value, linear(0.5)), "text_q1": (value, linear(0.25)), "text_q3": (value, linear(0.75))}), keys, "left")
    v = visual.groupBy(*keys).agg(F.count(ratio).alias("visual_n")).join(quantiles(visual, keys, {"visual_median": (ratio, middle())}), keys, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.join(v, keys, "full").select(*keys, n("text_n"), "text_median", "text_q1", "text_q3", n("visual_n"), "visual_median")
