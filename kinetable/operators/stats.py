"""Statistics keyed by cell columns. Sums and counts are partial aggregations; whatever depends on the order of a cell's values (ranks,
quantiles, the best constant) comes from ``ranks``, which spreads a cell over all partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as fn
from .ranks import average_ranks, linear, middle, quantiles, running


def rank_correlations(df: DataFrame, cell: list[str], pairs: dict[str, tuple[str, str]], weight: str | None = None) -> DataFrame:
    """(cell, n, names): Pearson of average ranks for each named pair of columns, over the rows in which none of the columns is null; null when
    n < 3 or a side is constant. ``weight``: how often a row counts. All columns are ranked in one exchange by (cell, column, value); no cell is in one task."""
    columns = list(dict.fromkeys(c for p in pairs.values() for c in p))
    named = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    xs = [f"_x{i}" for i in range(len(columns))]
    times = F.lit(1) if weight is None else F.col(weight)
    counts = df.select(*cell, *named, times.alias("_c")).dropna(subset=xs).groupBy(*cell, *xs).agg(F.sum("_c").alias("_c"))
    ranks, ranked = average_ranks(counts, cell, xs, "_c"), counts
    for x in xs:
        ranked = ranked.join(ranks.where(F.col("_side") == x).select(*cell, F.col("_v").alias(x), F.col("_rank").alias(f"_r{x}")), [*cell, x])
    s = lambda a: F.sum(F.col("_c") * a)
    r = {c: F.col(f"_r_x{i}") for i, c in enumerate(columns)}
    sums = [s(a).alias(f"_s{i}") for i, a in enumerate(r.values())] + [s(a * a).alias(f"_q{i}") for i, a in enumerate(r.values())] + [s(r[x] * r[y]).alias(f"_p_{k}") for k, (x, y) in pairs.items()]
    g = ranked.groupBy(*cell).agg(F.sum("_c").alias("n"), *sums)
    n = F.col("n")

    def rho(k: str, x: str, y: str):
        a, b = columns.index(x), columns.index(y)
        sxx, syy = (F.col(f"_q{i}") - F.col(f"_s{i}") * F.col(f"_s{i}") / n for i in (a, b))
        return F.when((n >= 3) & (sxx > 0) & (syy > 0), (F.col(f"_p_{k}") - F.col(f"_s{a}") * F.col(f"_s{b}") / n) / F.sqrt(sxx * syy)).alias(k)

    return g.select(*cell, "n", *(rho(k, x, y) for k, (x, y) in pairs.items()))


def spearman(df: DataFrame, cell: list[str], x: str, y: str, weight: str | None = None) -> DataFrame:
    """(cell, n, rho) over the rows with both values."""
    return rank_correlations(df, cell, {"rho": (x, y)}, weight)


def given(xy: str, xz: str, yz: str, n: Column) -> Column:
    """Partial correlation of x and y given z from the three correlations; a constant z takes nothing away; null when n < 4 or z explains one fully."""
    a, b = (F.coalesce(c, F.lit(0.0)) for c in (xz, yz))
    rest = (1 - a * a) * (1 - b * b)
    return F.when((n >= 4) & (rest > 1e-12), (F.col(xy) - a * b) / F.sqrt(F.when(rest > 0, rest)))


def partial_spearman(df: DataFrame, cell: list[str], x: str, y: str, z: str, weight: str | None = None) -> DataFrame:
    """(cell, n, partial): rank correlation of x and y given a third variable."""
    j = rank_correlations(df, cell, {"xy": (x, y), "xz": (x, z), "yz": (y, z)}, weight)
    return j.select(*cell, "n", given("xy", "xz", "yz", F.col("n")).alias("partial"))


def scored(predictions: DataFrame) -> DataFrame:
    """Adds prediction (strict parse) and score (0 to 100, null if unparsed)."""
    p = predictions.withColumn("prediction", fn.parse_strict(F.col("raw_answer")))
    return p.withColumn("score", fn.tmra_scaled(F.col("prediction"), F.col("reference_value"), F.col("score_tolerance"), F.col("score_floor")))


def family_stats(scored_rows: DataFrame, cell: list[str]) -> DataFrame:
    """n, parsed, n_distinct, degenerate (two answers at most), T-MRA over all items, medians and rho of each cell."""
    g = scored_rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.count("prediction").alias("parsed"), F.count_distinct("prediction").alias("n_distinct"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("_s"),
    )
    truth = F.when(F.col("prediction").isNotNull(), F.col("reference_value"))
    medians = quantiles(scored_rows, cell, {"prediction_median": ("prediction", middle()), "reference_median": (truth, middle())})
    rho = spearman(scored_rows, cell, "prediction", "reference_value").select(*cell, "rho")
    out = g.join(rho, cell, "left").join(medians, cell, "left")
    return out.select(*cell, "n", "parsed", "n_distinct", (F.col("n_distinct") <= 2).alias("degenerate"), (F.col("_s") / F.col("n")).alias("tmra"), "rho", "prediction_median", "reference_median")


def best_constant(items: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, constant, tmra): the constant answer with the highest mean score. Each item gives ten open intervals of
    constants that earn ten points; a sweep over their ends finds the best interval, the lowest one of equals."""
    radius = lambda s: F.col("score_tolerance") + F.lit(s) * F.greatest(F.abs("reference_value"), F.col("score_floor"))
    ends = F.array(*(F.struct((F.col("reference_value") + sign * radius(s)).alias("p"), F.lit(-sign).alias("d")) for s in fn.STEPS for sign in (-1, 1)))
    points = items.select(*cell, F.explode(ends).alias("e")).groupBy(*cell, F.col("e.p").alias("p")).agg(F.sum("e.d").alias("d"))
    active = running(points, cell, "p", "d", next_value=True).withColumn("active", F.col("_before") + F.col("d")).withColumnRenamed("_next", "right")
    open_ = active.withColumn("mid", F.col("p") + (F.col("right") - F.col("p")) / 2).where("p < mid and mid < right")
    best = open_.groupBy(*cell).agg(F.max(F.struct("active", (-F.col("p")).alias("_p"), "mid")).alias("b"))
    n = items.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, cell).select(*cell, F.col("b.mid").alias("constant"), (10.0 * F.col("b.active") / F.col("n")).alias("tmra"))


def constant_median(scored_rows: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, median, constant_tmra, margin): score of always answering the median truth, and the margin over it."""
    med = quantiles(scored_rows, cell, {"median": ("reference_value", middle())})
    j = scored_rows.join(med, cell)
    c = fn.tmra_scaled(F.col("median"), F.col("reference_value"), F.col("score_tolerance"), F.col("score_floor"))
    return j.groupBy(*cell, "median").agg(F.avg(c).alias("constant_tmra"), (F.avg(F.coalesce("score", F.lit(0.0))) - F.avg(c)).alias("margin"))


def distribution(df: DataFrame, cell: list[str], v: str) -> DataFrame:
    """(cell, n, median, q1, q3, min, max), quartiles by linear interpolation."""
    g = df.groupBy(*cell).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, cell, {"median": (v, linear(0.5)), "q1": (v, linear(0.25)), "q3": (v, linear(0.75))})
    return g.join(q, cell, "left").select(*cell, "n", "median", "q1", "q3", "min", "max")


def coverage_stats(items: DataFrame, predictions: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Expected, observed, parsed, invalid and missing items with the score over each denominator: an invalid answer
    counts as 0, a missing one is counted apart."""
    p = predictions.select(*keys, "prediction", "score", F.lit(True).alias("_seen"))
    j = items.join(p, keys, "left")
    total = F.coalesce(F.sum("score"), F.lit(0.0))
    g = j.groupBy(*cell).agg(F.count(F.lit(1)).alias("expected"), F.count("_seen").alias("observed"), F.count("prediction").alias("parsed"), total.alias("_s"), F.avg(F.abs(F.col("prediction") - F.col("reference_value"))).alias("mae"))
    return g.select(
        *cell, "expected", "observed", "parsed", (F.col("observed") - F.col("parsed")).alias("invalid"), (F.col("expected") - F.col("observed")).alias("missing"),
        F.try_divide("_s", "observed").alias("tmra_observed"), F.try_divide("_s", "parsed").alias("tmra_parsed"), F.when(F.col("observed") == F.col("expected"), F.col("_s") / F.col("expected")).alias("tmra_all"),
        (F.col("_s") / F.col("expected")).alias("tmra_lower_bound"), "mae",
    )


def evaluate_summary(rows: DataFrame, metric_version: str = "legacy_v1") -> DataFrame:
    """Legacy rows (category, answer, vlm_answer, has_prediction) by metric group and overall: n, coverage, parse failures of
    numeric groups, exact accuracy, T-MRA (numeric groups only) and the share of locations within 30 cm. A missing prediction
    counts as a wrong one."""
    r = rows.select(fn.map_group(F.col("category")).alias("grp"), "answer", "has_prediction", F.when(F.col("has_prediction"), F.col("vlm_answer")).otherwise("").alias("said"))
    numeric = F.col("grp").isin(*fn.GROUPS, "localization")
    r = r.withColumn("s", fn.score_pair(F.col("grp"), F.col("said"), F.col("answer"), metric_version))
    seen = F.col("has_prediction")
    r = r.select(
        "grp", seen.cast("double").alias("seen"), fn.parse_failure(F.col("grp"), F.col("said")).cast("int").alias("failed"), (seen & F.col("s.exact")).cast("double").alias("exact"),
        F.when(numeric, F.when(seen, F.col("s.tmra")).otherwise(0.0)).alias("t"), F.when(F.col("grp") == "localization", fn.within_30cm(F.col("said"), F.col("answer")).cast("double")).alias("near"),
    )
    g = r.groupingSets([["grp"], []], "grp").agg(F.count(F.lit(1)).alias("n"), F.avg("seen").alias("coverage"), F.sum("failed").alias("parse_failures"), F.avg("exact").alias("exact_accuracy"), F.avg("t").alias("tmra"), F.avg("near").alias("within_30cm"))
    return g.withColumn("grp", F.coalesce("grp", F.lit("overall")))


def seed_spread(df: DataFrame, cell: list[str], v: str) -> DataFrame:
    return df.groupBy(*cell).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))


def proportions(rows: DataFrame, factors: list[str], ok: str, classes: str) -> DataFrame:
    """(factor, level, class counts, n, k, lo, hi): accuracy with Wilson intervals by each level of each factor, and over all
    rows (factor ``all``), with the count of every class as an array of (class, n)."""
    sets = [[f] for f in factors] + [[]]
    g = rows.withColumn("_ok", F.col(ok).cast("int")).groupingSets([[*s, classes] for s in sets], *factors, classes).agg(F.count(F.lit(1)).alias("c"), F.sum("_ok").alias("k"), F.grouping_id().alias("_g"))
    factor = F.coalesce(*(F.when(F.col(f).isNotNull(), f) for f in factors), F.lit("all"))
    level = F.coalesce(*(F.col(f).cast("string") for f in factors), F.lit("all"))
    h = g.select(factor.alias("factor"), level.alias("level"), F.col(classes).alias("class"), "c", "k").groupBy("factor", "level")
    h = h.agg(F.sum("c").alias("n"), F.sum("k").alias("k"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "class", F.col("c").cast("string")))), ",").alias("classes"))
    lo, hi = fn.wilson(F.col("k"), F.col("n"))
    return h.withColumns({"lo": lo, "hi": hi})


def decimal_summary(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Of answers as exact decimals (raw_answer, answer: text): n, parsed, exact (equal decimals), zero and negative answers, distinct
    values, the largest repeat, whether all answers are one constant, and the mean absolute error of parsed answers."""
    ok = F.trim("raw_answer").rlike(fn.STRICT)
    d = rows.select(*cell, F.when(ok, F.trim("raw_answer").try_cast("double")).alias("_f"), F.when(ok, F.trim("raw_answer").try_cast("decimal(38,10)")).alias("p"), F.col("answer").cast("decimal(38,10)").alias("y"))
    d = d.withColumn("p", F.when(F.abs("_f") < float("inf"), F.col("p")))
    each = d.groupBy(*cell, "p").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("p") == F.col("y")).alias("e"), F.sum(F.abs(F.col("p") - F.col("y"))).alias("err"))
    g = each.groupBy(*cell).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("p").isNotNull(), F.col("c")).otherwise(0)).alias("parsed"), F.sum("e").alias("exact"), F.sum(F.when(F.col("p") == 0, F.col("c")).otherwise(0)).alias("zero"),
        F.sum(F.when(F.col("p") < 0, F.col("c")).otherwise(0)).alias("negative"), F.count("p").alias("n_distinct"), F.coalesce(F.max(F.when(F.col("p").isNotNull(), F.col("c"))), F.lit(0)).alias("largest_repeat"), F.sum("err").cast("double").alias("_err"),
    )
    constant = (F.col("n") >= 2) & (F.col("parsed") == F.col("n")) & (F.col("n_distinct") == 1)
    return g.withColumn("constant", constant).withColumn("mae", F.try_divide("_err", "parsed")).drop("_err")


def reading_stats(rows: DataFrame, cell: list[str], raw: str, expected: str, reference: str) -> DataFrame:
    """Of read-then-convert answers: n, parsed, share with the right unit's token, median of value over reading, and the rank correlation of the reading
    with the truth."""
    r = rows.withColumn("_p", fn.parse_read_then_convert(F.col(raw))).withColumns({"_reading": F.col("_p.reading"), "_value": F.col("_p.value")})
    rho = spearman(r, cell, "_reading", reference).select(*cell, F.col("rho").alias("reading_rho"))
    unit = F.when(F.col("_reading").isNotNull(), (F.col("_p.unit") == F.col(expected)).cast("double"))
    g = r.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count("_value").alias("parsed"), F.avg(unit).alias("unit_ok"))
    over = quantiles(r, cell, {"value_over_reading": (F.when(F.col("_reading") > 0, F.try_divide("_value", "_reading")), middle())})
    return g.join(over, cell, "left").join(rho, cell, "left")
