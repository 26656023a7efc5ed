"""Queries on derived prediction logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..operators import paired, resample, stats
from ..sources import adapters as A

CELL = ["model", "arm", "category"]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scored(A.predictions(spark, sf_dir))


def _rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw_answer")
    p = A.predictions(spark, sf_dir)
    return p.select("item", "arm", fn.parse_strict(raw).alias("strict"), fn.parse_first_number(raw).alias("first"), fn.extract_last_line(raw).alias("last_line"), fn.map_group(F.col("category")).alias("grp"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_scored(spark, sf_dir).select("item", "arm", "prediction", "score"))


def family_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.family_stats(_scored(spark, sf_dir), CELL))


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderpriority")
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return _rounded(stats.spearman(o.join(c, "c_custkey"), ["o_orderpriority"], "o_totalprice", "c_acctbal"))


def partial_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount")
    return _rounded(stats.partial_spearman(rows, ["l_returnflag"], "l_extendedprice", "l_discount", "l_quantity"))


def best_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.best_constant(A.predictions(spark, sf_dir), ["model", "arm", "category"]))


def constant_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.constant_median(_scored(spark, sf_dir), CELL))


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.distribution(_scored(spark, sf_dir), CELL, "prediction"))


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    items = rows.select("item", *CELL, "reference_value")
    return _rounded(stats.coverage_stats(items, rows.where("item % 13 <> 0"), ["item", *CELL], CELL))


def evaluate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.predictions(spark, sf_dir)
    rows = p.select("category", F.format_string("%s", F.col("reference_value").cast("decimal(12,1)")).alias("answer"), F.col("raw_answer").alias("vlm_answer"), (F.col("item") % 13 != 0).alias("has_prediction"))
    return _rounded(stats.evaluate_summary(rows))


def paired_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.paired_ratio(_scored(spark, sf_dir), ["item"], ["model", "category"], "cm", "m"))


def correlation_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.correlation_drop(_scored(spark, sf_dir), ["item"], ["model", "category"], "m", "cm"))


def common_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired.common_cohort(_scored(spark, sf_dir), ["item"], "arm", 2).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))


def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("correct", F.coalesce(F.col("score") >= 60, F.lit(False)))
    rows = rows.withColumn("correct", F.col("correct") & ~((F.col("arm") == "cm") & (F.col("item") % 5 == 0)))
    return _rounded(paired.paired_contrast(rows, ["item"], "arm", ("m", "cm"), "correct", ["model"]), 5)


def paired_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    letter = F.when(F.length("text") % 11 == 0, None).when(F.length("text") % 3 == 0, " b ").when(F.length("text") % 7 == 0, "other").otherwise("A")
    rows = c.select((F.col("conv_id") % 4).alias("fold"), (F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2)).alias("pair_id"), F.when(F.col("turn") % 2 == 0, "orig").otherwise("twin").alias("pair_role"), letter.alias("letter"), F.when(F.col("turn") % 2 == 0, "A").otherwise("B").alias("truth"))
    return _rounded(paired.paired_relational_score(rows, ["fold"]))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("cluster", F.col("item") % 40).withColumn("value", F.coalesce("score", F.lit(0.0)))
    return _rounded(resample.bootstrap(rows, ["model", "arm"], "cluster", ["value"], resample.mean))


def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _scored(spark, sf_dir).withColumn("seed", F.col("item") % 3).groupBy(*CELL, "seed").agg(F.avg("score").alias("v"))
    return _rounded(stats.seed_spread(cells, CELL, "v"))


def _probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-probe items on part sizes, with answers that convert, copy, invert, slip a decade or miss."""
    p = A.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 400 + 5).cast("int").alias("k"))
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("pair"), F.lit(f).alias("factor")) for u, f in (("m_cm", 100.0), ("cm_m", 0.01), ("m_km", 0.001), ("km_m", 1000.0)))))
    r = p.withColumn("u", units).select("p_partkey", "u.pair", "u.factor", (F.col("k") / 8).alias("value"))
    r = r.withColumn("target", F.col("value") * F.col("factor"))
    h = F.col("p_partkey") % 9
    answer = F.when(h < 4, F.col("target")).when(h == 4, F.col("value")).when(h == 5, F.col("value") / F.col("factor")).when(h == 6, F.col("target") * 10).when(h == 7, None).otherwise(F.col("target") * 1.5)
    return r.withColumn("prediction", answer)


def conversion_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _probe(spark, sf_dir)
    c = fn.classify_conversion(F.col("prediction"), F.col("value"), F.col("factor"), F.col("target")).alias("class")
    return r.select("pair", c, fn.is_diagnostic(F.col("value"), F.col("target")).alias("diagnostic")).groupBy("pair", "diagnostic", "class").agg(F.count(F.lit(1)).alias("n"))


def conversion_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _probe(spark, sf_dir)
    c = fn.classify_conversion(F.col("prediction"), F.col("value"), F.col("factor"), F.col("target")) == "correct"
    g = r.where(fn.is_diagnostic(F.col("value"), F.col("target"))).withColumn("ok", c.cast("int")).groupingSets([["pair"], []], "pair").agg(F.count(F.lit(1)).alias("n"), F.sum("ok").alias("k"))
    lo, hi = fn.wilson(F.col("k"), F.col("n"))
    return _rounded(g.select(F.coalesce("pair", F.lit("all")).alias("pair"), "n", "k", lo.alias("lo"), hi.alias("hi")))


_S = ", ".join(repr(x) + "::DOUBLE" for x in fn.STEPS)


def _sql_score(p: str, y: str, t: str, e: str) -> str:
    rel = f"(abs({p} - {y}) - {t}) / greatest(abs({y}), {e})"
    return f"CASE WHEN {p} IS NOT NULL THEN 10.0::DOUBLE * list_sum(list_transform([{_S}], lambda q: CASE WHEN {rel} < q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) END"


SCORED = f"""{A.PREDICTIONS}, parsed AS (
  SELECT *, CASE WHEN regexp_matches(trim(raw_answer), '{fn.STRICT}') AND isfinite(try_cast(trim(raw_answer) AS DOUBLE)) THEN try_cast(trim(raw_answer) AS DOUBLE) END AS prediction FROM predictions
), scored AS (SELECT *, {_sql_score("prediction", "reference_value", "score_tolerance", "score_floor")} AS score FROM parsed)"""


def _sql_rho(src: str, cell: str, x: str, y: str, name: str = "rho") -> str:
    """CTEs {name}_r and {name}: Spearman of x and y for each cell."""
    return f"""{name}_r AS (
  SELECT {cell}, rank() OVER (PARTITION BY {cell} ORDER BY x) + (count(*) OVER (PARTITION BY {cell}, x) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY {cell} ORDER BY y) + (count(*) OVER (PARTITION BY {cell}, y) - 1) / 2.0::DOUBLE AS b
  FROM (SELECT {cell}, {x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
), {name} AS (SELECT {cell}, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS rho FROM {name}_r GROUP BY {cell})"""


_C = "model, arm, category"
_PROBE = """probe AS (
  SELECT *, CASE WHEN h < 4 THEN target WHEN h = 4 THEN value WHEN h = 5 THEN value / factor WHEN h = 6 THEN target * 10 WHEN h = 7 THEN NULL ELSE target * 1.5::DOUBLE END AS prediction FROM (
    SELECT p_partkey % 9 AS h, pair, factor, (p_partkey % 400 + 5) / 8.0::DOUBLE AS value, (p_partkey % 400 + 5) / 8.0::DOUBLE * factor AS target
    FROM part, (VALUES ('m_cm', 100.0::DOUBLE), ('cm_m', 0.01::DOUBLE), ('m_km', 0.001::DOUBLE), ('km_m', 1000.0::DOUBLE)) u(pair, factor))
), classed AS (
  SELECT *, abs(target) >= 0.05 AND abs(CAST(printf('%.1f', value) AS DOUBLE) - CAST(printf('%.1f', target) AS DOUBLE)) >= 0.1 AND abs(value - target) >= 0.05 AS diagnostic,
    CASE WHEN prediction IS NULL THEN 'unparsed' WHEN abs(prediction - target) < 0.05 THEN 'correct' WHEN prediction <= 0 OR target <= 0 THEN 'other' WHEN abs(log10(prediction / value)) < 0.02 THEN 'identity'
      WHEN abs(log10(prediction * factor / value)) < 0.02 THEN 'wrong_direction' WHEN round(log10(prediction / target)) <> 0 AND abs(log10(prediction / target) - round(log10(prediction / target))) < 0.02 THEN 'decade_error' ELSE 'other' END AS class
  FROM probe
)"""
_PAIRS = f"""{SCORED}, wide AS (
  SELECT model, category, item, max(prediction) FILTER (arm = 'm') AS pm, max(prediction) FILTER (arm = 'cm') AS pc, max(reference_value) FILTER (arm = 'm') AS rm, max(reference_value) FILTER (arm = 'cm') AS rc FROM scored GROUP BY ALL
)"""

QUERIES = {
    "parsers": parsers, "scores": scores, "family_stats": family_stats, "spearman": spearman, "partial_spearman": partial_spearman, "best_constant": best_constant, "constant_median": constant_median,
    "distribution": distribution, "coverage_stats": coverage_stats, "evaluate_summary": evaluate_summary, "paired_ratio": paired_ratio, "correlation_drop": correlation_drop, "common_cohort": common_cohort,
    "paired_contrast": paired_contrast, "paired_relational": paired_relational, "bootstrap": bootstrap, "seed_spread": seed_spread, "conversion_classes": conversion_classes, "conversion_accuracy": conversion_accuracy,
}
ORACLES = {
    "parsers": f"""WITH {SCORED} SELECT item, arm, prediction AS strict, try_cast(nullif(regexp_extract(raw_answer, '{fn.FIRST}'), '') AS DOUBLE) AS first,
  trim(regexp_replace(trim(raw_answer), '^(?i:(final\\s+)?answer\\s*:\\s*)', '')) AS last_line, CASE WHEN category LIKE 'dynamics_speed%' THEN 'speed' ELSE 'path' END AS grp FROM scored""",
    "scores": f"WITH {SCORED} SELECT item, arm, round(prediction, 6) AS prediction, round(score, 6) AS score FROM scored",
    "family_stats": f"""WITH {SCORED}, {_sql_rho("scored", _C, "prediction", "reference_value")}, g AS (
  SELECT {_C}, count(*) AS n, count(prediction) AS parsed, count(DISTINCT prediction) AS n_distinct, count(DISTINCT prediction) <= 2 AS degenerate, coalesce(sum(score), 0) / count(*) AS tmra,
         median(prediction) AS prediction_median, median(reference_value) FILTER (prediction IS NOT NULL) AS reference_median FROM scored GROUP BY {_C}
) SELECT g.* EXCLUDE (tmra, prediction_median, reference_median), round(tmra, 6) AS tmra, round(rho, 6) AS rho, round(prediction_median, 6) AS prediction_median, round(reference_median, 6) AS reference_median FROM g LEFT JOIN rho USING ({_C})""",
    "spearman": f"WITH j AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey), {_sql_rho('j', 'o_orderpriority', 'o_totalprice', 'c_acctbal')} SELECT o_orderpriority, n, round(rho, 6) AS rho FROM rho",
    "partial_spearman": f"""WITH {_sql_rho("lineitem", "l_returnflag", "l_extendedprice", "l_discount", "xy")}, {_sql_rho("lineitem", "l_returnflag", "l_extendedprice", "l_quantity", "xz")}, {_sql_rho("lineitem", "l_returnflag", "l_discount", "l_quantity", "yz")}
SELECT l_returnflag, xy.n, round((xy.rho - xz.rho * yz.rho) / sqrt((1 - xz.rho * xz.rho) * (1 - yz.rho * yz.rho)), 6) AS partial FROM xy JOIN xz USING (l_returnflag) JOIN yz USING (l_returnflag)""",
    "best_constant": f"""WITH {A.PREDICTIONS}, radii AS (SELECT *, score_tolerance + s * greatest(abs(reference_value), score_floor) AS r FROM predictions, (SELECT unnest([{_S}]) AS s)
), points AS (SELECT {_C}, p, sum(d) AS d FROM (SELECT {_C}, reference_value + -1 * r AS p, 1 AS d FROM radii UNION ALL SELECT {_C}, reference_value + r, -1 FROM radii) GROUP BY ALL
), active AS (SELECT *, sum(d) OVER (PARTITION BY {_C} ORDER BY p ROWS UNBOUNDED PRECEDING) AS a, lead(p) OVER (PARTITION BY {_C} ORDER BY p) AS q FROM points
), best AS (SELECT {_C}, p + (q - p) / 2 AS mid, a, row_number() OVER (PARTITION BY {_C} ORDER BY a DESC, p) AS k FROM active WHERE p < p + (q - p) / 2 AND p + (q - p) / 2 < q
), n AS (SELECT {_C}, count(*) AS n FROM predictions GROUP BY {_C}) SELECT {_C}, round(mid, 6) AS "constant", round(10.0::DOUBLE * a / n, 6) AS tmra FROM best JOIN n USING ({_C}) WHERE k = 1""",
    "constant_median": f"""WITH {SCORED}, m AS (SELECT {_C}, median(reference_value) AS med FROM scored GROUP BY {_C}), c AS (SELECT *, {_sql_score("med", "reference_value", "score_tolerance", "score_floor")} AS cs FROM scored JOIN m USING ({_C}))
SELECT {_C}, round(med, 6) AS median, round(avg(cs), 6) AS constant_tmra, round(avg(coalesce(score, 0)) - avg(cs), 6) AS margin FROM c GROUP BY {_C}, med""",
    "distribution": f"""WITH {SCORED} SELECT {_C}, count(prediction) AS n, round(quantile_cont(prediction, 0.5), 6) AS median, round(quantile_cont(prediction, 0.25), 6) AS q1, round(quantile_cont(prediction, 0.75), 6) AS q3,
  round(min(prediction), 6) AS min, round(max(prediction), 6) AS max FROM scored GROUP BY {_C}""",
    "coverage_stats": f"""WITH {SCORED}, j AS (SELECT *, item % 13 <> 0 AS seen, CASE WHEN item % 13 <> 0 THEN prediction END AS p, CASE WHEN item % 13 <> 0 THEN score END AS s FROM scored
), g AS (SELECT {_C}, count(*) AS expected, count(*) FILTER (seen) AS observed, count(p) AS parsed, coalesce(sum(s), 0) AS s, avg(abs(p - reference_value)) AS mae FROM j GROUP BY {_C})
SELECT {_C}, expected, observed, parsed, observed - parsed AS invalid, expected - observed AS missing, round(s / nullif(observed, 0), 6) AS tmra_observed, round(s / nullif(parsed, 0), 6) AS tmra_parsed,
  CASE WHEN observed = expected THEN round(s / expected, 6) END AS tmra_all, round(s / expected, 6) AS tmra_lower_bound, round(mae, 6) AS mae FROM g""",
    "evaluate_summary": f"""WITH {A.PREDICTIONS}, r AS (
  SELECT CASE WHEN category LIKE 'dynamics_speed%' THEN 'speed' ELSE 'path' END AS grp, item % 13 <> 0 AS seen, raw_answer, CAST(CAST(reference_value AS DECIMAL(12,1)) AS VARCHAR) AS answer,
    try_cast(nullif(regexp_extract(raw_answer, '{fn.FIRST}'), '') AS DOUBLE) AS p, CAST(CAST(reference_value AS DECIMAL(12,1)) AS DOUBLE) AS g FROM predictions
), e AS (SELECT *, seen AND (lower(trim(raw_answer)) = answer OR coalesce(abs(p - g) < 1e-6, false)) AS ok, CASE grp WHEN 'speed' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS t, (NOT seen OR p IS NULL)::INT AS failed FROM r
), s AS (SELECT *, CASE WHEN ok THEN 1.0::DOUBLE WHEN seen AND p IS NOT NULL THEN list_sum(list_transform([{", ".join(repr(1.0 - x) + "::DOUBLE" for x in fn.THETAS)}], lambda q: CASE WHEN (abs(p - g) - t) / abs(g) < q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / 10 ELSE 0.0::DOUBLE END AS tm FROM e)
SELECT coalesce(grp, 'overall') AS grp, count(*) AS n, round(avg(seen::INT), 6) AS coverage, CAST(sum(failed) AS BIGINT) AS parse_failures, CAST(NULL AS DOUBLE) AS within_30cm, round(avg(ok::INT), 6) AS exact_accuracy, round(avg(tm), 6) AS tmra FROM s GROUP BY GROUPING SETS ((grp), ())""",
    "paired_ratio": f"""WITH {_PAIRS}, r AS (SELECT model, category, pc / pm AS r, rc / nullif(rm, 0) AS ref FROM wide WHERE pc IS NOT NULL AND pm > 0
), k AS (SELECT *, row_number() OVER (PARTITION BY model, category ORDER BY r) AS i, count(*) OVER (PARTITION BY model, category) AS n FROM r)
SELECT model, category, count(*) AS n, round(median(r), 6) AS median, round(median(r) FILTER (i <= n // 2), 6) AS q1, round(median(r) FILTER (i > (n + 1) // 2), 6) AS q3, round(median(ref), 6) AS reference_median FROM k GROUP BY model, category""",
    "correlation_drop": f"""WITH {_PAIRS}, both_parsed AS (SELECT * FROM wide WHERE pm IS NOT NULL AND pc IS NOT NULL), {_sql_rho("both_parsed", "model, category", "pm", "rm", "fa")}, {_sql_rho("both_parsed", "model, category", "pc", "rc", "fb")}
SELECT model, category, fa.n, round(fa.rho, 6) AS rho_full, round(fb.rho, 6) AS rho_other, round(fa.rho - fb.rho, 6) + 0 AS "drop" FROM fa JOIN fb USING (model, category)""",
    "common_cohort": f"WITH {SCORED} SELECT {_C}, count(*) AS n FROM scored WHERE item IN (SELECT item FROM scored WHERE prediction IS NOT NULL GROUP BY item HAVING count(DISTINCT arm) = 2) GROUP BY {_C}",
    "paired_contrast": f"""WITH {SCORED}, w AS (
  SELECT model, item, max((coalesce(score >= 60, false))::INT) FILTER (arm = 'm') AS a, max((coalesce(score >= 60, false) AND item % 5 <> 0)::INT) FILTER (arm = 'cm') AS b FROM scored GROUP BY ALL
), g AS (SELECT model, count(*) FILTER (a = 1 AND b = 1) AS "both", count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS neither FROM w GROUP BY model)
SELECT *, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END, 5) AS p FROM g""",
    "paired_relational": """WITH rows_ AS (
  SELECT conv_id % 4 AS fold, conv_id * 1000 + turn // 2 AS pair_id, turn % 2 = 0 AS o, CASE WHEN length(text) % 11 = 0 THEN NULL WHEN length(text) % 3 = 0 THEN 'b' WHEN length(text) % 7 = 0 THEN 'other' ELSE 'a' END AS l FROM conversations
), pairs AS (
  SELECT fold, pair_id, max(CASE WHEN o THEN l END) AS lo, max(CASE WHEN NOT o THEN l END) AS lt, count(l) AS items, count(*) - count(l) AS missing, count(*) FILTER ((o AND l = 'a') OR (NOT o AND l = 'b')) AS ok,
    count(*) FILTER (l = 'a') AS a, count(*) FILTER (l = 'b') AS b FROM rows_ GROUP BY ALL
) SELECT fold, count(*) FILTER (lo IS NOT NULL AND lt IS NOT NULL) AS n_pairs, CAST(sum(items) AS BIGINT) AS n_items, CAST(sum(missing) AS BIGINT) AS n_missing, round(sum(ok) / sum(items), 6) AS item_accuracy,
  round(count(*) FILTER (lo = 'a' AND lt = 'b') / count(*) FILTER (lo IS NOT NULL AND lt IS NOT NULL), 6) AS paired_accuracy, round(count(*) FILTER (lo = lt) / count(*) FILTER (lo IS NOT NULL AND lt IS NOT NULL), 6) AS same_letter_rate,
  round(sum(a) / sum(items), 6) AS rate_a, round(sum(b) / sum(items), 6) AS rate_b, round((sum(items) - sum(a) - sum(b)) / sum(items), 6) AS rate_other FROM pairs GROUP BY fold""",
    "bootstrap": f"""WITH {SCORED}, sums AS (
  SELECT *, row_number() OVER (PARTITION BY model, arm ORDER BY cl) - 1 AS j FROM (SELECT model, arm, item % 40 AS cl, sum(coalesce(score, 0)) AS s, count(*) AS n FROM scored GROUP BY ALL)
), size AS (SELECT model, arm, count(*) AS clusters, sum(s) / sum(n) AS point FROM sums GROUP BY ALL
), draws AS (SELECT *, unnest(range(1, clusters + 1)) AS draw FROM (SELECT *, unnest(range(1, {resample.B} + 1)) AS rep FROM size)
), drawn AS (SELECT model, arm, rep, CAST(floor({resample.draw_sql("rep", "draw")} * clusters / 4294967296) AS BIGINT) AS j FROM draws
), reps AS (SELECT model, arm, rep, sum(s) / sum(n) AS v FROM drawn JOIN sums USING (model, arm, j) GROUP BY ALL
), g AS (SELECT model, arm, list_sort(list(v)) AS vs FROM reps GROUP BY ALL)
SELECT model, arm, clusters, round(point, 6) AS point, round(vs[{int(0.025 * resample.B) + 1}], 6) AS lo, round(vs[{int(0.975 * resample.B)}], 6) AS hi, {resample.B} AS defined FROM g JOIN size USING (model, arm)""",
    "seed_spread": f"""WITH {SCORED}, c AS (SELECT {_C}, item % 3 AS seed, avg(score) AS v FROM scored GROUP BY ALL)
SELECT {_C}, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS "range" FROM c GROUP BY {_C}""",
    "conversion_classes": f"WITH {_PROBE} SELECT pair, diagnostic, class, count(*) AS n FROM classed GROUP BY ALL",
    "conversion_accuracy": f"""WITH {_PROBE}, g AS (SELECT pair, count(*) AS n, CAST(sum((class = 'correct')::INT) AS BIGINT) AS k FROM classed WHERE diagnostic GROUP BY GROUPING SETS ((pair), ()))
SELECT coalesce(pair, 'all') AS pair, n, k, round(greatest(0.0, ((k / n + 1.959964::DOUBLE ^ 2 / (2 * n)) - 1.959964::DOUBLE * sqrt(k / n * (1 - k / n) / n + 1.959964::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.959964::DOUBLE ^ 2 / n)), 6) AS lo,
  round(least(1.0, ((k / n + 1.959964::DOUBLE ^ 2 / (2 * n)) + 1.959964::DOUBLE * sqrt(k / n * (1 - k / n) / n + 1.959964::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.959964::DOUBLE ^ 2 / n)), 6) AS hi FROM g""",
}
