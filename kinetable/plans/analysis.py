"""Queries on rescoring, diagnostics and decision rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..operators import paired, rules, stats
from ..sources import adapters as A
from . import scoring
from .scoring import SCORED, _rounded, _scored, _sql_rho, _sql_score

CELL = ["model", "category"]


def _from_scored(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, scored=_scored(spark, sf_dir))


def legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.portable(spark, sf_dir, A.LEGACY, "orders").withColumn("grp", fn.map_group(F.col("category")))
    old, new = (fn.score_pair(F.col("grp"), F.col("vlm_answer"), F.col("answer"), v) for v in ("legacy_v1", "floor_v2"))
    out = r.select("k", "grp", old.alias("o"), new.alias("n"), fn.within_30cm(F.col("vlm_answer"), F.col("answer")).alias("near"), fn.conforms(F.col("grp"), F.col("vlm_answer"), F.col("answer")).alias("conforms"))
    return _rounded(out.select("k", "grp", F.col("o.exact").alias("exact"), F.col("o.tmra").alias("tmra_v1"), F.col("n.tmra").alias("tmra_v2"), "near", "conforms"))


def legacy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.evaluate_summary(A.portable(spark, sf_dir, A.LEGACY, "orders"), "floor_v2"))


def rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.rescore(_from_scored(spark, sf_dir, A.TRUTHS), CELL, "v3", "v1", "box_h"))


def truth_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.truth_ratios(_from_scored(spark, sf_dir, A.TRUTHS), CELL, "v3", "v1"))


def reference_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.reference_delta(_from_scored(spark, sf_dir, A.TRUTHS), CELL, "v3", "v1"))


def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.valid_pairs(A.portable(spark, sf_dir, A.LABELS, "orders"), ["cell"], "v3", "v1", "said"))


def _mode_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.family_stats(_from_scored(spark, sf_dir, A.MODES), ["model", "category", "unit", "mode"])


def frame_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    only = {"shuffle": ["dynamics_path_player"]}
    return _rounded(paired.frame_contrasts(_mode_cells(spark, sf_dir), ["model", "category", "unit"], "mode", "full", ["static4", "shuffle", "single_v2"], "category", only, ["rho", "tmra"]))


def prior_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.prior_diagnostics(_scored(spark, sf_dir), ["item"], CELL, "m", "cm"))


def conversion_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.conversion_diagnostic(_scored(spark, sf_dir), ["item"], CELL, 90.0, 110.0))


def exact_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(paired.exact_conversion(_scored(spark, sf_dir), ["item"], CELL, "m", "cm", 100.0))


def _second(rows: DataFrame) -> DataFrame:
    """Second-turn answers to the metre answers: every fifth isn't a number, others are a hundredfold, off by up to 4 %, or not converted."""
    p, k = F.col("prediction"), F.col("item") % 5
    said = F.when(k == 0, None).when(k == 1, p).when(k == 2, F.round(p * 104, 1)).otherwise(F.round(p * 100, 1))
    return rows.where("arm = 'm'").withColumns({"arm": F.lit("two"), "prediction": said})


def two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return _rounded(paired.two_stage_block(rows.unionByName(_second(rows)), ["item"], CELL, "m", "cm", "two", 100.0))


def arm_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    third = rows.where("arm = 'm'").withColumns({"arm": F.lit("zoom"), "prediction": F.when(F.col("item") % 6 != 0, F.round(F.col("prediction") * (1 + F.col("item") % 3), 3))})
    return _rounded(paired.arm_decomposition(rows.unionByName(third), ["item"], CELL, "m", "cm", "zoom"))


def ratio_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = paired.side_by_side(_scored(spark, sf_dir), [*CELL, "item"], "arm", ["m", "cm"], ["prediction"]).where("prediction_cm is not null and prediction_m > 0")
    return _rounded(paired.over_ratio_share(w.withColumn("r", F.col("prediction_cm") / F.col("prediction_m")), CELL, "r", 100.0))


def ratio_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = paired.item_ratio_shares(_scored(spark, sf_dir), ["item"], CELL)
    return _rounded(paired.cell_ranges(cells, ["category"], ["median", "share_2", "share_125"]))


def mode_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = paired.side_by_side(_scored(spark, sf_dir), [*CELL, "item"], "arm", ["m", "cm"], ["prediction", "reference_value"])
    rows = w.where("prediction_m is not null and prediction_cm is not null").select(*CELL, "item", F.col("prediction_m").alias("reading"), F.col("prediction_cm").alias("answer"))
    return _rounded(paired.mode_match(rows, w.select(*CELL, F.col("reference_value_cm").alias("target")), CELL, ["item"]))


def decimal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.predictions(spark, sf_dir)
    return _rounded(stats.decimal_summary(p.withColumn("answer", F.col("reference_value").cast("decimal(20,1)").cast("string")), ["model", "arm", "category"]))


def proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring._probe(spark, sf_dir).withColumn("class", fn.classify_conversion(F.col("prediction"), F.col("value"), F.col("factor"), F.col("target")))
    r = r.withColumns({"ok": F.col("class") == "correct", "direction": F.when(F.col("factor") > 1, "multiply").otherwise("divide"), "decade": fn.decade_of(F.col("value"))})
    return _rounded(stats.proportions(r.where(fn.is_diagnostic(F.col("value"), F.col("target"))), ["pair", "direction", "decade"], "ok", "class"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.reading_stats(A.portable(spark, sf_dir, A.READINGS, "orders"), CELL, "raw_answer", "expected", "reference_value"))


def _unit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, seed, category, parse_rate, degenerate, rho, ratio, factor) of cm answers over metre answers."""
    rows = _scored(spark, sf_dir).withColumn("seed", (F.col("item") % 3).cast("int"))
    cell = ["model", "seed", "category"]
    cm = stats.family_stats(rows.where("arm = 'cm'"), cell).select(*cell, (F.col("parsed") / F.col("n")).alias("parse_rate"), "degenerate", "rho", "n_distinct", "tmra")
    ratio = paired.paired_ratio(rows, ["item"], cell, "cm", "m").select(*cell, F.col("median").alias("ratio"))
    return cm.join(ratio, cell, "left").withColumn("factor", F.when(F.col("seed") == 2, 40.0).otherwise(100.0))


def converts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rules.converts(_unit_cells(spark, sf_dir)).select("model", "seed", "category", "parse_rate", "ratio", "converts", "converts_registered"))


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rules.converts(_unit_cells(spark, sf_dir)).where("not (model = 'model_2' and seed = 1)")
    plan = A.portable(spark, sf_dir, """SELECT CASE WHEN seed < 2 THEN 'H1_' ELSE 'H2_' END || model AS hypothesis, CASE WHEN seed < 2 THEN 3 ELSE 2 END AS need, CASE WHEN seed < 2 THEN 1 ELSE 0 END AS fail_max, model, seed, category FROM
      (SELECT DISTINCT 'model_' || CAST(o_custkey % 3 AS STRING) AS model, CAST(o_orderkey % 3 AS INT) AS seed, CASE WHEN o_orderkey % 2 = 0 THEN 'dynamics_speed_player' ELSE 'dynamics_path_player' END AS category FROM {orders})""", "orders")
    return rules.hypotheses(plan, cells, ["model", "seed", "category"])


def replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _unit_cells(spark, sf_dir)
    passes = (F.col("rho") >= 0.9) & (F.col("ratio") >= 99.5)
    return rules.replication_rule(cells, ["model"], F.col("degenerate") | ((F.col("seed") == 0) & (F.col("model") == "model_1")), passes, F.col("rho") < 0.9)


def seed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _unit_cells(spark, sf_dir).withColumn("v", F.when(F.col("ratio") >= 100.1, "replicates").when(F.col("ratio") < 100, "fails").otherwise("intermediate"))
    return rules.seed_label(c.where("not (model = 'model_0' and seed = 1)").select("model", "category", "seed", "v"), ["model", "category"], "v")


def noninferiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _unit_cells(spark, sf_dir)
    return _rounded(rules.noninferiority(c.where("seed = 0"), c.where("seed = 1"), ["model", "category"], 0.001))


def noninferiority_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each model and margin whether both families hold; model_2's path cell isn't there yet."""
    c = _unit_cells(spark, sf_dir).where("not (model = 'model_2' and category = 'dynamics_path_player')")
    plan = A.predictions(spark, sf_dir).select("model", "category").distinct().withColumn("hypothesis", F.col("model"))
    out = [rules.noninferiority_verdict(plan.withColumn("hypothesis", F.concat_ws("/", "model", F.lit(str(m)))), c.where("seed = 0"), c.where("seed = 1"), ["model", "category"], m) for m in (0.1, -1.0)]
    return out[0].unionByName(out[1])


def label_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("seed", (F.col("item") % 3).cast("int"))
    spread = stats.seed_spread(rows.groupBy("model", "category", "arm", "seed").agg(F.avg("score").alias("v")), ["model", "category", "arm"], "v")
    return _rounded(rules.label_verdict(spread, CELL, "arm", "cm", "m"))


def motion_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("seed", (F.col("item") % 3).cast("int")).where("not (model = 'model_2' and seed = 1)")
    cells = paired.correlation_drop(rows, ["item"], ["model", "seed", "category"], "m", "cm").withColumn("d", F.when((F.col("model") == "model_1") & (F.col("seed") > 0), None).otherwise(F.col("drop") + 1e-6))
    return rules.motion_rule(cells.withColumn("distinct", F.lit(9)), ["model"], "d", "distinct", 6)


def graded_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rules.converts(_unit_cells(spark, sf_dir)).withColumn("converts", F.col("converts") & ~((F.col("model") == "model_0") & (F.col("category") == "dynamics_path_player")))
    return rules.graded_rule(cells.where("not (model = 'model_1' and category = 'dynamics_speed_player' and seed = 0)"), ["model", "seed"])


def arithmetic_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumn("ok", F.coalesce(F.col("score") >= 70, F.lit(False)) & ~((F.col("arm") == "cm") & (F.col("item") % F.when(F.col("model") == "model_0", 300).otherwise(9) == 1)))
    c = paired.arm_vs_base(rows.where("arm = 'cm'"), rows.where("arm = 'm'"), ["item"], ["model"], "ok")
    both = c.select("*", F.explode(F.array(F.lit("tuned"), F.lit("mixed"))).alias("arm")).withColumn("only_base", F.when(F.col("arm") == "mixed", F.col("only_base") * (F.col("model") == "model_1").cast("int")).otherwise(F.col("only_base")))
    return rules.arithmetic_rule(both, ["model"], "arm", "tuned", "mixed")


def reader_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _from_scored(spark, sf_dir, A.TRUTHS).withColumn("px", (F.col("item") * 37 % 101 + 20 * F.col("v3")).cast("double"))
    return _rounded(paired.reader_partials(rows, CELL, "prediction", "v3", "px", "box_h"))


def dissociation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = paired.side_by_side(_scored(spark, sf_dir), [*CELL, "item"], "arm", ["m", "cm"], ["prediction"]).where("prediction_cm is not null and prediction_m > 0")
    r = w.withColumn("r", F.col("prediction_cm") / F.col("prediction_m"))
    return _rounded(paired.dissociation(r.where("category = 'dynamics_speed_player'"), r.where("category <> 'dynamics_speed_player' and model <> 'model_2'"), ["model"], "r", "r"))


QUERIES = {f.__name__: f for f in (
    reader_partials, dissociation,
    legacy_scores, legacy_evaluation, rescore, truth_ratios, reference_delta, valid_pairs, frame_contrasts, prior_diagnostics, conversion_diagnostic, exact_conversion, two_stage, arm_decomposition, ratio_shares, ratio_ranges,
    mode_match, decimal_summary, proportions, readings, converts, hypotheses, replication, seed_labels, noninferiority, noninferiority_verdict, label_verdict, arithmetic_rule, motion_rule, graded_rule,
)}

_LEGACY = A.LEGACY.format(orders="orders")
_NUM = "'[-+]?[0-9]*\\.?[0-9]+'"


def _steps(rel: str) -> str:
    return f"list_sum(list_transform([{', '.join(repr(1.0 - x) + '::DOUBLE' for x in fn.THETAS)}], lambda q: CASE WHEN {rel} < q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) / 10"


_JUDGED = f"""legacy AS ({_LEGACY}), numbered AS (
  SELECT *, CASE WHEN lower(category) LIKE 'distance_measurement%' THEN 'distance' WHEN lower(category) = 'localization' THEN 'localization' WHEN lower(category) LIKE 'spatial_counting%' THEN 'counting' WHEN lower(category) LIKE 'relational_reasoning%' THEN 'relational'
      WHEN category LIKE 'dynamics_speed%' THEN 'speed' WHEN category LIKE 'dynamics_path%' THEN 'path' WHEN category LIKE 'dynamics_time%' THEN 'timing' ELSE 'other' END AS grp,
    list_transform(regexp_extract_all(vlm_answer, {_NUM}), lambda x: CAST(x AS DOUBLE)) AS p, list_transform(regexp_extract_all(answer, {_NUM}), lambda x: CAST(x AS DOUBLE)) AS g FROM legacy
), specs(grp, t, f) AS (VALUES ('distance', 0.15::DOUBLE, 0.5::DOUBLE), ('speed', 0.3::DOUBLE, 1.0::DOUBLE), ('path', 0.5::DOUBLE, 2.0::DOUBLE), ('timing', 0.5::DOUBLE, 2.0::DOUBLE)
), matched AS (
  SELECT n.*, t, f, CASE WHEN n.grp = 'localization' THEN coalesce(len(p) >= 3 AND abs(p[1] - g[1]) < 1e-3 AND abs(p[2] - g[2]) < 1e-3 AND abs(p[3] - g[3]) < 1e-3, false)
    ELSE regexp_replace(lower(trim(vlm_answer)), '\\s+', ' ', 'g') = regexp_replace(lower(trim(answer)), '\\s+', ' ', 'g') OR coalesce(abs(p[1] - g[1]) < 1e-6, false) END AS exact FROM numbered n LEFT JOIN specs USING (grp)
), judged AS (
  SELECT *, CASE WHEN t IS NOT NULL THEN CASE WHEN exact THEN 1.0::DOUBLE WHEN p[1] IS NULL OR g[1] = 0 THEN 0.0::DOUBLE ELSE {_steps("(abs(p[1] - g[1]) - t) / abs(g[1])")} END
      WHEN grp = 'localization' THEN CASE WHEN exact THEN 1.0::DOUBLE WHEN len(p) < 3 THEN 0.0::DOUBLE ELSE ({" + ".join(f"CASE WHEN g[{i}] = 0 THEN 0.0::DOUBLE ELSE {_steps(f'(abs(p[{i}] - g[{i}]) - 0.3) / abs(g[{i}])')} END" for i in (1, 2, 3))}) / 3 END END AS v1,
    CASE WHEN t IS NOT NULL THEN CASE WHEN exact THEN 1.0::DOUBLE WHEN p[1] IS NULL THEN 0.0::DOUBLE ELSE {_steps("(abs(p[1] - g[1]) - t) / greatest(abs(g[1]), f)")} END
      WHEN grp = 'localization' THEN CASE WHEN exact THEN 1.0::DOUBLE WHEN len(p) < 3 THEN 0.0::DOUBLE ELSE ({" + ".join(_steps(f"(abs(p[{i}] - g[{i}]) - 0.3) / greatest(abs(g[{i}]), 1.0)") for i in (1, 2, 3))}) / 3 END END AS v2,
    coalesce(len(p) >= 3 AND len(g) >= 3 AND sqrt(pow(p[1] - g[1], 2) + pow(p[2] - g[2], 2) + pow(p[3] - g[3], 2)) <= 0.3, false) AS near FROM matched
)"""
_TRUTHS = f"{SCORED}, truths AS ({A.TRUTHS.format(scored='scored')})"
_CELL = "model, category"
_WIDE = f"""{SCORED}, wide AS (
  SELECT model, category, item, max(prediction) FILTER (arm = 'm') AS pm, max(prediction) FILTER (arm = 'cm') AS pc, max(reference_value) FILTER (arm = 'm') AS rm, max(reference_value) FILTER (arm = 'cm') AS rc, max(score) FILTER (arm = 'm') AS sm, max(score) FILTER (arm = 'cm') AS sc,
    max(score_tolerance) FILTER (arm = 'cm') AS tc, max(score_floor) FILTER (arm = 'cm') AS fc FROM scored GROUP BY ALL
)"""
_UNIT = f"""{_WIDE}, u AS (SELECT *, CAST(item % 3 AS INT) AS seed FROM wide
), {_sql_rho("u", "model, seed, category", "pc", "rc", "ur")}, uk AS (SELECT model, seed, category, pc / pm AS r FROM u WHERE pc IS NOT NULL AND pm > 0
), cells AS (
  SELECT model, seed, category, count(pc) / count(*) AS parse_rate, count(DISTINCT pc) <= 2 AS degenerate, rho, ratio, CASE WHEN seed = 2 THEN 40.0::DOUBLE ELSE 100.0::DOUBLE END AS factor
  FROM u LEFT JOIN ur USING (model, seed, category) LEFT JOIN (SELECT model, seed, category, median(r) AS ratio FROM uk GROUP BY ALL) USING (model, seed, category) GROUP BY ALL
), judged AS (SELECT *, parse_rate >= 0.5 AND NOT degenerate AND coalesce(rho >= 0.3, false) AND coalesce(ratio BETWEEN factor / 1.5 AND factor * 1.5, false) AS converts, parse_rate >= 0.5 AND NOT degenerate AND coalesce(rho >= 0.3, false) AND coalesce(ratio BETWEEN factor / 2 AND factor * 2, false) AS wider FROM cells)"""
ORACLES = {
    "legacy_scores": f"""WITH {_JUDGED} SELECT k, grp, exact, round(v1, 6) AS tmra_v1, round(v2, 6) AS tmra_v2, near, CASE WHEN grp IN ('relational', 'counting') THEN regexp_full_match(trim(vlm_answer), '[A-Da-d]') OR (regexp_full_match(trim(vlm_answer), '[0-9]+') AND regexp_full_match(trim(answer), '[0-9]+'))
  WHEN grp IN ('distance', 'path') THEN regexp_full_match(trim(vlm_answer), '[-+]?[0-9]*\\.?[0-9]+\\s*m?') WHEN grp = 'speed' THEN regexp_full_match(trim(vlm_answer), '[-+]?[0-9]*\\.?[0-9]+\\s*(m/s|mps)?') WHEN grp = 'timing' THEN regexp_full_match(trim(vlm_answer), '[-+]?[0-9]*\\.?[0-9]+\\s*(s|sec|seconds)?')
  WHEN grp = 'localization' THEN len(p) = 3 ELSE true END AS conforms FROM judged""",
    "legacy_evaluation": f"""WITH {_JUDGED}, e AS (SELECT grp, has_prediction AS seen, has_prediction AND exact AS ok, CASE WHEN v2 IS NOT NULL THEN CASE WHEN has_prediction THEN v2 ELSE 0.0::DOUBLE END END AS tm, CASE WHEN grp = 'localization' THEN (near AND has_prediction)::INT END AS near,
  ((grp = 'localization' AND (NOT has_prediction OR len(p) < 3)) OR (t IS NOT NULL AND (NOT has_prediction OR len(p) = 0)))::INT AS failed FROM judged)
SELECT coalesce(grp, 'overall') AS grp, count(*) AS n, round(avg(seen::INT), 6) AS coverage, CAST(sum(failed) AS BIGINT) AS parse_failures, round(avg(ok::INT), 6) AS exact_accuracy, round(avg(tm), 6) AS tmra, round(avg(near), 6) AS within_30cm FROM e GROUP BY GROUPING SETS ((grp), ())""",
    "rescore": f"""WITH {_TRUTHS}, {", ".join(_sql_rho("truths", _CELL, x, y, n) for n, x, y in (("a", "v1", "v3"), ("b", "v1", "box_h"), ("c", "v3", "box_h"), ("d", "prediction", "v1"), ("e", "prediction", "v3")))},
parsed_truths AS (SELECT * FROM truths WHERE prediction IS NOT NULL), {_sql_rho("parsed_truths", _CELL, "prediction", "box_h", "pz")}, {_sql_rho("parsed_truths", _CELL, "v3", "box_h", "yz")},
g AS (SELECT {_CELL}, count(*) AS n, avg(coalesce({_sql_score("prediction", "v1", "score_tolerance", "score_floor")}, 0)) AS t1, avg(coalesce({_sql_score("prediction", "v3", "score_tolerance", "score_floor")}, 0)) AS t3 FROM truths GROUP BY ALL)
SELECT model, category, g.n, round(t1, 6) AS tmra_old, round(t3, 6) AS tmra_new, round(a.rho, 6) AS rho_truths, round(b.rho, 6) AS rho_old_covariate, round(c.rho, 6) AS rho_new_covariate, round(d.rho, 6) AS rho_old, round(e.rho, 6) AS rho_new, round((e.rho - pz.rho * yz.rho) / sqrt((1 - pz.rho * pz.rho) * (1 - yz.rho * yz.rho)), 6) AS partial_new
FROM g JOIN a USING ({_CELL}) JOIN b USING ({_CELL}) JOIN c USING ({_CELL}) JOIN d USING ({_CELL}) JOIN e USING ({_CELL}) JOIN pz USING ({_CELL}) JOIN yz USING ({_CELL})""",
    "reader_partials": f"""WITH {_TRUTHS}, t AS (SELECT *, CAST(item * 37 % 101 + 20 * v3 AS DOUBLE) AS px FROM truths WHERE prediction IS NOT NULL), {", ".join(_sql_rho("t", _CELL, x, y, n) for n, x, y in (("pw", "prediction", "v3"), ("pp", "prediction", "px"), ("wp", "v3", "px"), ("ph", "prediction", "box_h"), ("wh", "v3", "box_h")))}
SELECT {_CELL}, pw.n, round((pw.rho - pp.rho * wp.rho) / sqrt((1 - pp.rho * pp.rho) * (1 - wp.rho * wp.rho)), 6) AS world_given_px, round((pp.rho - pw.rho * wp.rho) / sqrt((1 - pw.rho * pw.rho) * (1 - wp.rho * wp.rho)), 6) AS px_given_world,
  round((pw.rho - ph.rho * wh.rho) / sqrt((1 - ph.rho * ph.rho) * (1 - wh.rho * wh.rho)), 6) AS world_given_height FROM pw JOIN pp USING ({_CELL}) JOIN wp USING ({_CELL}) JOIN ph USING ({_CELL}) JOIN wh USING ({_CELL})""",
    "dissociation": f"""WITH {_WIDE}, r AS (SELECT model, category, pc / pm AS r FROM wide WHERE pc IS NOT NULL AND pm > 0), t AS (SELECT model, count(*) AS n, median(r) AS m, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.75) AS b FROM r WHERE category = 'dynamics_speed_player' GROUP BY 1), v AS (SELECT model, count(*) AS n, median(r) AS m FROM r WHERE category <> 'dynamics_speed_player' AND model <> 'model_2' GROUP BY 1)
SELECT model, coalesce(t.n, 0) AS text_n, round(t.m, 6) AS text_median, round(a, 6) AS text_q1, round(b, 6) AS text_q3, coalesce(v.n, 0) AS visual_n, round(v.m, 6) AS visual_median FROM t FULL JOIN v USING (model)""",
    "truth_ratios": f"""WITH {_TRUTHS}, r AS (SELECT {_CELL}, v3 / v1 AS r, row_number() OVER (PARTITION BY {_CELL} ORDER BY v3 / v1) - 1 AS i, count(*) OVER (PARTITION BY {_CELL}) AS t FROM truths WHERE v1 > 0)
SELECT {_CELL}, count(*) AS n, round(max(r) FILTER (i = floor(0.1::DOUBLE * t)), 6) AS p10, round(median(r), 6) AS median, round(max(r) FILTER (i = floor(0.9::DOUBLE * t) - 1), 6) AS p90 FROM r GROUP BY {_CELL}""",
    "reference_delta": f"""WITH {_TRUTHS}, {_sql_rho("truths", _CELL, "prediction", "v3", "a")}, {_sql_rho("truths", _CELL, "prediction", "v1", "b")},
d AS (SELECT {_CELL}, prediction, {_sql_score("prediction", "v3", "score_tolerance", "score_floor")} - {_sql_score("prediction", "v1", "score_tolerance", "score_floor")} AS d FROM truths), g AS (SELECT {_CELL}, count(*) AS observed, count(prediction) AS parsed, avg(coalesce(d, 0)) AS o, avg(d) AS p FROM d GROUP BY {_CELL})
SELECT {_CELL}, observed, parsed, round(o, 6) + 0 AS delta_observed, round(p, 6) + 0 AS delta_parsed, round(a.rho - b.rho, 6) + 0 AS delta_rho FROM g JOIN a USING ({_CELL}) JOIN b USING ({_CELL})""",
    "valid_pairs": f"""WITH l AS (SELECT *, upper(trim(coalesce(said, '')))[1:1] AS s FROM ({A.LABELS.format(orders="orders")})
), p AS (SELECT cell, pair_id, count(*) AS n, count(v3) AS k, count(DISTINCT v3) AS d, count(*) FILTER (v3 = v1) AS same, bool_and(coalesce(s = v1, false)) AS r1, bool_and(coalesce(s = v3, false)) AS r3 FROM l GROUP BY ALL
), v AS (SELECT *, n = 2 AND k = 2 AND d = 2 AS valid FROM p)
SELECT cell, count(*) AS pairs, count(*) FILTER (valid) AS valid, CAST(sum(same) AS BIGINT) AS label_agree, CAST(sum(n) AS BIGINT) AS n_items, round(count(*) FILTER (valid AND r1) / nullif(count(*) FILTER (valid), 0), 6) AS paired_old, round(count(*) FILTER (valid AND r3) / nullif(count(*) FILTER (valid), 0), 6) AS paired_new FROM v GROUP BY cell""",
    "frame_contrasts": f"""WITH {SCORED}, modes AS ({A.MODES.format(scored="scored")}), {_sql_rho("modes", "model, category, unit, mode", "prediction", "reference_value", "mr")},
c AS (SELECT model, category, unit, mode, rho, tmra FROM (SELECT model, category, unit, mode, coalesce(sum(score), 0) / count(*) AS tmra FROM modes GROUP BY ALL) LEFT JOIN mr USING (model, category, unit, mode))
SELECT a.model, a.category, a.unit, b.mode AS other, round(a.rho - b.rho, 6) + 0 AS rho, round(a.tmra - b.tmra, 6) + 0 AS tmra FROM c a JOIN c b ON a.model = b.model AND a.category = b.category AND a.unit = b.unit AND a.mode = 'full' AND b.mode <> 'full' WHERE b.mode <> 'shuffle' OR a.category = 'dynamics_path_player'""",
    "prior_diagnostics": f"""WITH {_WIDE}, w AS (SELECT * FROM wide WHERE pm IS NOT NULL AND pc IS NOT NULL), {_sql_rho("w", _CELL, "pm", "rm", "a")}, {_sql_rho("w", _CELL, "pc", "rm", "b")}, g AS (SELECT {_CELL}, count(*) AS n, median(pm) AS m, median(pc) AS c, avg(sc) - avg(sm) AS d FROM w GROUP BY ALL)
SELECT {_CELL}, g.n, round(m, 6) AS median_full, round(c, 6) AS median_other, round(d, 6) + 0 AS delta_tmra, round(c / nullif(m, 0), 6) AS ratio, round(a.rho, 6) AS rho_full, round(b.rho, 6) AS rho_other FROM g JOIN a USING ({_CELL}) JOIN b USING ({_CELL})""",
    "conversion_diagnostic": f"""WITH {_WIDE}, w AS (SELECT * FROM wide WHERE pc IS NOT NULL AND pm > 0), {_sql_rho("w", _CELL, "pc", "pm", "a")}, {_sql_rho("w", _CELL, "pc", "rc", "b")}, g AS (SELECT {_CELL}, count(*) AS n, avg((pc / pm BETWEEN 90 AND 110)::INT) AS s, median(pc) AS c, 100 * median(pm) AS m FROM w GROUP BY ALL)
SELECT {_CELL}, g.n, round(s, 6) AS share_converted, round(c, 6) AS cm_median, round(m, 6) AS m_median_x100, round(a.rho, 6) AS rho_cm_m, round(b.rho, 6) AS rho_cm_reference FROM g JOIN a USING ({_CELL}) JOIN b USING ({_CELL})""",
    "exact_conversion": f"""WITH {_WIDE}, w AS (SELECT *, pm * 100.0::DOUBLE AS x FROM wide WHERE rc IS NOT NULL), {_sql_rho("w", _CELL, "pc", "rc", "a")}, {_sql_rho("w", _CELL, "x", "rc", "b")}, g AS (SELECT {_CELL}, count(*) AS n, avg(coalesce({_sql_score("pc", "rc", "tc", "fc")}, 0)) AS d, avg(coalesce({_sql_score("x", "rc", "tc", "fc")}, 0)) AS c FROM w GROUP BY ALL)
SELECT {_CELL}, g.n, round(d, 6) AS tmra_direct, round(c, 6) AS tmra_converted, round(a.rho, 6) AS rho_direct, round(b.rho, 6) AS rho_converted FROM g JOIN a USING ({_CELL}) JOIN b USING ({_CELL})""",
    "two_stage": f"""WITH {_WIDE}, w AS (SELECT *, pm * 100.0::DOUBLE AS x, CASE item % 5 WHEN 0 THEN NULL WHEN 1 THEN pm WHEN 2 THEN round(pm * 104, 1) ELSE round(pm * 100, 1) END AS two FROM wide WHERE rc IS NOT NULL
), {_sql_rho("w", _CELL, "pc", "rc", "a")}, {_sql_rho("w", _CELL, "two", "rc", "b")}, {_sql_rho("w", _CELL, "x", "rc", "c")}, g AS (SELECT {_CELL}, count(*) AS n, count(pc) AS pd, count(two) AS pt, count(x) AS px, avg(coalesce({_sql_score("pc", "rc", "tc", "fc")}, 0)) AS d, avg(coalesce({_sql_score("two", "rc", "tc", "fc")}, 0)) AS t, avg(coalesce({_sql_score("x", "rc", "tc", "fc")}, 0)) AS c, median(two / x) FILTER (pm > 0) AS ratio FROM w GROUP BY ALL)
SELECT {_CELL}, g.n, pd AS parsed_direct, pt AS parsed_two_stage, px AS parsed_ceiling, round(d, 6) AS tmra_direct, round(t, 6) AS tmra_two_stage, round(g.c, 6) AS tmra_ceiling, round(a.rho, 6) AS rho_direct, round(b.rho, 6) AS rho_two_stage, round(c.rho, 6) AS rho_ceiling, round(ratio, 6) AS ratio FROM g JOIN a USING ({_CELL}) JOIN b USING ({_CELL}) JOIN c USING ({_CELL})""",
    "arm_decomposition": f"""WITH {_WIDE}, w AS (SELECT *, round(pm * (1 + item % 3), 3) AS pz FROM wide WHERE pm IS NOT NULL AND pc IS NOT NULL AND item % 6 <> 0), {", ".join(_sql_rho("w", _CELL, x, "rm", n) for n, x in (("a", "pm"), ("b", "pc"), ("c", "pz")))}
SELECT {_CELL}, a.n, round(a.rho, 6) AS rho_full, round(b.rho, 6) AS rho_context, round(c.rho, 6) AS rho_size, round(b.rho - a.rho, 6) + 0 AS d_context, round(c.rho - b.rho, 6) + 0 AS d_size, round(c.rho - a.rho, 6) + 0 AS d_total FROM a JOIN b USING ({_CELL}) JOIN c USING ({_CELL})""",
    "ratio_shares": f"WITH {_WIDE} SELECT {_CELL}, count(*) AS n, round(median(pc / pm), 6) AS median, round(quantile_cont(pc / pm, 0.25), 6) AS q1, round(quantile_cont(pc / pm, 0.75), 6) AS q3, round(avg((pc / pm > 100)::INT), 6) AS share_over FROM wide WHERE pc IS NOT NULL AND pm > 0 GROUP BY {_CELL}",
    "ratio_ranges": f"""WITH {_WIDE}, r AS (SELECT {_CELL}, pc / (100 * pm) AS r FROM wide WHERE pc IS NOT NULL AND pm > 0), c AS (SELECT {_CELL}, median(r) AS m, avg((r BETWEEN 0.5 AND 2)::INT) AS a, avg((r BETWEEN 0.8 AND 1.25)::INT) AS b FROM r GROUP BY ALL)
SELECT category, count(*) AS n_cells, round(min(m), 6) AS median_lo, round(max(m), 6) AS median_hi, round(min(a), 6) AS share_2_lo, round(max(a), 6) AS share_2_hi, round(min(b), 6) AS share_125_lo, round(max(b), 6) AS share_125_hi FROM c GROUP BY category""",
    "mode_match": f"""WITH {_WIDE}, x AS (SELECT {_CELL}, item, pm AS reading, pc AS answer FROM wide WHERE pm IS NOT NULL AND pc IS NOT NULL
), grid AS (SELECT DISTINCT {_CELL}, reading FROM x), t AS (SELECT {_CELL}, rc AS target, count(*) AS c FROM wide GROUP BY ALL
), b AS (SELECT t.model, t.category, target, c, arg_min(reading, (abs(reading - target / 100), reading)) AS reading FROM t JOIN grid ON t.model = grid.model AND t.category = grid.category GROUP BY ALL
), m AS (SELECT {_CELL}, reading, arg_max(target, (c, -target)) AS mode FROM b GROUP BY ALL), gm AS (SELECT {_CELL}, arg_max(target, (c, -target)) AS gmode FROM t GROUP BY ALL
), spelt AS (SELECT {_CELL}, CAST(reading AS VARCHAR) AS g, printf('%.1f', target) AS s, c FROM b UNION ALL SELECT {_CELL}, 'all', printf('%.1f', target), c FROM t
), node AS (SELECT {_CELL}, g, s[1:n] AS p, n, sum(c) AS w, coalesce(sum(c) FILTER (n = len(s)), 0) AS ends FROM (SELECT *, unnest(range(1, len(s) + 1)) AS n FROM spelt) GROUP BY ALL
), ch AS (SELECT *, row_number() OVER (PARTITION BY {_CELL}, g, p[1:n - 1] ORDER BY w DESC, p) AS rn FROM node
), ok AS (SELECT ch.model, ch.category, ch.g, ch.p, ch.n FROM ch LEFT JOIN node d ON d.model = ch.model AND d.category = ch.category AND d.g = ch.g AND d.p = ch.p[1:ch.n - 1] WHERE rn = 1 AND coalesce(d.ends, 0) <= ch.w
), way AS (SELECT a.model, a.category, a.g, a.p, a.n FROM ok a JOIN ok b ON a.model = b.model AND a.category = b.category AND a.g = b.g AND starts_with(a.p, b.p) GROUP BY ALL HAVING count(*) = a.n
), pg AS (SELECT {_CELL}, g, TRY_CAST(arg_max(p, n) AS DOUBLE) AS v FROM way GROUP BY ALL
), nt AS (SELECT grid.model, grid.category, reading, arg_min(target, (abs(target - 100 * reading), target)) AS nearest FROM grid JOIN t ON t.model = grid.model AND t.category = grid.category GROUP BY ALL)
SELECT {_CELL}, count(*) AS n, round(avg(coalesce(abs(coalesce(mode, gmode) - answer) < 0.05, false)::INT), 6) AS conditional_mode, round(avg(coalesce(abs(gmode - answer) < 0.05, false)::INT), 6) AS global_mode, round(avg(coalesce(abs(nearest - answer) < 0.05, false)::INT), 6) AS nearest_target,
  round(avg((abs(CAST(printf('%.1f', 100 * reading) AS DOUBLE) - answer) < 0.05)::INT), 6) AS exact_x100, round(avg(coalesce(abs(CASE WHEN mode IS NOT NULL THEN o.v ELSE w.v END - answer) < 0.05, false)::INT), 6) AS conditional_prefix, round(avg(coalesce(abs(w.v - answer) < 0.05, false)::INT), 6) AS global_prefix
FROM x LEFT JOIN m USING ({_CELL}, reading) JOIN gm USING ({_CELL}) LEFT JOIN nt USING ({_CELL}, reading) LEFT JOIN pg o ON o.model = x.model AND o.category = x.category AND o.g = CAST(x.reading AS VARCHAR) LEFT JOIN pg w ON w.model = x.model AND w.category = x.category AND w.g = 'all' GROUP BY {_CELL}""",
    "decimal_summary": f"""WITH {SCORED}, d AS (SELECT model, arm, category, CASE WHEN prediction IS NOT NULL THEN CAST(trim(raw_answer) AS DECIMAL(28,10)) END AS p, CAST(CAST(reference_value AS DECIMAL(20,1)) AS DECIMAL(28,10)) AS y FROM scored
), v AS (SELECT model, arm, category, p, count(*) AS c FROM d WHERE p IS NOT NULL GROUP BY ALL), l AS (SELECT model, arm, category, max(c) AS largest FROM v GROUP BY ALL)
SELECT model, arm, category, count(*) AS n, count(p) AS parsed, count(*) FILTER (p = y) AS exact, count(*) FILTER (p = 0) AS zero, count(*) FILTER (p < 0) AS negative, count(DISTINCT p) AS n_distinct, coalesce(max(largest), 0) AS largest_repeat, count(*) >= 2 AND count(p) = count(*) AND count(DISTINCT p) = 1 AS "constant",
  round(CAST(sum(abs(p - y)) AS DOUBLE) / nullif(count(p), 0), 6) AS mae FROM d LEFT JOIN l USING (model, arm, category) GROUP BY model, arm, category""",
    "proportions": f"""WITH {scoring._PROBE}, d AS (SELECT pair, CASE WHEN factor > 1 THEN 'multiply' ELSE 'divide' END AS direction, '1e' || CAST(floor(log10(value)) AS BIGINT) AS decade, class FROM classed WHERE diagnostic
), f AS (SELECT 'pair' AS factor, pair AS level, class FROM d UNION ALL SELECT 'direction', direction, class FROM d UNION ALL SELECT 'decade', decade, class FROM d UNION ALL SELECT 'all', 'all', class FROM d
), c AS (SELECT factor, level, class, count(*) AS c FROM f GROUP BY ALL), g AS (SELECT factor, level, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(c) FILTER (class = 'correct'), 0) AS BIGINT) AS k, string_agg(class || '=' || c, ',' ORDER BY class || '=' || c) AS classes FROM c GROUP BY ALL)
SELECT *, round(greatest(0.0, ((k / n + 1.959964::DOUBLE ^ 2 / (2 * n)) - 1.959964::DOUBLE * sqrt(k / n * (1 - k / n) / n + 1.959964::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.959964::DOUBLE ^ 2 / n)), 6) AS lo,
  round(least(1.0, ((k / n + 1.959964::DOUBLE ^ 2 / (2 * n)) + 1.959964::DOUBLE * sqrt(k / n * (1 - k / n) / n + 1.959964::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.959964::DOUBLE ^ 2 / n)), 6) AS hi FROM g""",
    "readings": f"""WITH r AS (SELECT *, regexp_extract(raw_answer, '^\\s*([+-]?[0-9]+(\\.[0-9]+)?)\\s*(m/s|m)\\s*->\\s*([+-]?[0-9]+(\\.[0-9]+)?)\\s*([A-Za-z/]+)\\s*\\.?\\s*$', ['a', 'b', 'c', 'd', 'e', 'f']) AS x FROM ({A.READINGS.format(orders="orders")})
), p AS (SELECT *, try_cast(nullif(x.a, '') AS DOUBLE) AS reading, try_cast(nullif(x.d, '') AS DOUBLE) AS value, nullif(x.f, '') AS unit FROM r), {_sql_rho("p", _CELL, "reading", "reference_value", "rr")},
g AS (SELECT {_CELL}, count(*) AS n, count(value) AS parsed, avg(CASE WHEN reading IS NOT NULL THEN (unit = expected)::INT END) AS u, median(value / reading) FILTER (reading > 0) AS v FROM p GROUP BY ALL)
SELECT {_CELL}, g.n, parsed, round(u, 6) AS unit_ok, round(v, 6) AS value_over_reading, round(rho, 6) AS reading_rho FROM g LEFT JOIN rr USING ({_CELL})""",
    "converts": f"WITH {_UNIT} SELECT model, seed, category, round(parse_rate, 6) AS parse_rate, round(ratio, 6) AS ratio, converts, wider AS converts_registered FROM judged",
    "hypotheses": f"""WITH {_UNIT}, plan AS (SELECT CASE WHEN seed < 2 THEN 'H1_' ELSE 'H2_' END || model AS hypothesis, CASE WHEN seed < 2 THEN 3 ELSE 2 END AS need, CASE WHEN seed < 2 THEN 1 ELSE 0 END AS fail_max, model, seed, category FROM cells
), g AS (SELECT hypothesis, need, fail_max, count(*) AS cells, count(*) FILTER (j.converts) AS k, count(*) FILTER (j.converts IS NULL) AS absent FROM plan LEFT JOIN (SELECT * FROM judged WHERE NOT (model = 'model_2' AND seed = 1)) j USING (model, seed, category) GROUP BY ALL)
SELECT hypothesis, cells, k, CASE WHEN absent > 0 THEN 'pending' WHEN k >= need THEN 'holds' WHEN k <= fail_max THEN 'fails' ELSE 'intermediate' END AS verdict FROM g""",
    "replication": f"""WITH {_UNIT}, g AS (SELECT model, count(*) FILTER (live) AS live, count(*) FILTER (live AND rho >= 0.9 AND ratio >= 99.5) AS passed, count(*) FILTER (live AND rho < 0.9) AS failed FROM (SELECT *, NOT (degenerate OR (seed = 0 AND model = 'model_1')) AS live FROM cells) GROUP BY model)
SELECT *, CASE WHEN live < 3 THEN 'LIMITED' WHEN passed >= 3 THEN 'replicates' WHEN failed >= 3 THEN 'fails' ELSE 'intermediate' END AS verdict FROM g""",
    "seed_labels": f"""WITH {_UNIT}, v AS (SELECT model, category, CASE WHEN ratio >= 100.1 THEN 'replicates' WHEN ratio < 100 THEN 'fails' ELSE 'intermediate' END AS v FROM cells WHERE NOT (model = 'model_0' AND seed = 1)
), g AS (SELECT model, category, count(*) AS n, count(*) FILTER (v = 'replicates') AS r, count(*) FILTER (v = 'fails') AS f FROM v GROUP BY ALL)
SELECT model, category, CASE WHEN n < 3 THEN 'pending' WHEN r = 3 THEN 'holds at all three seeds' WHEN r = 2 AND f = 0 THEN 'holds at two of three seeds' WHEN f >= 2 AND r = 0 THEN 'fails across seeds' WHEN r >= 1 AND f >= 1 THEN 'seed-dependent' ELSE 'not established' END AS label FROM g""",
    "noninferiority": f"WITH {_UNIT} SELECT a.model, a.category, round(a.rho, 6) AS rho, round(b.rho, 6) AS reference_rho, coalesce(a.rho >= b.rho - 0.001, false) AS ok FROM cells a JOIN cells b ON a.model = b.model AND a.category = b.category AND a.seed = 0 AND b.seed = 1",
    "noninferiority_verdict": f"""WITH {_UNIT}, there AS (SELECT * FROM cells WHERE NOT (model = 'model_2' AND category = 'dynamics_path_player')), p AS (SELECT DISTINCT model, category FROM wide), j AS (SELECT p.model, p.category, m, a.model IS NULL OR b.model IS NULL AS absent, coalesce(a.rho >= b.rho - m, false) AS ok
  FROM p CROSS JOIN (VALUES (0.1::DOUBLE), (-1.0::DOUBLE)) v(m) LEFT JOIN there a ON a.model = p.model AND a.category = p.category AND a.seed = 0 LEFT JOIN there b ON b.model = p.model AND b.category = p.category AND b.seed = 1)
SELECT model || '/' || CASE WHEN m > 0 THEN '0.1' ELSE '-1.0' END AS hypothesis, count(*) AS cells, count(*) FILTER (ok) AS k, CASE WHEN bool_or(absent) THEN 'pending' WHEN bool_and(ok) THEN 'holds' ELSE 'fails' END AS verdict FROM j GROUP BY model, m""",
    "label_verdict": f"""WITH {SCORED}, s AS (SELECT {_CELL}, arm, item % 3 AS seed, avg(score) AS v FROM scored GROUP BY ALL), p AS (SELECT {_CELL}, arm, avg(v) AS m, max(v) - min(v) AS r FROM s GROUP BY ALL)
SELECT a.model, a.category, round(a.m, 6) AS old_mean, round(b.m, 6) AS new_mean, round(b.m - a.m, 6) + 0 AS difference, round(greatest(a.r, b.r), 6) AS widest_range, abs(b.m - a.m) > greatest(a.r, b.r) AS exceeds FROM p a JOIN p b ON a.model = b.model AND a.category = b.category AND a.arm = 'm' AND b.arm = 'cm'""",
    "motion_rule": f"""WITH {_WIDE}, w AS (SELECT *, item % 3 AS seed FROM wide WHERE pm IS NOT NULL AND pc IS NOT NULL AND NOT (model = 'model_2' AND item % 3 = 1)), {_sql_rho("w", "model, seed, category", "pm", "rm", "a")}, {_sql_rho("w", "model, seed, category", "pc", "rc", "b")},
d AS (SELECT model, CASE WHEN model = 'model_1' AND seed > 0 THEN NULL ELSE a.rho - b.rho + 1e-6 END AS d FROM a JOIN b USING (model, seed, category)), g AS (SELECT model, count(*) AS cells, count(d) AS defined, count(*) FILTER (d > 0) AS positive FROM d GROUP BY model)
SELECT *, CASE WHEN cells < 6 THEN 'pending' WHEN defined < 3 THEN 'LIMITED' WHEN positive >= 3 THEN 'holds' ELSE 'fails' END AS verdict FROM g""",
    "graded_rule": f"""WITH {_UNIT}, g AS (SELECT model, seed, count(*) AS n, count(*) FILTER (converts AND NOT (model = 'model_0' AND category = 'dynamics_path_player')) AS k FROM judged WHERE NOT (model = 'model_1' AND category = 'dynamics_speed_player' AND seed = 0) GROUP BY ALL)
SELECT model, seed, k, CASE WHEN n < 2 THEN 'pending' WHEN k = 2 THEN 'fixed' WHEN k > 0 THEN 'partial' ELSE 'not fixed' END AS verdict FROM g""",
    "arithmetic_rule": f"""WITH {SCORED}, o AS (SELECT model, item, arm, coalesce(score >= 70, false) AND NOT (arm = 'cm' AND item % CASE WHEN model = 'model_0' THEN 300 ELSE 9 END = 1) AS ok FROM scored
), g AS (SELECT a.model, count(*) FILTER (a.ok AND NOT b.ok) AS x, count(*) FILTER (NOT a.ok AND b.ok) AS y FROM o a JOIN o b ON a.item = b.item AND a.model = b.model AND a.arm = 'cm' AND b.arm = 'm' GROUP BY 1
), p AS (SELECT *, CASE WHEN x + y = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(x, y) + 1), lambda i: exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))))) END AS p FROM g
), b AS (SELECT model, y > x AND p < 0.01 AS tuned, CASE WHEN model = 'model_1' THEN y ELSE 0 END > x AND p < 0.01 AS mixed FROM p) SELECT model, CASE WHEN NOT tuned THEN 'fails' WHEN NOT mixed THEN 'replicates' ELSE 'intermediate' END AS verdict FROM b""",
}
