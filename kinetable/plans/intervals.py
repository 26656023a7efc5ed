"""Queries on bootstrap intervals and probes, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import paired, probes, resample
from ..operators import geometry as geo
from ..sources import adapters as A
from . import trajectory
from .scoring import SCORED, _rounded, _scored, _sql_score

CELL = ["model", "category"]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model in every arm is a cell."""
    return _scored(spark, sf_dir).withColumns({"model": F.concat_ws("/", "model", "arm"), "cluster": F.col("item") % 40})


def bootstrap_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_cells(spark, sf_dir), CELL, "cluster", ["prediction", "reference_value"], resample.rho))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = paired.side_by_side(_scored(spark, sf_dir), [*CELL, "item"], "arm", ["m", "cm"], ["prediction", "reference_value"])
    names = {"denominator": "prediction_m", "numerator": "prediction_cm", "prediction": "prediction_m", "reference_value": "reference_value_m", "other": "prediction_cm", "other_reference": "reference_value_cm"}
    return w.select(*CELL, "item", (F.col("item") % 40).alias("cluster"), *(F.col(v).alias(k) for k, v in names.items()))


def bootstrap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_wide(spark, sf_dir), CELL, "cluster", ["numerator", "denominator"], resample.ratio))


def bootstrap_delta_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_wide(spark, sf_dir), CELL, "cluster", ["prediction", "reference_value", "other", "other_reference"], resample.delta_rho))


def bootstrap_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_wide(spark, sf_dir), CELL, "cluster", ["prediction", "reference_value", "other", "other_reference"], resample.common_delta_rho))


def bootstrap_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_cells(spark, sf_dir), CELL, "cluster", ["prediction", "reference_value", "score_tolerance", "score_floor"], resample.margin))


def bootstrap_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(resample.bootstrap(_cells(spark, sf_dir).withColumn("value", F.col("prediction")), CELL, "cluster", ["value"], resample.median))


def _speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = trajectory._base(spark, sf_dir)
    m = geo.body_metrics(det, clips).where("part = 'full' and path_m is not null")
    return m.select("seq", "track", "window_index", F.col("a").alias("f0"), "fps", F.round("speed", 1).alias("prediction"), F.round("path_m", 3).alias("reference_value"), F.round("median_h", 3).alias("covariate"))


def bootstrap_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speeds(spark, sf_dir).withColumns({"item": 1000 * F.col("track") + F.col("window_index"), "value": F.col("reference_value")})
    return _rounded(resample.bootstrap_items(rows, ["seq"], "item", ["value"], resample.mean))


def bootstrap_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speeds(spark, sf_dir).withColumn("item", 1000 * F.col("track") + F.col("window_index"))
    return _rounded(resample.bootstrap_items(rows, ["seq"], "item", ["prediction", "reference_value", "covariate"], resample.partial_rho))


def bootstrap_time_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _speeds(spark, sf_dir).withColumn("value", F.col("prediction"))
    out = [resample.bootstrap(rows.withColumn("block", resample.time_block(F.col("f0"), F.col("fps"), s)), ["seq"], "block", ["value"], resample.mean).withColumn("seconds", F.lit(s)) for s in (5, 10)]
    return _rounded(out[0].unionByName(out[1]))


def binomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).cast("int").alias("cell")).agg(F.count_if(F.col("o_orderkey") % 3 == 0).alias("k"), F.count(F.lit(1)).alias("n"))
    return _rounded(resample.binomial_bootstrap(rows, ["cell"], "k", "n"))


def _probe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 features (windows of an embedding) of about 500 items a cell in two clips; each third item of the first clip has a still
    mirror, which sees half of the embedding only."""
    e = A.table(spark, sf_dir, "embeddings").where("embedding is not null")
    cell = F.concat(F.lit("cell_"), F.pmod(F.floor(F.col("vec_id") / 25), F.lit(max(1, e.count() // 500))).cast("string"))
    y = F.log(F.abs(F.element_at("embedding", 1).cast("double") + F.element_at("embedding", 20)) + 0.05)
    items = e.select(cell.alias("cell"), F.col("vec_id").alias("item"), (F.col("vec_id") % 2).alias("clip"), (F.col("vec_id") % 25).alias("grp"), y.alias("y"), F.col("embedding").alias("v"))
    still = items.where("clip = 0 and item % 3 = 0").withColumns({"still": F.lit(True), "v": F.transform("v", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0)))})
    both = items.withColumn("still", F.lit(False)).unionByName(still)
    windows = F.array(*(F.struct(F.format_string("w%02d", F.lit(k)).alias("feature"), F.slice("v", 3 * k + 1, 16).alias("vec")) for k in range(16)))
    return both.withColumn("f", F.explode(windows)).select("cell", "f.feature", "item", "clip", "grp", "still", "f.vec", "y")


def ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, summary = probes.nested_ridge(_probe_features(spark, sf_dir), ["cell"])
    return _rounded(summary, 6)



QUERIES = {f.__name__: f for f in (bootstrap_rho, bootstrap_ratio, bootstrap_delta_rho, bootstrap_common, bootstrap_margin, bootstrap_median, bootstrap_items, bootstrap_partial, bootstrap_time_blocks, binomial, ridge_probe)}


def _reps(source: str, cell: str, cluster: str) -> str:
    """CTEs: each row of ``source`` (cell, cluster, ...) with the times it enters each replicate; replicate 0 is the source itself."""
    return f"""numbered AS (SELECT *, dense_rank() OVER (PARTITION BY {cell} ORDER BY {cluster}) - 1 AS j FROM {source}
), size AS (SELECT {cell}, count(DISTINCT j) AS clusters FROM numbered GROUP BY ALL
), draws AS (SELECT *, unnest(range(1, clusters + 1)) AS draw FROM (SELECT *, unnest(range(1, {resample.B} + 1)) AS rep FROM size)
), drawn AS (SELECT {cell}, rep, j, count(*) AS times FROM (SELECT {cell}, rep, CAST(floor({resample.draw_sql("rep", "draw")} * clusters / 4294967296) AS BIGINT) AS j FROM draws) GROUP BY ALL
), used AS (SELECT {cell}, rep, j, times FROM drawn UNION ALL SELECT DISTINCT {cell}, 0, j, 1 FROM numbered)"""


def _picks(cell: str, more: str = "") -> str:
    """Intervals of reps (cell, rep, v)."""
    return f"""g AS (SELECT {cell}, max(v) FILTER (rep = 0) AS point, list_sort(list(v) FILTER (rep > 0 AND v IS NOT NULL)) AS vs FROM reps GROUP BY {cell})
SELECT {cell}, clusters, round(point, 6) AS point, CASE WHEN len(vs) >= {0.9 * resample.B} THEN round(vs[CAST(floor(0.025 * len(vs)) AS INT) + 1], 6) END AS lo, CASE WHEN len(vs) >= {0.9 * resample.B} THEN round(vs[CAST(floor(0.975 * len(vs)) AS INT)], 6) END AS hi, CAST(len(vs) AS INT) AS defined{more} FROM g JOIN size USING ({cell})"""


def _rho_reps(x: str, y: str, name: str) -> str:
    """CTE {name} (model, category, rep, rho) of weighted rank correlations, by way of the marginal counts of each value."""
    side = lambda v, t: f"""{t} AS (SELECT model, category, rep, v, sum(n) OVER o - n + (n + 1) / 2.0::DOUBLE AS r FROM (SELECT model, category, rep, {v} AS v, sum(n) AS n FROM {name}_w GROUP BY ALL) WINDOW o AS (PARTITION BY model, category, rep ORDER BY v ROWS UNBOUNDED PRECEDING))"""
    return f"""{name}_d AS (SELECT model, category, j, {x} AS x, {y} AS y, count(*) AS c FROM numbered WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL
), {name}_w AS (SELECT model, category, rep, x, y, sum(times * c) AS n FROM used JOIN {name}_d USING (model, category, j) GROUP BY ALL
), {side("x", name + "_x")}, {side("y", name + "_y")}, {name}_s AS (
  SELECT model, category, rep, sum(n) AS n, sum(n * a.r) AS sa, sum(n * b.r) AS sb, sum(n * a.r * a.r) AS saa, sum(n * b.r * b.r) AS sbb, sum(n * a.r * b.r) AS sab
  FROM {name}_w w JOIN {name}_x a USING (model, category, rep) JOIN {name}_y b USING (model, category, rep) WHERE a.v = w.x AND b.v = w.y GROUP BY ALL
), {name} AS (SELECT model, category, rep, CASE WHEN n >= 3 AND saa - sa * sa / n > 0 AND sbb - sb * sb / n > 0 THEN (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)) END AS rho FROM {name}_s)"""


def _median_reps(cell: str) -> str:
    """CTE reps of weighted medians of ``x`` in numbered (cell, j, x)."""
    return f"""d AS (SELECT {cell}, j, x, count(*) AS c FROM numbered WHERE x IS NOT NULL GROUP BY ALL
), w AS (SELECT {cell}, rep, x, sum(times * c) AS n FROM used JOIN d USING ({cell}, j) GROUP BY ALL
), u AS (SELECT *, sum(n) OVER (PARTITION BY {cell}, rep ORDER BY x ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY {cell}, rep) AS t FROM w
), reps AS (SELECT {cell}, rep, (max(x) FILTER ((t - 1) // 2 >= hi - n AND (t - 1) // 2 < hi) + max(x) FILTER (t // 2 >= hi - n AND t // 2 < hi)) / 2 AS v FROM u GROUP BY ALL)"""


def _mean_reps(cell: str) -> str:
    return f"""d AS (SELECT {cell}, j, sum(coalesce(x, 0)) AS s, count(*) AS c FROM numbered GROUP BY ALL), reps AS (SELECT {cell}, rep, sum(times * s) / sum(times * c) AS v FROM used JOIN d USING ({cell}, j) GROUP BY ALL)"""


_M = f"{SCORED}, src AS (SELECT * REPLACE (model || '/' || arm AS model), item % 40 AS cl FROM scored)"
_W = f"""{SCORED}, src AS (SELECT model, category, item, item % 40 AS cl, max(prediction) FILTER (arm = 'm') AS pm, max(prediction) FILTER (arm = 'cm') AS pc, max(reference_value) FILTER (arm = 'm') AS rm, max(reference_value) FILTER (arm = 'cm') AS rc FROM scored GROUP BY ALL)"""
_SPEEDS = f"{trajectory.METRICS}, speeds AS (SELECT seq, track, window_index, a AS f0, round(speed, 1) AS p, round(path_m, 3) AS y FROM metrics WHERE part = 'full' AND path_m IS NOT NULL)"
_MC = "model, category"
ORACLES = {
    "bootstrap_rho": f"WITH {_M}, {_reps('src', _MC, 'cl')}, {_rho_reps('prediction', 'reference_value', 'rr')}, reps AS (SELECT model, category, rep, rho AS v FROM rr), {_picks(_MC)}",
    "bootstrap_delta_rho": f"WITH {_W}, {_reps('src', _MC, 'cl')}, {_rho_reps('pm', 'rm', 'ra')}, {_rho_reps('pc', 'rc', 'rb')}, reps AS (SELECT model, category, rep, ra.rho - rb.rho AS v FROM ra JOIN rb USING (model, category, rep)), {_picks(_MC).replace('round(', '0 + round(')}",
    "bootstrap_common": f"WITH {_W}, {_reps('src', _MC, 'cl')}, {_rho_reps('CASE WHEN pc IS NOT NULL THEN pm END', 'rm', 'ra')}, {_rho_reps('CASE WHEN pm IS NOT NULL THEN pc END', 'rc', 'rb')}, reps AS (SELECT model, category, rep, ra.rho - rb.rho AS v FROM ra JOIN rb USING (model, category, rep)), {_picks(_MC).replace('round(', '0 + round(')}",
    "bootstrap_margin": f"""WITH {_M}, {_reps('src', _MC, 'cl')}, own AS (SELECT {_MC}, j, sum(score) AS s, count(*) AS c FROM numbered WHERE prediction IS NOT NULL GROUP BY ALL), o AS (SELECT {_MC}, rep, sum(times * s) / sum(times * c) AS own FROM used JOIN own USING ({_MC}, j) GROUP BY ALL
), ys AS (SELECT {_MC}, j, reference_value AS y, score_tolerance AS t, score_floor AS e, count(*) AS c FROM numbered WHERE prediction IS NOT NULL GROUP BY ALL), w AS (SELECT {_MC}, rep, y, t, e, sum(times * c) AS n FROM used JOIN ys USING ({_MC}, j) GROUP BY ALL
), u AS (SELECT *, sum(n) OVER (PARTITION BY {_MC}, rep ORDER BY y ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY {_MC}, rep) AS total FROM w
), m AS (SELECT {_MC}, rep, (max(y) FILTER ((total - 1) // 2 >= hi - n AND (total - 1) // 2 < hi) + max(y) FILTER (total // 2 >= hi - n AND total // 2 < hi)) / 2 AS med FROM u GROUP BY ALL
), k AS (SELECT {_MC}, rep, sum(n * {_sql_score("med", "y", "t", "e")}) / sum(n) AS best FROM w JOIN m USING ({_MC}, rep) GROUP BY ALL), reps AS (SELECT {_MC}, rep, own - best AS v FROM o JOIN k USING ({_MC}, rep)), {_picks(_MC)}""",
    "bootstrap_partial": f"""WITH {_SPEEDS}, src AS (SELECT s.*, 1000 * s.track + s.window_index AS item, round(m.median_h, 3) AS z FROM speeds s JOIN metrics m ON m.seq = s.seq AND m.track = s.track AND m.window_index = s.window_index AND part = 'full'), {_reps('src', 'seq', 'item')}
, w AS (SELECT seq, rep, p, y, z, times AS n FROM used JOIN numbered USING (seq, j) WHERE p IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL
), ties AS (SELECT *, {", ".join(f"sum(n) OVER (PARTITION BY seq, rep ORDER BY {v} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_{v}, sum(n) OVER (PARTITION BY seq, rep, {v}) AS tie_{v}" for v in "pyz")} FROM w
), r AS (SELECT seq, rep, n, {", ".join(f"up_{v} - tie_{v} + (tie_{v} + 1) / 2.0::DOUBLE AS {v}" for v in "pyz")} FROM ties
), s AS (SELECT seq, rep, sum(n) AS n, {", ".join(f"sum(n * {a} * {b}) - sum(n * {a}) * sum(n * {b}) / sum(n) AS {a}{b}" for a, b in ("pp", "yy", "zz", "py", "pz", "yz"))} FROM r GROUP BY ALL
), c AS (SELECT seq, rep, n, CASE WHEN pp > 0 AND yy > 0 THEN py / sqrt(pp * yy) END AS a, coalesce(CASE WHEN pp > 0 AND zz > 0 THEN pz / sqrt(pp * zz) END, 0) AS b, coalesce(CASE WHEN yy > 0 AND zz > 0 THEN yz / sqrt(yy * zz) END, 0) AS d FROM s
), reps AS (SELECT seq, rep, CASE WHEN n >= 4 AND (1 - b * b) * (1 - d * d) > 1e-12 THEN (a - b * d) / sqrt((1 - b * b) * (1 - d * d)) END AS v FROM c), {_picks('seq')}""",
    "bootstrap_ratio": f"WITH {_W}, ratios AS (SELECT *, CASE WHEN pm > 0 THEN pc / pm END AS x FROM src), {_reps('ratios', _MC, 'cl')}, {_median_reps(_MC)}, {_picks(_MC)}",
    "bootstrap_median": f"WITH {_M}, vals AS (SELECT model, category, cl, prediction AS x FROM src), {_reps('vals', _MC, 'cl')}, {_median_reps(_MC)}, {_picks(_MC)}",
    "bootstrap_items": f"WITH {_SPEEDS}, vals AS (SELECT seq, 1000 * track + window_index AS item, y AS x FROM speeds), {_reps('vals', 'seq', 'item')}, {_mean_reps('seq')}, {_picks('seq')}",
    "bootstrap_time_blocks": f"""WITH both_blocks AS (SELECT 1), {_SPEEDS}, vals AS (SELECT seq || '/' || s AS cell, CAST(floor(f0 / 30.0::DOUBLE / s) AS BIGINT) AS cl, p AS x FROM speeds, (VALUES (5), (10)) b(s)), {_reps('vals', 'cell', 'cl')}, {_mean_reps('cell')}, out_ AS (WITH {_picks('cell')})
SELECT split_part(cell, '/', 1) AS seq, CAST(split_part(cell, '/', 2) AS INT) AS seconds, * EXCLUDE (cell) FROM out_""",
    "binomial": f"""WITH c AS (SELECT CAST(o_custkey % 40 AS INT) AS cell, count(*) FILTER (o_orderkey % 3 = 0) AS k, count(*) AS n FROM orders GROUP BY 1
), d AS (SELECT *, unnest(range(0, n)) AS draw FROM (SELECT *, unnest(range(1, {resample.BINOMIAL + 1})) AS rep FROM c)
), t AS ({resample.trials_sql("d")}), v AS (SELECT cell, n, k / n AS share, rep, count(*) FILTER (h < k / n * 4294967296) / n AS v FROM t GROUP BY cell, n, k, rep
), g AS (SELECT cell, n, share, list_sort(list(v)) AS vs FROM v GROUP BY ALL)
SELECT cell, n, round(share, 6) AS share, round(vs[{int(0.025 * resample.BINOMIAL) + 1}], 6) AS lo, round(vs[{int(0.975 * resample.BINOMIAL)}], 6) AS hi FROM g""",
}
