"""Further queries on trajectories and logs, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry as geo
from ..operators import more_geometry as more
from ..operators import paired
from ..sources import adapters as A
from . import scoring, trajectory


def _r(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _paths(spark: SparkSession, sf_dir: str):
    det, clips, _ = trajectory._base(spark, sf_dir)
    m = geo.body_metrics(det, clips).where("part = 'full'").select("seq", "track", "window_index", F.col("path_px").alias("path"))
    court = geo.court_metrics(det, clips, A.homographies(clips)).select("seq", "track", "window_index", F.round("path_m", 6).alias("path"))
    return clips, m, court


def clip_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, px, m = _paths(spark, sf_dir)
    return _r(more.clip_scale(px.where("path is not null"), m, 0.5, least_m=0.05), 5)


def px_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips, px, _ = _paths(spark, sf_dir)
    return _r(more.px_answers(px, clips, 2.0))


def dense_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = A.detections(spark, sf_dir)
    pitch = geo.to_court(geo.foot_points(det), A.homographies(A.clips(det)), "fx", "fy").select("seq", "track", "frame", F.col("cx").alias("pitch_x"), F.col("cy").alias("pitch_y"))
    return _r(more.dense_windows(det.join(pitch, ["seq", "track", "frame"]), frames=16, hop=8))


def crop_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, _, w = trajectory._base(spark, sf_dir)
    frames = w.select("seq", "window_index", F.explode("frames").alias("frame"))
    return more.crop_rect(det.join(frames, ["seq", "frame"]), ["seq", "track", "window_index"], 1920, 1080, 320, 130, 0.9)


def accel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = trajectory._base(spark, sf_dir)
    return _r(more.accel_events(geo.body_metrics(det, clips)))


def accel_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = trajectory._base(spark, sf_dir)
    return more.accel_visual(more.accel_events(geo.body_metrics(det, clips)))


def item_ratio_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(paired.item_ratio_shares(scoring._scored(spark, sf_dir), ["item"], ["model", "category"]))


def align_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.predictions(spark, sf_dir)
    return paired.align_predictions(p.select("item", "arm", "category"), p.where("item % 5 <> 0").select("item", "arm", "raw_answer"), ["item", "arm"])


def arm_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring._scored(spark, sf_dir).withColumn("ok", F.coalesce(F.col("score") >= 70, F.lit(False)) & ~((F.col("arm") == "cm") & (F.col("item") % 300 == 1)))
    return _r(paired.arm_vs_base(rows.where("arm = 'cm'"), rows.where("arm = 'm'"), ["item"], ["model"], "ok"), 5)


def paired_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring._scored(spark, sf_dir).where("not (arm = 'cm' and item % 19 = 0)")
    return _r(paired.paired_statistics(rows, ["item"], ["model", "category"], "cm", "m"))


QUERIES = {
    "clip_scale": clip_scale, "px_answers": px_answers, "dense_windows": dense_windows, "crop_rects": crop_rects, "accel_events": accel_events, "accel_visual": accel_visual, "item_ratio_shares": item_ratio_shares,
    "align_predictions": align_predictions, "arm_vs_base": arm_vs_base, "paired_statistics": paired_statistics,
}
#: Pairs of windows by the greedy choice: the best pair that is left, one after the other. Needs WITH RECURSIVE.
VISUAL = f"""{trajectory.METRICS}, e AS (SELECT seq, track, window_index, max(a) FILTER (part = 'first') AS a, max(b) FILTER (part = 'second') AS b, max(speed) FILTER (part = 'first') AS v1, max(speed) FILTER (part = 'second') AS v2 FROM metrics GROUP BY ALL
), ev AS (SELECT *, v2 > v1 AS up FROM e WHERE v1 > 0 AND v2 > 0 AND greatest(v1, v2) / least(v1, v2) >= 1.35
), cand AS (SELECT u.seq, u.track, abs(u.window_index - d.window_index) AS gap, CAST(u.window_index AS INT) AS u, CAST(d.window_index AS INT) AS d FROM ev u JOIN ev d ON u.seq = d.seq AND u.track = d.track AND u.up AND NOT d.up AND (u.b < d.a OR d.b < u.a)
), chosen AS (SELECT DISTINCT seq, track, 0 AS n, []::INT[] AS ups, []::INT[] AS downs FROM cand
  UNION ALL SELECT c.seq, c.track, n + 1, list_append(any_value(ups), arg_min(u, (gap, u, d))), list_append(any_value(downs), arg_min(d, (gap, u, d))) FROM chosen c JOIN cand ON cand.seq = c.seq AND cand.track = c.track WHERE NOT list_contains(ups, u) AND NOT list_contains(downs, d) GROUP BY c.seq, c.track, n
), visual AS (SELECT seq, track, CAST(n - 1 AS INT) AS k, ups[n] AS up, downs[n] AS down FROM chosen WHERE n > 0)"""
_COURT = trajectory.ORACLES["court_metrics"].removeprefix("WITH ")
ORACLES = {
    "clip_scale": f"""WITH {trajectory.METRICS}, court AS (WITH {_COURT}), r AS (SELECT m.seq, path_px * 0.5 / c.path_m AS k FROM metrics m JOIN court c ON m.seq = c.seq AND m.track = c.track AND m.window_index = c.window_index WHERE part = 'full' AND path_px IS NOT NULL AND c.path_m >= 0.05
), g AS (SELECT seq, count(*) AS n, median(k) AS k, list_sort(list(k)) AS ks FROM r GROUP BY seq), s AS (SELECT seq, n, k, (ks[3 * n // 4 + 1] - ks[n // 4 + 1]) / k AS spread FROM g)
SELECT seq, n, round(k, 5) AS k, round(spread, 5) AS spread, n >= 20 AND spread <= 0.05 AS ok FROM s""",
    "px_answers": f"WITH {trajectory.METRICS} SELECT seq, track, window_index, round(path_px * 960.0::DOUBLE / 1920, 6) AS path_px, round(path_px * 960.0::DOUBLE / 1920 / 2, 6) AS speed_px FROM metrics WHERE part = 'full' AND path_px IS NOT NULL",
    "dense_windows": f"""WITH {A.DETECTIONS}, e AS (SELECT *, unnest(range(greatest(0, CAST(ceil((frame - 16) / 8.0) AS INT)), (frame - 1) // 8 + 1)) AS window_index FROM detections
), p AS (SELECT *, avg(x + w / 2) OVER n AS sx, avg(y + h) OVER n AS sy, avg((0.01::DOUBLE * (x + w / 2) + 0.001::DOUBLE * (y + h) - 5) / (0.00001::DOUBLE * (x + w / 2) + 0.0004::DOUBLE * (y + h) + 1)) OVER n AS mx, avg((0.0005::DOUBLE * (x + w / 2) + 0.02::DOUBLE * (y + h) - 3) / (0.00001::DOUBLE * (x + w / 2) + 0.0004::DOUBLE * (y + h) + 1)) OVER n AS my, h >= 40 AND x >= 10 AND y >= 10 AND x + w <= 1910 AND y + h <= 1070 AS ok FROM e WINDOW n AS (PARTITION BY seq, track, window_index ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
), s AS (SELECT *, sqrt(pow(sx - lag(sx) OVER o, 2) + pow(sy - lag(sy) OVER o, 2)) AS step, sqrt(pow(mx - lag(mx) OVER o, 2) + pow(my - lag(my) OVER o, 2)) AS step_m FROM p WINDOW o AS (PARTITION BY seq, track, window_index ORDER BY frame))
SELECT seq, track, CAST(window_index AS INT) AS window_index, round(sum(step), 6) AS path, round(sum(step_m), 6) AS path_m FROM s GROUP BY ALL HAVING count(*) = 16 AND bool_and(ok)""",
    "crop_rects": f"""WITH {A.DETECTIONS}, {trajectory.WINDOWS}, f AS (SELECT seq, window_index, unnest([f0, f0 + 20, f0 + 40, f0 + 60]) AS frame FROM windows
), g AS (SELECT seq, track, window_index, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM detections JOIN f USING (seq, frame) GROUP BY ALL
), k AS (SELECT *, x1 - x0 <= 320 * 0.9 AND y1 - y0 <= 130 * 0.9 AS ok FROM g)
SELECT seq, track, window_index, CASE WHEN ok THEN round_even(least(greatest((x0 + x1) / 2 - 160, 0), 1600), 0) END AS "left", CASE WHEN ok THEN round_even(least(greatest((y0 + y1) / 2 - 65, 0), 950), 0) END AS top, CASE WHEN ok THEN 320.0::DOUBLE END AS w, CASE WHEN ok THEN 130.0::DOUBLE END AS h FROM k""",
    "accel_visual": f"WITH RECURSIVE {VISUAL} SELECT seq, track, k, up, down FROM visual",
    "accel_events": f"""WITH {trajectory.METRICS}, e AS (SELECT seq, track, window_index, max(a) FILTER (part = 'first') AS a, max(b) FILTER (part = 'second') AS b, max(speed) FILTER (part = 'first') AS v1, max(speed) FILTER (part = 'second') AS v2 FROM metrics GROUP BY ALL)
SELECT seq, track, window_index, a, b, round(v1, 6) AS v1, round(v2, 6) AS v2, v2 > v1 AS up FROM e WHERE v1 > 0 AND v2 > 0 AND greatest(v1, v2) / least(v1, v2) >= 1.35""",
    "item_ratio_shares": f"""WITH {scoring._PAIRS}, r AS (SELECT model, category, pc, CASE WHEN pm > 0 THEN pc / (100 * pm) END AS r FROM wide WHERE rm IS NOT NULL AND rc IS NOT NULL)
SELECT model, category, count(*) AS n_items, count(r) AS n, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.25), 6) AS q1, round(quantile_cont(r, 0.75), 6) AS q3, round(avg((r BETWEEN 0.5 AND 2)::INT), 6) AS share_2, round(avg((r BETWEEN 0.8 AND 1.25)::INT), 6) AS share_125,
  count(DISTINCT pc) AS distinct_cm FROM r GROUP BY model, category""",
    "align_predictions": f"WITH {A.PREDICTIONS} SELECT item, arm, category, CASE WHEN item % 5 <> 0 THEN raw_answer END AS raw_answer, item % 5 <> 0 AS observed FROM predictions",
    "arm_vs_base": f"""WITH {scoring.SCORED}, o AS (SELECT model, item, arm, coalesce(score >= 70, false) AND NOT (arm = 'cm' AND item % 300 = 1) AS ok FROM scored
), g AS (SELECT a.model, count(*) FILTER (a.ok AND NOT b.ok) AS only_arm, count(*) FILTER (NOT a.ok AND b.ok) AS only_base FROM o a JOIN o b ON a.item = b.item AND a.arm = 'cm' AND b.arm = 'm' GROUP BY 1)
SELECT *, round(CASE WHEN only_arm + only_base = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_arm, only_base) + 1), lambda i: exp(lgamma(only_arm + only_base + 1) - lgamma(i + 1) - lgamma(only_arm + only_base - i + 1) - (only_arm + only_base) * ln(2))))) END, 5) AS p FROM g""",
    "paired_statistics": f"""WITH {scoring.SCORED}, w AS (
  SELECT a.model, a.category, a.prediction AS pa, b.prediction AS pb, a.reference_value AS ra, b.reference_value AS rb, a.reference_value / nullif(b.reference_value, 0) AS ex, coalesce(a.score, 0) - coalesce(b.score, 0) AS d FROM scored a JOIN scored b ON a.item = b.item AND a.model = b.model AND a.arm = 'cm' AND b.arm = 'm' WHERE a.item % 19 <> 0
), p AS (SELECT * FROM w WHERE pa IS NOT NULL AND pb IS NOT NULL), {scoring._sql_rho("p", "model, category", "pa", "ra", "xa")}, {scoring._sql_rho("p", "model, category", "pb", "rb", "xb")},
g AS (SELECT model, category, count(*) AS common, count(*) FILTER (pa IS NOT NULL AND pb IS NOT NULL) AS parsed, round(median(pa / pb) FILTER (pb > 0), 6) AS ratio, round(median(ex) FILTER (pa IS NOT NULL AND pb > 0), 6) AS expected,
  round(median(pa / pb / ex) FILTER (pb > 0), 6) AS normalised, round(avg(d), 6) + 0 AS delta_tmra, round(avg(d) FILTER (pa IS NOT NULL AND pb IS NOT NULL), 6) + 0 AS delta_tmra_parsed, count(*) FILTER (pa IS NOT NULL AND pb <= 0) AS non_positive, count(*) FILTER (pa < 0 AND pb > 0) AS negative FROM w GROUP BY model, category)
SELECT g.*, round(xa.rho - xb.rho, 6) + 0 AS delta_rho FROM g LEFT JOIN xa USING (model, category) LEFT JOIN xb USING (model, category)""",
}
