"""Queries on derived detections: metrics and question items, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import generate as G
from ..operators import geometry as geo
from ..sources import adapters as A
from ..sources.shared import settled


def _base(spark: SparkSession, sf_dir: str):
    det = A.detections(spark, sf_dir)
    clips = A.clips(det)
    return det, clips, geo.make_windows(clips)


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def split_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.split_roles(A.detections(spark, sf_dir))


def smooth_feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = _base(spark, sf_dir)
    return geo.smooth_feet(det, clips).select("seq", "track", "frame", _r("sx"), _r("sy"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(spark, sf_dir)[2].select("seq", "window_index", "f0", "f1", "mid", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"), "dur")


def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = _base(spark, sf_dir)
    m = geo.body_metrics(det, clips)
    return m.select("seq", "track", "window_index", "part", "a", "b", _r("median_h"), "stable", _r("path_px"), _r("path_m"), _r("speed"))


def court_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = _base(spark, sf_dir)
    return geo.court_metrics(det, clips, A.homographies(clips)).select("seq", "track", "window_index", _r("path_m"), _r("speed"))


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics, which are written once because items and pairs read them several times, and the numeric items."""
    det, clips, _ = _base(spark, sf_dir)
    m = settled(geo.body_metrics(det, clips))
    return m, G.numeric_items(m, geo.time_to_intercept(det, m))


def numeric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)[1].select("category", "seq", "track", "window_index", "answer", "reason")


def drop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.drop_counters(_items(spark, sf_dir)[1])


def accel_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.accel_swap(geo.body_metrics(*_base(spark, sf_dir)[:2]))


def faster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.faster_pairs(geo.body_metrics(*_base(spark, sf_dir)[:2]))


def control_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.control_arms(_items(spark, sf_dir)[1]).select("category", "seq", "track", "window_index", "arm", "unit", _r("score_tolerance"), _r("score_floor"), "answer", "question")


def mixed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _items(spark, sf_dir)[1].where("answer is not null and category <> 'time'").select("category", "seq", "track", "window_index", "answer")
    return G.mixed_units(kept, ["seq", "category"], ["category", "seq", "track", "window_index"])


def capped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _items(spark, sf_dir)[1].where("answer is not null").select("category", "seq", "track", "window_index", "answer")
    return G.cap_per_group(kept, ["seq", "category"], G.hash_order("cap", "category", "seq", "track", "window_index"), 10)


def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, _, w = _base(spark, sf_dir)
    frames = w.select("seq", F.explode("frames").alias("frame")).distinct()
    presented = det.where("track <> 0").join(frames, ["seq", "frame"], "left_semi").select("seq", "track", "frame")
    return geo.box_overlap(det, presented).select("seq", "track", "frame", _r("max_iou"))


ROLES = """
tracks AS (SELECT seq, track, median(h) AS median_h FROM detections GROUP BY seq, track
), roles AS (
  SELECT seq, track, median_h, CASE WHEN median_h >= 60 THEN 'player' WHEN row_number() OVER (PARTITION BY seq, median_h >= 60 ORDER BY median_h, track) = 1 THEN 'ball' ELSE 'other' END AS role FROM tracks
)"""
WINDOWS = """
windows AS (
  SELECT seq, i AS window_index, 6 + 30 * i AS f0, 66 + 30 * i AS f1, 36 + 30 * i AS mid, 2.0::DOUBLE AS dur, 30.0::DOUBLE AS fps
  FROM (SELECT seq, unnest(range(0, (length - 5 - 60 - 6) // 30 + 1)) AS i FROM clips WHERE length - 5 - 60 >= 6)
)"""
SMOOTH = """
spine AS (
  SELECT seq, track, unnest(range(greatest(1, a - 5), least(length, b + 5) + 1)) AS frame
  FROM (SELECT seq, track, min(frame) AS a, max(frame) AS b FROM detections GROUP BY seq, track) JOIN clips USING (seq)
), smooth AS (
  SELECT * FROM (
    SELECT s.seq, s.track, s.frame, avg(x + w / 2) OVER n AS sx, avg(y + h) OVER n AS sy FROM spine s LEFT JOIN detections d ON s.seq = d.seq AND s.track = d.track AND s.frame = d.frame
    WINDOW n AS (PARTITION BY s.seq, s.track ORDER BY s.frame RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) WHERE sx IS NOT NULL
)"""
METRICS = f"""{A.DETECTIONS}, {ROLES}, {WINDOWS}, {SMOOTH},
parts AS (
  SELECT seq, window_index, 'full' AS part, f0 AS a, f1 AS b FROM windows UNION ALL SELECT seq, window_index, 'first', f0, mid FROM windows UNION ALL SELECT seq, window_index, 'second', mid, f1 FROM windows
), heights AS (
  SELECT d.seq, d.track, window_index, part, a, b, median(h) AS median_h,
         coalesce(abs(median(h) FILTER (frame >= b - 10) / nullif(median(h) FILTER (frame <= a + 10), 0) - 1) <= 0.15, false) AS stable
  FROM detections d JOIN roles r ON d.seq = r.seq AND d.track = r.track AND role = 'player' JOIN parts p ON p.seq = d.seq AND d.frame BETWEEN a AND b GROUP BY ALL
), samples AS (
  SELECT seq, track, window_index, part, len(s) AS n, unnest(s) AS frame
  FROM (SELECT *, list_distinct(list_concat(range(a, b + 1, 5), [b])) AS s FROM heights)
), steps AS (
  SELECT x.seq, x.track, window_index, part, n, sqrt(pow(sx - lag(sx) OVER o, 2) + pow(sy - lag(sy) OVER o, 2)) AS step
  FROM samples x JOIN smooth m ON x.seq = m.seq AND x.track = m.track AND x.frame = m.frame WINDOW o AS (PARTITION BY x.seq, x.track, window_index, part ORDER BY x.frame)
), paths AS (SELECT seq, track, window_index, part, CASE WHEN count(*) = any_value(n) AND any_value(n) >= 2 THEN sum(step) END AS path_px FROM steps GROUP BY ALL
), metrics AS (
  SELECT *, path_m / ((b - a) / 30.0::DOUBLE) AS speed FROM (
    SELECT h.*, path_px, CASE WHEN stable THEN path_px * 1.93::DOUBLE / median_h END AS path_m FROM heights h LEFT JOIN paths USING (seq, track, window_index, part))
)"""
ITEMS = f"""{METRICS},
balls AS (SELECT d.seq, frame, x + w / 2 AS bx, y + h / 2 AS "by" FROM detections d JOIN roles r ON d.seq = r.seq AND d.track = r.track AND role = 'ball'
), intercepts AS (
  SELECT m.seq, m.track, window_index, sqrt(pow(d.x + d.w / 2 - balls.bx, 2) + pow(d.y + d.h - balls."by", 2)) * 1.93::DOUBLE / median_h / speed AS seconds
  FROM metrics m JOIN detections d ON d.seq = m.seq AND d.track = m.track AND d.frame = m.b JOIN balls ON balls.seq = m.seq AND balls.frame = m.b WHERE part = 'full' AND speed > 0
), every AS (
  SELECT 'speed' AS category, seq, track, window_index, stable, speed AS value FROM metrics WHERE part = 'full' UNION ALL
  SELECT 'path', seq, track, window_index, stable, path_m FROM metrics WHERE part = 'full' UNION ALL SELECT 'time', seq, track, window_index, true, seconds FROM intercepts
), items AS (
  SELECT category, seq, track, window_index, value, CASE WHEN reason IS NULL THEN printf('%.1f', value) END AS answer, reason FROM (
    SELECT *, CASE WHEN NOT stable THEN 'unstable' WHEN value IS NULL THEN 'missing'
      WHEN NOT ((category = 'speed' AND value BETWEEN 0.4 AND 9) OR (category = 'path' AND value BETWEEN 0.8 AND 30) OR (category = 'time' AND value BETWEEN 0.4 AND 8)) THEN 'range' END AS reason FROM every)
)"""

QUERIES = {
    "split_roles": split_roles, "smooth_feet": smooth_feet, "windows": windows, "window_metrics": window_metrics, "court_metrics": court_metrics, "numeric_items": numeric_items, "drop_counters": drop_counters,
    "accel_swap": accel_swap, "faster_pairs": faster_pairs, "control_arms": control_arms, "mixed_units": mixed_units, "capped_items": capped_items, "box_overlap": box_overlap,
}
ORACLES = {
    "split_roles": f"WITH {A.DETECTIONS}, {ROLES} SELECT * FROM roles",
    "smooth_feet": f"WITH {A.DETECTIONS}, {SMOOTH} SELECT seq, track, frame, round(sx, 6) AS sx, round(sy, 6) AS sy FROM smooth",
    "windows": f"WITH {A.DETECTIONS}, {WINDOWS} SELECT seq, window_index, f0, f1, mid, f0 || ',' || (f0 + 20) || ',' || (f0 + 40) || ',' || (f0 + 60) AS frames, dur FROM windows",
    "window_metrics": f"WITH {METRICS} SELECT seq, track, window_index, part, a, b, round(median_h, 6) AS median_h, stable, round(path_px, 6) AS path_px, round(path_m, 6) AS path_m, round(speed, 6) AS speed FROM metrics",
    "court_metrics": f"""WITH {A.DETECTIONS}, {ROLES}, {WINDOWS}, {SMOOTH},
points AS (
  SELECT s.seq, s.track, frame, (0.01::DOUBLE * sx + 0.001::DOUBLE * sy + (-5.0::DOUBLE)) / (0.00001::DOUBLE * sx + 0.0004::DOUBLE * sy + 1.0) AS cx,
         (0.0005::DOUBLE * sx + 0.02::DOUBLE * sy + (-3.0::DOUBLE)) / (0.00001::DOUBLE * sx + 0.0004::DOUBLE * sy + 1.0) AS cy
  FROM smooth s JOIN roles r ON s.seq = r.seq AND s.track = r.track AND role = 'player'
), samples AS (SELECT t.seq, track, window_index, unnest(range(f0, f1 + 1, 5)) AS frame FROM (SELECT DISTINCT seq, track FROM points) t JOIN windows USING (seq)
), steps AS (
  SELECT x.seq, x.track, window_index, sqrt(pow(cx - lag(cx) OVER o, 2) + pow(cy - lag(cy) OVER o, 2)) AS step
  FROM samples x JOIN points p ON x.seq = p.seq AND x.track = p.track AND x.frame = p.frame WINDOW o AS (PARTITION BY x.seq, x.track, window_index ORDER BY x.frame)
) SELECT seq, track, window_index, round(sum(step), 6) AS path_m, round(sum(step) / 2.0::DOUBLE, 6) AS speed FROM steps GROUP BY ALL HAVING count(*) = 13""",
    "numeric_items": f"WITH {ITEMS} SELECT category, seq, track, window_index, answer, reason FROM items",
    "drop_counters": f"WITH {ITEMS} SELECT category, coalesce(reason, 'kept') AS reason, count(*) AS n FROM items GROUP BY ALL",
    "accel_swap": f"""WITH {METRICS}, wide AS (
  SELECT seq, track, window_index, bool_or(stable) FILTER (part = 'full') AS stable, max(speed) FILTER (part = 'first') AS v1, max(speed) FILTER (part = 'second') AS v2 FROM metrics GROUP BY ALL
), found AS (SELECT * FROM wide WHERE stable AND v1 > 0 AND v2 > 0 AND greatest(v1, v2) / least(v1, v2) >= 1.35)
SELECT seq, track, window_index, role AS pair_role, CASE WHEN (v2 > v1) = (role = 'orig') THEN 'A' ELSE 'B' END AS answer FROM found, (VALUES ('orig'), ('twin')) r(role)""",
    "faster_pairs": f"""WITH {METRICS}, v AS (SELECT seq, window_index, track, speed FROM metrics WHERE part = 'full' AND speed BETWEEN 0.4 AND 9
), clear AS (
  SELECT a.seq, a.track AS a, b.track AS b, a.window_index, a.speed / b.speed >= 1.4 AS win FROM v a JOIN v b ON a.seq = b.seq AND a.window_index = b.window_index AND a.track < b.track
  WHERE a.speed / b.speed >= 1.4 OR a.speed / b.speed <= 1 / 1.4::DOUBLE
), ranked AS (SELECT *, row_number() OVER (PARTITION BY seq, a, b, win ORDER BY window_index) AS k FROM clear)
SELECT w.seq, w.a, w.b, w.k, w.window_index AS win_window, l.window_index AS loss_window FROM ranked w JOIN ranked l ON w.seq = l.seq AND w.a = l.a AND w.b = l.b AND w.k = l.k AND w.win AND NOT l.win""",
    "control_arms": f"""WITH {ITEMS} SELECT category, seq, track, window_index, unit || '_' || prior AS arm, unit, round(CASE WHEN category = 'speed' THEN 0.3 ELSE 0.5 END::DOUBLE * factor, 6) AS score_tolerance,
  round(CASE WHEN category = 'speed' THEN 1.0 ELSE 2.0 END::DOUBLE * factor, 6) AS score_floor, printf('%.1f', value * factor) AS answer,
  '{texts.FRAMES[0]}4{texts.FRAMES[1]}2.0{texts.FRAMES[2]}' || CASE WHEN prior = 'height' THEN '{texts.PRIOR.format(1.93)}' ELSE '' END || CASE WHEN category = 'speed' THEN '{texts.ARM_ASK["speed"][0]}' || word || '{texts.ARM_ASK["speed"][1]}' ELSE '{texts.ARM_ASK["path"][0]}' || word || '{texts.ARM_ASK["path"][1]}' END || '{texts.NUMBER_ONLY}' AS question
  FROM items, (VALUES ('m', 1.0::DOUBLE, 'meters'), ('cm', 100.0::DOUBLE, 'centimeters'), ('px', 27.0::DOUBLE, 'pixels')) u(unit, factor, word), (VALUES ('height'), ('noheight')) p(prior) WHERE category IN ('speed', 'path') AND answer IS NOT NULL""",
    "mixed_units": f"""WITH {ITEMS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seq, category ORDER BY sha256(concat_ws('|', 'mixed', category, seq, track, window_index))) AS r, count(*) OVER (PARTITION BY seq, category) AS n FROM items WHERE answer IS NOT NULL AND category <> 'time'
) SELECT category, seq, track, window_index, CASE WHEN r <= n // 2 THEN CAST(CAST(CAST(answer AS DECIMAL(20,4)) * 100 AS DECIMAL(20,1)) AS VARCHAR) ELSE answer END AS answer, CASE WHEN r <= n // 2 THEN 'cm' ELSE 'm' END AS unit FROM ranked""",
    "capped_items": f"""WITH {ITEMS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seq, category ORDER BY sha256(concat_ws('|', 'cap', category, seq, track, window_index))) AS r FROM items WHERE answer IS NOT NULL
) SELECT category, seq, track, window_index, answer FROM ranked WHERE r <= 10""",
    "box_overlap": f"""WITH {A.DETECTIONS}, {ROLES}, {WINDOWS}, shown AS (
  SELECT d.* FROM detections d WHERE track <> 0 AND (seq, frame) IN (SELECT seq, unnest([f0, f0 + 20, f0 + 40, f0 + 60]) FROM windows)
), iou AS (
  SELECT a.seq, a.track, a.frame, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared, a.w * a.h + b.w * b.h AS area
  FROM shown a JOIN (SELECT d.* FROM detections d JOIN roles r ON d.seq = r.seq AND d.track = r.track AND role = 'player') b ON a.seq = b.seq AND a.frame = b.frame AND a.track <> b.track
) SELECT s.seq, s.track, s.frame, round(coalesce(max(shared / (area - shared)), 0.0), 6) AS max_iou FROM shown s LEFT JOIN iou USING (seq, track, frame) GROUP BY ALL""",
}
