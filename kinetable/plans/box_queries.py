"""Queries on presented boxes, crowding, verdicts and texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import boxes, generate, variants
from ..operators import geometry as geo
from ..sources import adapters as A
from ..sources.shared import settled
from . import pool_building
from .scoring import SCORED, _rounded, _scored, _sql_rho


def _metrics_and_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Metrics and questions; these are written once, because queries read them for their frames, their boxes and their own columns."""
    m, rows = pool_building._metrics_and_rows(spark, sf_dir)
    rows = rows.withColumns({"item": F.concat_ws("/", "category", "seq", F.col("track").cast("string"), F.col("window_index").cast("string"), F.coalesce("pair_id", F.lit("")), F.coalesce("pair_role", F.lit(""))), "dur": F.lit(2.0)})
    return m, settled(rows.withColumn("track_b", F.when(F.endswith("category", F.lit("_faster")), F.get("highlight", F.lit(1))["track"])))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_and_items(spark, sf_dir)[1]


def box_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    return _rounded(boxes.box_qc_flags(boxes.presented(items, A.detections(spark, sf_dir), 0.5), 640.0, 540.0))


def sparse_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = A.detections(spark, sf_dir)
    items = _items(spark, sf_dir)  # of three tracks one has questions with another height, one with none
    question = F.when(F.col("track") % 3 == 1, F.replace("question", F.lit("is 1.93 m tall"), F.lit("is 1.45 m tall"))).when(F.col("track") % 3 == 2, F.regexp_replace("question", texts.ANY_PRIOR, " ")).otherwise(F.col("question"))
    return boxes.sparse_oracle(items.withColumn("question", question), det, geo.ball_center(det, geo.split_roles(det)))


def presented_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("f1", F.col("f1") + F.when(F.col("window_index") == 3, 1).otherwise(0)).withColumn("image_ids", F.when(F.col("track") == 5, F.reverse("image_ids")).otherwise(F.col("image_ids")))
    return boxes.presented_heights(items, A.detections(spark, sf_dir)).select("item", F.array_join(F.transform("heights", lambda h: h.cast("int").cast("string")), ",").alias("heights"), "reason")


def _crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    det = A.detections(spark, sf_dir)
    m, items = _metrics_and_items(spark, sf_dir)
    items = items.where(F.startswith("category", F.lit("dynamics_"))).select("item", "seq", "track", "window_index", "frames")
    shown = items.select("seq", "track", F.explode("frames").alias("frame")).distinct()
    overlaps = geo.box_overlap(det, shown.join(det, ["seq", "track", "frame"], "left_semi"))
    px = m.where("part = 'full'").select("seq", "track", "window_index", F.round(F.col("path_px") * 0.1, 6).alias("px"))
    return boxes.crowd_signature(items, overlaps, items.join(px, ["seq", "track", "window_index"]).select("item", "px"))


def crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_crowd(spark, sf_dir))


def crowd_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_crowd(spark, sf_dir).groupBy("seq").agg(F.count(F.lit(1)).alias("items"), F.count_if("flagged").alias("hits"), F.avg(F.col("flagged").cast("double")).alias("share")))


def robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    flagged = rows.select("item", (F.col("item") % 7 == 2).alias("flagged")).distinct()
    return _rounded(boxes.robustness(rows, flagged, ["model", "arm", "category"]))


def verdict_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer")
    q = lambda m, bad: F.when(F.col("c_custkey") % m == 0, None).otherwise(F.col("c_custkey") % bad != 1)
    return _rounded(boxes.qc_rates(c.select(q(11, 9).alias("q1"), q(7, 5).alias("q2"), q(13, 4).alias("q3")), ["q1", "q2", "q3"]), 5)


def px_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).where("arm = 'm'").withColumns({"camera": F.concat(F.lit("cam"), (F.col("item") % 3).cast("string")), "world": F.col("reference_value"), "px": (F.col("item") * 37 % 101 + 20 * F.col("reference_value")).cast("double")})
    return _rounded(boxes.px_world_rho(rows, ["camera"], ["model"]))


def soccer_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.table(spark, sf_dir, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 5).cast("string")).alias("seq"), (F.col("p_partkey") % 11).cast("int").alias("track"), F.col("p_partkey").cast("int").alias("t"), (F.col("p_partkey") % 83 / 4).alias("path_m"), (F.col("p_partkey") % 97 * 2.5).alias("path_px"))
    k = p.select("seq").distinct().withColumn("k", 20.0 + F.substring("seq", 2, 1).cast("int"))
    return _rounded(generate.soccer_arms(p, k)).drop("window")


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    present = items.select(F.explode("image_ids").alias("image")).distinct().where("image not like '%_t2_f36'")
    out = variants.chat_records(items, present)
    flat = F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["text"], F.size(m["images"]).cast("string"))), "||")
    return out.select("item", flat.alias("messages"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _items(spark, sf_dir).where(F.startswith("category", F.lit("dynamics_")) & ~F.contains("category", F.lit("time")))
    family = F.when(F.contains("category", F.lit("path")), "path").otherwise("speed")
    return q.select("item", texts.single_frame_question(F.col("question")).alias("single"), texts.with_reference_text(F.lit("q"), " Read this. ").alias("led"), texts.second_turn(family, F.concat(F.lit(" "), "answer"), "One meter equals 100 centimeters.", "centimeters", "centimeters per second").alias("second"))


QUERIES = {f.__name__: f for f in (box_flags, sparse_oracle, presented_heights, crowding, crowd_shares, robustness, verdict_rates, px_world, soccer_arms, chat_records, prompts)}

_POOL = pool_building._POOL
_ITEM = "category || '/' || seq || '/' || track || '/' || window_index || '/' || coalesce(pair_id, '') || '/' || coalesce(pair_role, '')"
_SHOWN = f"""{_POOL}, its AS (SELECT *, {_ITEM} AS item FROM base), shown AS (SELECT item, its.seq, its.track, i, f + 30 * window_index AS frame, d.x, d.y, d.w, d.h FROM its, (VALUES (0, 6), (1, 26), (2, 46), (3, 66)) s(i, f) LEFT JOIN detections d ON d.seq = its.seq AND d.track = its.track AND d.frame = f + 30 * window_index
), st AS (SELECT *, sqrt(pow((x + w / 2) - lag(x + w / 2) OVER o, 2) + pow((y + h) - lag(y + h) OVER o, 2)) AS step FROM shown WINDOW o AS (PARTITION BY item ORDER BY i)
), sums AS (SELECT item, count(h) AS present, sum(step) AS px, max(step) AS most, max(step) FILTER (i = 1) AS s1, max(step) FILTER (i = 3) AS s3, median(h) AS mh, max(x + w / 2) FILTER (i = 3) AS lx, max(y + h) FILTER (i = 3) AS ly, coalesce(bool_or(x * 0.5 <= 2 OR y * 0.5 <= 2 OR (x + w) * 0.5 >= 637 OR (y + h) * 0.5 >= 537), false) AS edge FROM st GROUP BY item)"""
_CROWD = f"""{_SHOWN}, iou AS (SELECT s.item, s.i, max(greatest(0, least(s.x + s.w, b.x + b.w) - greatest(s.x, b.x)) * greatest(0, least(s.y + s.h, b.y + b.h) - greatest(s.y, b.y)) / (s.w * s.h + b.w * b.h - greatest(0, least(s.x + s.w, b.x + b.w) - greatest(s.x, b.x)) * greatest(0, least(s.y + s.h, b.y + b.h) - greatest(s.y, b.y)))) AS m
  FROM shown s JOIN detections b ON b.seq = s.seq AND b.frame = s.frame AND b.track <> s.track JOIN roles r ON r.seq = b.seq AND r.track = b.track AND role = 'player' WHERE s.h IS NOT NULL GROUP BY ALL
), crowd AS (SELECT item, its.seq, (SELECT count(*) FILTER (m >= 0.15) FROM iou WHERE iou.item = its.item) AS crowded, round(path_px * 0.1, 6) AS px FROM its JOIN metrics m ON m.seq = its.seq AND m.track = its.track AND m.window_index = its.window_index AND part = 'full' WHERE category LIKE 'dynamics_%'
), flagged AS (SELECT *, crowded >= 2 AND coalesce(px < 30, false) AS flagged FROM crowd)"""
ORACLES = {
    "box_flags": f"WITH {_SHOWN} SELECT item, CAST(present AS INT) AS present, 4 AS n_frames, edge, CASE WHEN present = 4 THEN round(px * 0.5, 6) END AS px_disp, CASE WHEN present = 4 THEN round(most * 0.5, 6) END AS max_step, round(mh * 0.5, 6) AS median_h FROM sums",
    "sparse_oracle": f"""WITH {_SHOWN}, bshown AS (SELECT item, i, d.x, d.y, d.w, d.h FROM its, (VALUES (0, 6), (1, 26), (2, 46), (3, 66)) s(i, f) LEFT JOIN detections d ON d.seq = its.seq AND d.track = CAST(regexp_extract(highlight, ',(\\d+):blue', 1) AS INT) AND d.frame = f + 30 * window_index WHERE category LIKE '%_faster'
), bst AS (SELECT *, sqrt(pow((x + w / 2) - lag(x + w / 2) OVER o, 2) + pow((y + h) - lag(y + h) OVER o, 2)) AS step FROM bshown WINDOW o AS (PARTITION BY item ORDER BY i)
), bs AS (SELECT item, count(h) AS bp, sum(step) / median(h) AS bv FROM bst GROUP BY item
), j AS (SELECT its.*, sums.*, CASE its.track % 3 WHEN 0 THEN 1.93::DOUBLE WHEN 1 THEN 1.45::DOUBLE END AS tall, bp, bv, sqrt(pow(lx - bx, 2) + pow(ly - "by", 2)) AS gap FROM its JOIN sums USING (item) LEFT JOIN bs USING (item) LEFT JOIN balls ON balls.seq = its.seq AND balls.frame = 66 + 30 * window_index)
SELECT item, CASE WHEN present = 4 THEN CASE WHEN category LIKE 'dynamics_speed%' THEN printf('%.1f', px * (tall / mh) / 2.0::DOUBLE) WHEN category LIKE 'dynamics_path%' THEN printf('%.1f', px * (tall / mh)) WHEN category LIKE 'dynamics_time%' THEN CASE WHEN px > 0 THEN printf('%.1f', gap * (tall / mh) / (px * (tall / mh) / 2.0::DOUBLE)) END
  WHEN category LIKE '%_faster' THEN CASE WHEN bp = 4 THEN CASE WHEN px / mh > bv THEN 'A' ELSE 'B' END END ELSE CASE WHEN (s3 > s1) = (question LIKE '%(A) speeding up%') THEN 'A' ELSE 'B' END END END AS answer FROM j""",
    "presented_heights": f"""WITH {_SHOWN}, hs AS (SELECT item, count(h) AS n, string_agg(CAST(CAST(h AS INT) AS VARCHAR), ',' ORDER BY i) AS hs FROM shown GROUP BY item), r AS (SELECT item, hs, CASE WHEN window_index = 3 THEN 'window' WHEN track = 5 THEN 'names' WHEN n < 4 THEN 'missing' END AS reason FROM its JOIN hs USING (item))
SELECT item, CASE WHEN reason IS NULL THEN hs END AS heights, reason FROM r""",
    "crowding": f"WITH {_CROWD} SELECT item, seq, crowded, px, flagged FROM flagged",
    "crowd_shares": f"WITH {_CROWD} SELECT seq, count(*) AS items, count(*) FILTER (flagged) AS hits, round(avg(flagged::INT), 6) AS share FROM flagged GROUP BY seq",
    "robustness": f"""WITH {SCORED}, clean AS (SELECT * FROM scored WHERE item % 7 <> 2), {_sql_rho("scored", "model, arm, category", "prediction", "reference_value", "a")}, {_sql_rho("clean", "model, arm, category", "prediction", "reference_value", "b")}
SELECT model, arm, category, a.n, b.n AS n_clean, round(a.rho, 6) AS rho, round(b.rho, 6) AS rho_clean, round(b.rho - a.rho, 6) + 0 AS delta FROM a LEFT JOIN b USING (model, arm, category)""",
    "verdict_rates": """WITH v AS (SELECT CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 9 <> 1 END AS q1, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 <> 1 END AS q2, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 4 <> 1 END AS q3 FROM customer
), u AS (SELECT 'q1' AS question, q1 AS ok FROM v UNION ALL SELECT 'q2', q2 FROM v UNION ALL SELECT 'q3', q3 FROM v UNION ALL SELECT 'all', CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL AND q3 IS NOT NULL THEN q1 AND q2 AND q3 END FROM v
), g AS (SELECT question, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, count(ok) AS n, count(*) FILTER (ok) / count(ok) AS p FROM u GROUP BY question)
SELECT question, passed, failed, round(100 * p, 5) AS rate, round(100 * greatest(0.0, ((p + 1.96::DOUBLE ^ 2 / (2 * n)) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.96::DOUBLE ^ 2 / n)), 5) AS lo,
  round(100 * least(1.0, ((p + 1.96::DOUBLE ^ 2 / (2 * n)) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.96::DOUBLE ^ 2 / n)), 5) AS hi FROM g""",
    "px_world": f"""WITH {SCORED}, r AS (SELECT *, 'cam' || item % 3 AS camera, CAST(item * 37 % 101 + 20 * reference_value AS DOUBLE) AS px FROM scored WHERE arm = 'm'), one AS (SELECT camera, item, max(px) AS px, max(reference_value) AS world FROM r GROUP BY ALL), {_sql_rho("one", "camera", "px", "world", "a")}, {_sql_rho("r", "camera, model", "prediction", "reference_value", "b")}
SELECT camera, model, b.n, round(b.rho, 6) AS rho, round(a.rho, 6) AS px_world FROM b JOIN a USING (camera)""",
    "soccer_arms": f"""WITH p AS (SELECT 's' || p_partkey % 5 AS seq, CAST(p_partkey % 11 AS INT) AS track, CAST(p_partkey AS INT) AS t, p_partkey % 83 / 4.0::DOUBLE AS m, p_partkey % 97 * 2.5::DOUBLE AS px, 20.0::DOUBLE + p_partkey % 5 AS k FROM part
), a AS (SELECT *, CASE arm WHEN 'm_height' THEN m WHEN 'cm_height' THEN m * 100 ELSE px END / CASE family WHEN 'speed' THEN 2 ELSE 1 END AS v, CASE arm WHEN 'm_height' THEN 1.0::DOUBLE WHEN 'cm_height' THEN 100.0::DOUBLE ELSE k END AS f FROM p, (VALUES ('m_height', 'm'), ('cm_height', 'cm'), ('px_height', 'px')) u(arm, unit), (VALUES ('speed'), ('path')) c(family))
SELECT CASE family WHEN 'speed' THEN '{texts.CATEGORIES["speed"]}' ELSE '{texts.CATEGORIES["path"]}' END AS category, seq, track, t, arm, unit, printf('%.1f', v) AS answer, round(v, 6) AS reference_value, round(CASE family WHEN 'speed' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END * f, 6) AS score_tolerance, round(CASE family WHEN 'speed' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END * f, 6) AS score_floor FROM a""",
    "chat_records": f"""WITH {_POOL}, i AS (SELECT *, {_ITEM} AS item FROM base) SELECT item, 'user|' || question || '|4||assistant|' || answer || '|0' AS messages FROM i WHERE NOT (track = 2 AND (36 - 30 * window_index) IN (6, 26, 46, 66))""",
    "prompts": f"""WITH {_POOL}, i AS (SELECT *, {_ITEM} AS item FROM base WHERE category IN ('dynamics_speed_player', 'dynamics_path_player')) SELECT item, replace(question, '{texts.FRAMES[0]}4{texts.FRAMES[1]}2.0{texts.FRAMES[2]}', 'This is a single frame from a basketball clip spanning 2.0 seconds. ') AS single, 'Read this.' || chr(10) || chr(10) || 'q' AS led,
  CASE category WHEN 'dynamics_path_player' THEN '{texts.SECOND_TURN["path"][0]}' || answer || '{texts.SECOND_TURN["path"][1]}One meter equals 100 centimeters.{texts.SECOND_TURN["path"][2]}centimeters.{texts.NUMBER_ONLY}' ELSE '{texts.SECOND_TURN["speed"][0]}' || answer || '{texts.SECOND_TURN["speed"][1]}One meter equals 100 centimeters.{texts.SECOND_TURN["speed"][2]}centimeters per second.{texts.NUMBER_ONLY}' END AS second FROM i""",
}
