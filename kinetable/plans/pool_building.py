"""Queries on pools of questions and their controlled variants, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import audit, generate, more_geometry, variants
from ..operators import geometry as geo
from ..operators import probe as probes
from ..sources import adapters as A
from . import contracts, extended, trajectory

_KEY = ["category", "seq", "track", "window_index"]


def _metrics_and_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    det, clips, w = trajectory._base(spark, sf_dir)
    m, items = trajectory._items(spark, sf_dir)
    balls = geo.split_roles(det).where("role = 'ball'").select("seq", F.col("track").alias("ball"))
    parts = (generate.numeric_rows(items, w, balls), generate.accel_rows(generate.accel_swap(m), w), generate.faster_rows(generate.faster_pairs(m), w))
    return m, parts[0].unionByName(parts[1]).unionByName(parts[2])


def _all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics_and_rows(spark, sf_dir)[1]


def _flat(df: DataFrame) -> DataFrame:
    marks = F.array_join(F.transform("highlight", lambda h: F.concat_ws(":", h["track"].cast("string"), h["color"], h["shape"])), ",")
    return df.withColumns({"frames": F.array_join(F.transform("frames", lambda f: f.cast("string")), ","), "image_ids": F.array_join("image_ids", ","), "highlight": marks})


def question_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_all_rows(spark, sf_dir))


def capped_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all_rows(spark, sf_dir)
    return generate.cap_families(rows, ["seq", "category"], _KEY, 10).select(*_KEY, "pair_id", "pair_role", "answer")


def accel_visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, w = trajectory._base(spark, sf_dir)
    pairs = more_geometry.accel_visual(more_geometry.accel_events(geo.body_metrics(det, clips)))
    return _flat(generate.accel_visual_rows(pairs, w))


def audit_accel_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' audit where every second pair of a track is spoilt, in each track in another way."""
    det, clips, w = trajectory._base(spark, sf_dir)
    pairs = more_geometry.accel_visual(more_geometry.accel_events(geo.body_metrics(det, clips)))
    rows = generate.accel_visual_rows(pairs, w).withColumn("pair_id", F.concat_ws("/", "seq", "pair_id"))
    bad = F.substring("pair_id", -2, 2).cast("int") % 2 == 0
    twin, at = F.col("pair_role") == "twin", lambda t: bad & (F.col("track") == t)
    spoilt = rows.where(~(at(3) & twin)).withColumns({
        "answer": F.when(at(1) & twin, "A").otherwise(F.col("answer")), "question": F.when(at(2) & twin, F.concat("question", F.lit(" "))).otherwise(F.col("question")),
        "f0": F.when(at(4), 0).otherwise(F.col("f0")), "f1": F.when(at(4), 1000).otherwise(F.col("f1")), "frames": F.when(at(5), F.array(F.lit(1))).otherwise(F.col("frames")),
    })
    return audit.audit_pairs(spoilt)


def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = trajectory._base(spark, sf_dir)
    h = A.homographies(clips)
    parts = geo.court_parts(det, clips, h)
    out = generate.recompute_answers(_all_rows(spark, sf_dir), parts, geo.time_to_ball_court(det, parts, h))
    return out.select(*_KEY, "pair_id", "pair_role", "answer", "new_answer", F.round("detail", 5).alias("detail"))


def _court(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = trajectory._base(spark, sf_dir)
    return geo.court_metrics(det, clips, A.homographies(clips))


def ruler_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = extended.clip_scale(spark, sf_dir).select("seq", F.bround("k", 2).alias("k"), (F.col("seq") != "clip_0").alias("ok"))
    return variants.ruler_variant(contracts._questions(spark, sf_dir), _court(spark, sf_dir), scale)


def pixel_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.pixel_variant(contracts._questions(spark, sf_dir), extended.px_answers(spark, sf_dir))


def in_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, w = trajectory._base(spark, sf_dir)
    frames = w.select("seq", "window_index", F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))
    items = contracts._questions(spark, sf_dir).join(frames, ["seq", "window_index"])
    arms = trajectory.control_arms(spark, sf_dir).where("arm in ('m_height', 'cm_height')").join(frames, ["seq", "window_index"])
    return variants.in_template(arms, items, _KEY).select(*_KEY, "arm", "answer", "question")


def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, clips, _ = trajectory._base(spark, sf_dir)
    c = _court(spark, sf_dir)
    value = F.explode(F.array(F.struct(F.lit("speed").alias("category"), F.col("speed").alias("v")), F.struct(F.lit("path").alias("category"), F.col("path_m").alias("v")))).alias("a")
    court = c.select("seq", "track", "window_index", value).select("a.category", "seq", "track", "window_index", texts.one_decimal(F.col("a.v")).alias("answer"))
    groups = clips.select("seq", (F.regexp_extract("seq", r"(\d+)", 1).cast("int") % 3).alias("event"))
    held = spark.range(1).select(F.lit(2).alias("event"))
    return variants.relabel_pool(contracts._questions(spark, sf_dir), court, groups, held)


def arm_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of arms that are spoilt on purpose: a wrong answer, a changed text and a wrong tolerance in some windows of some tracks."""
    arms = generate.control_arms(trajectory._items(spark, sf_dir)[1])
    at = lambda track, arm: (F.col("track") == track) & (F.col("window_index") % 3 == 0) & (F.col("arm") == arm)
    spoilt = arms.withColumns({
        "answer": F.when(at(1, "cm_height"), "0.0").otherwise(F.col("answer")), "question": F.when(at(2, "px_noheight"), F.concat("question", F.lit(" Now."))).otherwise(F.col("question")),
        "score_tolerance": F.when(at(3, "cm_height"), F.col("score_tolerance") * 50).otherwise(F.col("score_tolerance")),
    })
    return generate.arm_invariants(spoilt)


def odd_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.odd_strata(trajectory._items(spark, sf_dir)[1].where("answer is not null"), ["seq", "category"])


def fine_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = trajectory._items(spark, sf_dir)[1].where("answer is not null and category <> 'time'").select(*_KEY, "answer", "value")
    return generate.mixed_units(kept, ["seq", "category"], _KEY, fine="value").drop("value")


def unit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = A.table(spark, sf_dir, "part").select((F.col("p_partkey") / 8).cast("double").alias("value"))
    q = probes.unit_probe_items(values)
    return q.select("item_id", "question", "answer", "from_unit", "to_unit", F.round("factor", 9).alias("factor"), "factor_given", "framing", "pair_kind", "direction")


QUERIES = {f.__name__: f for f in (question_pool, capped_families, accel_visual_rows, audit_accel_visual, recomputed, ruler_variant, pixel_variant, in_template, relabelled, arm_invariants, odd_strata, fine_units, unit_probe)}

_A = contracts._LEAD
_NAMES = "CASE category WHEN 'speed' THEN 'dynamics_speed_player' WHEN 'path' THEN 'dynamics_path_player' ELSE 'dynamics_time_intercept' END"
_POOL = f"""{trajectory.ITEMS}, ballof AS (SELECT seq, track AS ball FROM roles WHERE role = 'ball'
), swap AS (SELECT seq, track, window_index, role, CASE WHEN (v2 > v1) = (role = 'orig') THEN 'A' ELSE 'B' END AS answer FROM (
    SELECT seq, track, window_index, bool_or(stable) FILTER (part = 'full') AS stable, max(speed) FILTER (part = 'first') AS v1, max(speed) FILTER (part = 'second') AS v2 FROM metrics GROUP BY ALL), (VALUES ('orig'), ('twin')) r(role)
  WHERE stable AND v1 > 0 AND v2 > 0 AND greatest(v1, v2) / least(v1, v2) >= 1.35
), faster AS (WITH v AS ({trajectory.ORACLES["faster_pairs"].split(", v AS (", 1)[1]}
), base AS (
  SELECT {_NAMES} AS category, seq, track, window_index, CAST(NULL AS VARCHAR) AS pair_id, CAST(NULL AS VARCHAR) AS pair_role, {contracts._ASK} AS question, answer, track || ':red:box' || CASE WHEN category = 'time' THEN ',' || ball || ':yellow:circle' ELSE '' END AS highlight
  FROM items LEFT JOIN ballof USING (seq) WHERE answer IS NOT NULL
  UNION ALL SELECT 'relational_reasoning_dyn_accel', seq, track, window_index, printf('acc_w%03d_t%d', window_index, track), role, {_A} || CASE role WHEN 'orig' THEN '{texts.ASK["accel"]}' ELSE '{texts.ASK["accel_swapped"]}' END || '{texts.LETTER_ONLY}', answer, track || ':red:box' FROM swap
  UNION ALL SELECT 'relational_reasoning_dyn_faster', seq, a, CASE role WHEN 'orig' THEN win_window ELSE loss_window END, printf('vis_t%d_%d_%02d', a, b, k - 1), role, {_A} || '{texts.ASK["faster"]}{texts.LETTER_ONLY}', CASE role WHEN 'orig' THEN 'A' ELSE 'B' END, a || ':red:box,' || b || ':blue:box' FROM faster, (VALUES ('orig'), ('twin')) r(role)
)"""
_CPOINTS = """cpoints AS (
  SELECT s.seq, s.track, frame, (0.01::DOUBLE * sx + 0.001::DOUBLE * sy + (-5.0::DOUBLE)) / (0.00001::DOUBLE * sx + 0.0004::DOUBLE * sy + 1.0) AS cx, (0.0005::DOUBLE * sx + 0.02::DOUBLE * sy + (-3.0::DOUBLE)) / (0.00001::DOUBLE * sx + 0.0004::DOUBLE * sy + 1.0) AS cy
  FROM smooth s JOIN roles r ON s.seq = r.seq AND s.track = r.track AND role = 'player'
), csamples AS (SELECT t.seq, track, window_index, part, a, b, unnest(range(a, b + 1, 5)) AS frame FROM (SELECT DISTINCT seq, track FROM cpoints) t JOIN parts USING (seq)
), csteps AS (
  SELECT x.seq, x.track, window_index, part, a, b, sqrt(pow(cx - lag(cx) OVER o, 2) + pow(cy - lag(cy) OVER o, 2)) AS step
  FROM csamples x JOIN cpoints p ON x.seq = p.seq AND x.track = p.track AND x.frame = p.frame WINDOW o AS (PARTITION BY x.seq, x.track, window_index, part ORDER BY x.frame)
), court AS (SELECT seq, track, window_index, part, a, b, sum(step) AS d, sum(step) / ((b - a) / 30.0::DOUBLE) AS v FROM csteps GROUP BY seq, track, window_index, part, a, b HAVING count(*) = (b - a) // 5 + 1
)"""


def _court_xy(x: str, y: str) -> tuple[str, str]:
    below = f"(0.00001::DOUBLE * ({x}) + 0.0004::DOUBLE * ({y}) + 1.0)"
    return f"(0.01::DOUBLE * ({x}) + 0.001::DOUBLE * ({y}) + (-5.0::DOUBLE)) / {below}", f"(0.0005::DOUBLE * ({x}) + 0.02::DOUBLE * ({y}) + (-3.0::DOUBLE)) / {below}"


_F, _B = _court_xy("d.x + d.w / 2", "d.y + d.h"), _court_xy("bx", '"by"')
_FULL = "(SELECT seq, track, window_index, d, v FROM court WHERE part = 'full')"
_PROBE_PAIRS = ", ".join(f"('{a}', '{b}', {f!r}::DOUBLE, '{s}', {str(g).lower()}, '{k}')" for a, b, f, s, g, k in probes.conditions())
ORACLES = {
    "question_pool": f"""WITH {_POOL} SELECT category, seq, track, window_index, pair_id, pair_role, question, answer, 6 + 30 * window_index AS f0, 66 + 30 * window_index AS f1, (6 + 30 * window_index) || ',' || (26 + 30 * window_index) || ',' || (46 + 30 * window_index) || ',' || (66 + 30 * window_index) AS frames,
  array_to_string(list_transform([6, 26, 46, 66], lambda f: seq || '_w' || window_index || '_t' || track || '_f' || (f + 30 * window_index)), ',') AS image_ids, highlight FROM base""",
    "capped_families": f"""WITH {_POOL}, s AS (SELECT *, row_number() OVER (PARTITION BY seq, category ORDER BY sha256(concat_ws('|', 'cap', category, seq, track, window_index))) AS r FROM base WHERE pair_id IS NULL
), p AS (SELECT *, row_number() OVER (PARTITION BY seq, category ORDER BY sha256(concat_ws('|', 'cap', seq, category, pair_id))) AS r FROM (SELECT DISTINCT seq, category, pair_id FROM base WHERE pair_id IS NOT NULL))
SELECT category, seq, track, window_index, pair_id, pair_role, answer FROM s WHERE r <= 10 UNION ALL SELECT category, seq, track, window_index, pair_id, pair_role, answer FROM base JOIN p USING (seq, category, pair_id) WHERE r <= 5""",
    "recomputed": f"""WITH {_POOL}, {_CPOINTS}, wide AS (SELECT seq, track, window_index, max(v) FILTER (part = 'full') AS v, max(v) FILTER (part = 'first') AS v1, max(v) FILTER (part = 'second') AS v2, max(d) FILTER (part = 'full') AS d FROM court GROUP BY ALL
), ct AS (SELECT c.seq, c.track, window_index, sqrt(pow({_F[0]} - ({_B[0]}), 2) + pow({_F[1]} - ({_B[1]}), 2)) / c.v AS t FROM court c JOIN detections d ON d.seq = c.seq AND d.track = c.track AND d.frame = c.b JOIN balls ON balls.seq = c.seq AND balls.frame = c.b WHERE part = 'full' AND c.v > 0
), j AS (SELECT base.*, wide.v, wide.v1, wide.v2, wide.d, t, o.v AS vb, question LIKE '%(A) speeding up%' AS first FROM base LEFT JOIN wide USING (seq, track, window_index) LEFT JOIN ct USING (seq, track, window_index)
  LEFT JOIN wide o ON o.seq = base.seq AND o.window_index = base.window_index AND o.track = CASE WHEN category LIKE '%faster' THEN CAST(regexp_extract(highlight, ',(\\d+):blue', 1) AS INT) END)
SELECT category, seq, track, window_index, pair_id, pair_role, answer, CASE WHEN category LIKE 'dynamics_speed%' THEN printf('%.1f', v) WHEN category LIKE 'dynamics_path%' THEN printf('%.1f', d) WHEN category LIKE 'dynamics_time%' THEN printf('%.1f', t)
  WHEN category LIKE '%accel' THEN CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN CASE WHEN (v2 > v1) = first THEN 'A' ELSE 'B' END END WHEN v IS NOT NULL AND vb IS NOT NULL THEN CASE WHEN v > vb THEN 'A' ELSE 'B' END END AS new_answer,
  round(CASE WHEN category LIKE 'dynamics_speed%' THEN v WHEN category LIKE 'dynamics_path%' THEN d WHEN category LIKE 'dynamics_time%' THEN t WHEN category LIKE '%accel' THEN CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN greatest(v1, v2) / greatest(least(v1, v2), 1e-9) END WHEN v IS NOT NULL AND vb IS NOT NULL THEN greatest(v, vb) / greatest(least(v, vb), 1e-9) END, 5) AS detail FROM j""",
    "ruler_variant": f"""WITH {trajectory.ITEMS}, {_CPOINTS}, k AS (SELECT seq, round_even(round(median(path_px * 0.5 / c.d), 5), 2) AS k FROM metrics m JOIN (SELECT seq, track, window_index, round(d, 6) AS d FROM court WHERE part = 'full') c USING (seq, track, window_index) WHERE m.part = 'full' AND path_px IS NOT NULL AND c.d >= 0.05 GROUP BY seq)
SELECT category, seq, track, window_index, printf('%.1f', CASE category WHEN 'speed' THEN v ELSE d END) AS answer, {_A} || '{texts.RULER[0]}' || CAST(round_even(k, 0) AS BIGINT) || '{texts.RULER[1]}' || CASE category WHEN 'speed' THEN '{texts.ASK["speed"]}' ELSE '{texts.ASK["path"]}' END || '{texts.NUMBER_ONLY}' AS question, answer AS v1_answer, round(k, 3) AS ruler_px_per_m
FROM items JOIN {_FULL} c USING (seq, track, window_index) JOIN k USING (seq) WHERE answer IS NOT NULL AND category IN ('speed', 'path') AND seq <> 'clip_0'""",
    "pixel_variant": f"""WITH {trajectory.ITEMS}, px AS (SELECT seq, track, window_index, round(path_px * 960.0::DOUBLE / 1920, 6) AS p, round(path_px * 960.0::DOUBLE / 1920 / 2, 6) AS s FROM metrics WHERE part = 'full' AND path_px IS NOT NULL)
SELECT category, seq, track, window_index, printf('%.1f', CASE category WHEN 'speed' THEN s ELSE p END) AS answer, {_A} || CASE category WHEN 'speed' THEN '{texts.PIXEL_ASK["speed"]}' ELSE '{texts.PIXEL_ASK["path"]}' END || '{texts.NUMBER_ONLY}' AS question, answer AS m_answer FROM items JOIN px USING (seq, track, window_index) WHERE answer IS NOT NULL AND category IN ('speed', 'path')""",
    "in_template": f"""WITH {trajectory.ITEMS} SELECT category, seq, track, window_index, 'legacy_' || unit AS arm, printf('%.1f', value * f) AS answer, replace(replace({contracts._ASK}, 'in meters per second?', 'in ' || w || ' per second?'), 'in meters?', 'in ' || w || '?') AS question
FROM items, (VALUES ('m', 1.0::DOUBLE, 'meters'), ('cm', 100.0::DOUBLE, 'centimeters')) u(unit, f, w) WHERE answer IS NOT NULL AND category IN ('speed', 'path')""",
    "relabelled": f"""WITH {trajectory.ITEMS}, {_CPOINTS} SELECT category, seq, track, window_index, printf('%.1f', CASE category WHEN 'speed' THEN v ELSE d END) AS answer, {contracts._ASK} AS question, answer AS v1_answer, 'court' AS label_convention
FROM items JOIN {_FULL} c USING (seq, track, window_index) WHERE answer IS NOT NULL AND category IN ('speed', 'path') AND CAST(regexp_extract(seq, '(\\d+)', 1) AS INT) % 3 <> 2""",
    "arm_invariants": f"""WITH {trajectory.ITEMS}, i AS (SELECT * FROM items WHERE answer IS NOT NULL AND category IN ('speed', 'path') AND window_index % 3 = 0) SELECT rule, CASE rule WHEN 'reference' THEN (SELECT count(*) FROM i WHERE track = 1) WHEN 'unit_text' THEN (SELECT count(*) FROM i WHERE track = 2) WHEN 'prior_text' THEN (SELECT count(*) FROM i WHERE track = 2) ELSE (SELECT count(*) FROM i WHERE track = 3) END AS violations FROM (SELECT unnest(['reference', 'unit_text', 'prior_text', 'scale']) AS rule)""",
    "audit_accel_visual": f"""WITH RECURSIVE {extended.VISUAL} SELECT seq || printf('/accvis_t%d_%02d', track, k) AS pair_id, CASE track WHEN 1 THEN 'answers' WHEN 2 THEN 'text' WHEN 3 THEN 'rows' WHEN 4 THEN 'windows' ELSE 'frames' END AS reason FROM visual WHERE k % 2 = 0""",
    "accel_visual_rows": f"""WITH RECURSIVE {extended.VISUAL}, base AS (SELECT 'relational_reasoning_dyn_accel_vis' AS category, seq, track, CASE role WHEN 'orig' THEN up ELSE down END AS window_index, printf('accvis_t%d_%02d', track, k) AS pair_id, role AS pair_role, {_A} || '{texts.ASK["accel"]}{texts.LETTER_ONLY}' AS question, CASE role WHEN 'orig' THEN 'A' ELSE 'B' END AS answer, track || ':red:box' AS highlight FROM visual, (VALUES ('orig'), ('twin')) r(role))
SELECT category, seq, track, window_index, pair_id, pair_role, question, answer, 6 + 30 * window_index AS f0, 66 + 30 * window_index AS f1, (6 + 30 * window_index) || ',' || (26 + 30 * window_index) || ',' || (46 + 30 * window_index) || ',' || (66 + 30 * window_index) AS frames,
  array_to_string(list_transform([6, 26, 46, 66], lambda f: seq || '_w' || window_index || '_t' || track || '_f' || (f + 30 * window_index)), ',') AS image_ids, highlight FROM base""",
    "odd_strata": f"WITH {trajectory.ITEMS} SELECT seq, category, count(*) AS n FROM items WHERE answer IS NOT NULL GROUP BY ALL HAVING count(*) % 2 = 1",
    "fine_units": f"""WITH {trajectory.ITEMS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY seq, category ORDER BY sha256(concat_ws('|', 'mixed', category, seq, track, window_index))) AS r, count(*) OVER (PARTITION BY seq, category) AS n FROM items WHERE answer IS NOT NULL AND category <> 'time'
) SELECT category, seq, track, window_index, CASE WHEN r > n // 2 THEN answer WHEN category = 'speed' THEN printf('%.1f', round_even(value * 100, 0)) ELSE CAST(CAST(CAST(answer AS DECIMAL(20,4)) * 100 AS DECIMAL(20,1)) AS VARCHAR) END AS answer, CASE WHEN r <= n // 2 THEN 'cm' ELSE 'm' END AS unit FROM ranked""",
    "unit_probe": f"""WITH v AS (SELECT DISTINCT p_partkey / 8.0::DOUBLE AS value FROM part), t AS (SELECT value, CASE WHEN value = floor(value) THEN printf('%.1f', value) ELSE regexp_replace(printf('%.3f', value), '0+$', '') END AS said FROM v
), q AS (SELECT *, CASE framing WHEN 'embedded' THEN 'The player marked with the red box has a path length of ' || said || ' ' || from_unit || ' over the clip.' ELSE 'A distance is ' || said || ' ' || from_unit || '.' END || CASE WHEN factor_given THEN ' ' || sentence ELSE '' END
    || CASE framing WHEN 'embedded' THEN ' Express that path length in ' ELSE ' Express that distance in ' END || to_unit || '. Output only the number, one decimal place.' AS question
  FROM t, (VALUES {_PROBE_PAIRS}) c(from_unit, to_unit, factor, sentence, factor_given, pair_kind), (VALUES ('bare'), ('embedded')) f(framing))
SELECT sha256('{probes.PROTOCOL}|' || question)[1:20] AS item_id, question, printf('%.1f', value * factor) AS answer, from_unit, to_unit, round(factor, 9) AS factor, factor_given, framing, pair_kind, CASE WHEN factor > 1 THEN 'multiply' ELSE 'divide' END AS direction FROM q""",
}
