"""Detections, clips, arm items and prediction logs derived from order tables, for tests and benchmarks.

Integer arithmetic only, so that any SQL engine gives the same rows. A clip is five suppliers, so clips grow with the
data and stay equally long (about 500 frames a track).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FPS, WIDTH, HEIGHT = 30.0, 1920, 1080
BALL = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections(seq, track, frame, x, y, w, h): moving boxes with gaps, steps of 0 to 8 px and height jumps."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.floor(F.col("l_suppkey") / 5)).cast("int").alias("k"), (F.col("l_partkey") % 6).cast("int").alias("track"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    order = Window.partitionBy("k", "track").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = rows.select("k", "track", F.row_number().over(order).alias("frame")).withColumn("block", F.expr("frame div 45"))
    rows = rows.withColumn("step", (7 * F.col("block") + 3 * F.col("track") + 5 * F.col("k")) % 9)
    run = Window.partitionBy("k", "track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("moved", F.sum("step").over(run)).where("frame % 17 <> 0")
    height = F.when(F.col("track") == BALL, 20).otherwise(120 + F.col("frame") % 5 + F.when(F.col("block") % 7 == 3, 40).otherwise(0))
    return rows.select(
        F.concat(F.lit("clip_"), F.col("k").cast("string")).alias("seq"), "track", "frame", (100 * F.col("track") + F.col("moved")).cast("double").alias("x"),
        (300 + 20 * F.col("track") + F.col("block") % 3).cast("double").alias("y"), F.lit(40.0).alias("w"), height.cast("double").alias("h"),
    )


DETECTIONS = """
det0 AS (
  SELECT CAST(floor(l_suppkey / 5) AS INT) AS k, CAST(l_partkey % 6 AS INT) AS track,
         CAST(row_number() OVER (PARTITION BY floor(l_suppkey / 5), l_partkey % 6 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INT) AS frame
  FROM lineitem
), det1 AS (SELECT *, frame // 45 AS block, (7 * (frame // 45) + 3 * track + 5 * k) % 9 AS step FROM det0
), det2 AS (SELECT *, sum(step) OVER (PARTITION BY k, track ORDER BY frame ROWS UNBOUNDED PRECEDING) AS moved FROM det1
), detections AS (
  SELECT 'clip_' || k AS seq, track, frame, CAST(100 * track + moved AS DOUBLE) AS x, CAST(300 + 20 * track + block % 3 AS DOUBLE) AS y, 40.0::DOUBLE AS w,
         CAST(CASE WHEN track = 0 THEN 20 ELSE 120 + frame % 5 + CASE WHEN block % 7 = 3 THEN 40 ELSE 0 END END AS DOUBLE) AS h
  FROM det2 WHERE frame % 17 <> 0
), clips AS (SELECT seq, 30.0::DOUBLE AS fps, 1920 AS width, 1080 AS height, max(frame) AS length FROM detections GROUP BY seq)"""


def clips(detections: DataFrame) -> DataFrame:
    """clips(seq, fps, width, height, length) of derived detections."""
    return detections.groupBy("seq").agg(F.max("frame").alias("length")).select("seq", F.lit(FPS).alias("fps"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "length")


def homographies(clips: DataFrame) -> DataFrame:
    """A mild projective image-to-court map for each clip, as nine columns."""
    h = {"h00": 0.01, "h01": 0.001, "h02": -5.0, "h10": 0.0005, "h11": 0.02, "h12": -3.0, "h20": 0.00001, "h21": 0.0004, "h22": 1.0}
    return clips.select("seq", *(F.lit(v).alias(k) for k, v in h.items()))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction log from orders: six cells (model, arm), items keyed by order, answers in many spellings.

    predictions(item, model, arm, category, reference_value, score_tolerance, score_floor, raw_answer)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 3).cast("int").alias("m"), (F.col("o_orderkey") % 7).cast("int").alias("s"), F.col("o_custkey").alias("c")
    )
    arms = F.explode(F.array(F.struct(F.lit("m").alias("arm"), F.lit(1).alias("f")), F.struct(F.lit("cm").alias("arm"), F.lit(100).alias("f")))).alias("a")
    o = o.select("item", "m", "s", "c", arms).select("item", "m", "s", "c", "a.arm", "a.f")
    tenths = (F.col("item") % 83 + 4).cast("int")
    guess = tenths + (F.col("c") % 11).cast("int") - 5
    number = F.concat((F.col("f") * guess / 10).cast("decimal(12,1)").cast("string"))
    raw = (
        F.when(F.col("s") == 0, F.concat(F.lit("Answer: "), number)).when(F.col("s") == 1, F.concat(number, F.lit(" meters"))).when(F.col("c") % 29 == 0, F.lit("nan"))
        .when(F.col("c") % 31 == 0, F.lit("1e400")).when(F.col("c") % 37 == 0, F.lit("")).otherwise(number)
    )
    return o.select(
        "item", F.concat(F.lit("model_"), F.col("m").cast("string")).alias("model"), "arm", F.when(F.col("item") % 2 == 0, "dynamics_speed_player").otherwise("dynamics_path_player").alias("category"),
        (F.col("f") * tenths / 10).alias("reference_value"), (0.3 * F.col("f")).alias("score_tolerance"), (1.0 * F.col("f")).alias("score_floor"), raw.alias("raw_answer"),
    )


PREDICTIONS = """
pred0 AS (
  SELECT o_orderkey AS item, CAST(o_custkey % 3 AS INT) AS m, CAST(o_orderkey % 7 AS INT) AS s, o_custkey AS c, arm, f, CAST(o_orderkey % 83 + 4 AS INT) AS tenths
  FROM orders, (VALUES ('m', 1), ('cm', 100)) a(arm, f)
), pred1 AS (SELECT *, CAST(CAST(CAST(f * (tenths + CAST(c % 11 AS INT) - 5) AS DECIMAL(12,1)) / 10 AS DECIMAL(12,1)) AS VARCHAR) AS number FROM pred0
), predictions AS (
  SELECT item, 'model_' || m AS model, arm, CASE WHEN item % 2 = 0 THEN 'dynamics_speed_player' ELSE 'dynamics_path_player' END AS category,
         f * tenths / 10.0::DOUBLE AS reference_value, 0.3::DOUBLE * f AS score_tolerance, 1.0::DOUBLE * f AS score_floor,
         CASE WHEN s = 0 THEN 'Answer: ' || number WHEN s = 1 THEN number || ' meters' WHEN c % 29 = 0 THEN 'nan' WHEN c % 31 = 0 THEN '1e400' WHEN c % 37 = 0 THEN '' ELSE number END AS raw_answer
  FROM pred1
)"""


def portable(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    """Rows of a SELECT that Spark and other engines read alike; tables stand in braces."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


#: Legacy rows of every metric group: category, answer, vlm_answer, has_prediction.
LEGACY = """
SELECT k, category, has_prediction,
  CASE WHEN g < 4 THEN x WHEN g = 4 THEN '(' || x || ', ' || y || ', 0.9)' WHEN g = 5 THEN CAST(k % 9 AS STRING) WHEN g = 6 THEN CASE WHEN k % 3 = 0 THEN 'A' ELSE 'B' END ELSE 'left  of it' END AS answer,
  CASE WHEN c % 13 = 0 THEN 'none' WHEN g < 4 THEN CASE WHEN c % 3 = 0 THEN 'about ' || z || ' m' ELSE z END WHEN g = 4 THEN CASE WHEN c % 5 = 0 THEN x || ' ' || y ELSE '(' || z || ', ' || y || ', 0.9)' END
       WHEN g = 5 THEN CAST(c % 9 AS STRING) WHEN g = 6 THEN CASE WHEN c % 2 = 0 THEN ' a ' ELSE 'B' END ELSE 'Left of IT' END AS vlm_answer
FROM (SELECT *, CAST(CAST(t / 1e1 AS DECIMAL(12,1)) AS STRING) AS x, CAST(CAST((t % 7) / 1e1 AS DECIMAL(12,1)) AS STRING) AS y, CAST(CAST(u / 1e1 AS DECIMAL(12,1)) AS STRING) AS z,
        CASE g WHEN 0 THEN 'distance_measurement_players' WHEN 1 THEN 'dynamics_speed_player' WHEN 2 THEN 'dynamics_path_player' WHEN 3 THEN 'dynamics_time_intercept' WHEN 4 THEN 'Localization' WHEN 5 THEN 'spatial_counting_left' WHEN 6 THEN 'relational_reasoning_dyn_faster' ELSE 'free text' END AS category
      FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_custkey % 8 AS INT) AS g, o_orderkey % 31 AS t, o_orderkey % 31 + o_custkey % 7 - 3 AS u, o_orderkey % 11 <> 0 AS has_prediction FROM {orders}))"""

#: Items under an old and a new truth with predictions: v1, v3, box height.
TRUTHS = """
SELECT model || '/' || arm AS model, category, item, prediction, score_tolerance, score_floor, reference_value AS v1, reference_value * (17 + item % 7) / 2e1 AS v3, 5e1 + (item * 7919) % 97 AS box_h FROM {scored}"""

#: Paired letters under old and new labels.
LABELS = """
SELECT CAST(o_custkey % 5 AS INT) AS cell, CAST(floor((o_orderkey - 1) / 2) AS BIGINT) AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS v1,
  CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'A' WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS v3,
  CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN (o_orderkey + o_custkey % 4) % 2 = 0 THEN ' a. it is A' ELSE 'b' END AS said FROM {orders}"""

#: Predictions in four frame modes of one family each, scored.
MODES = """
SELECT model, category, item, arm AS unit, CASE CAST(floor(item / 2) AS BIGINT) % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'static4' WHEN 2 THEN 'shuffle' ELSE 'single_v2' END AS mode, prediction, reference_value, score FROM {scored}"""

#: Read-then-convert answers.
READINGS = """
SELECT item, model, category, reference_value, CASE WHEN category LIKE 'dynamics_speed%' THEN 'cm/s' ELSE 'cm' END AS expected,
  CASE WHEN c % 17 = 0 THEN 'no reading' ELSE r || CASE WHEN category LIKE 'dynamics_speed%' THEN ' m/s' ELSE ' m' END || ' -> ' || v || CASE WHEN c % 9 = 0 THEN ' m' WHEN category LIKE 'dynamics_speed%' THEN ' cm/s' ELSE ' cm' END || CASE WHEN c % 4 = 0 THEN '.' ELSE '' END END AS raw_answer
FROM (SELECT o_orderkey AS item, o_custkey AS c, 'model_' || CAST(o_custkey % 3 AS STRING) AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'dynamics_speed_player' ELSE 'dynamics_path_player' END AS category, (o_orderkey % 83 + 4) / 1e1 AS reference_value,
        CAST(CAST((o_orderkey % 83 + o_custkey % 5) / 1e1 AS DECIMAL(12,1)) AS STRING) AS r, CAST(CAST((o_orderkey % 83 + o_custkey % 5) * (9 + o_custkey % 3) AS DECIMAL(12,1)) AS STRING) AS v FROM {orders})"""

#: How far the camera of a clip has turned, in image pixels: it moves each 45 frames by up to four pixels.
PAN = "CAST((frame DIV 45) * (k % 5) AS DOUBLE)"


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, frame, fx, fy, px, py): corners of all boxes in the image with their place on the pitch under the clip's map and camera, in
    frames with at least four boxes; of each fifth box one corner is labelled wrongly."""
    d = detections(spark, sf_dir)
    d = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("seq", "frame"))).where("n >= 4").drop("n")
    d = d.withColumn("k", F.expr("CAST(substr(seq, 6) AS INT)")).withColumn("pan", F.expr(PAN))
    corners = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.col("x") + dx * F.col("w")).alias("fx"), (F.col("y") + dy * F.col("h")).alias("fy")) for i, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))))).alias("c")
    p = d.select("seq", "frame", "track", "pan", corners).select("seq", "frame", "track", "pan", "c.*").withColumn("u", F.col("fx") - F.col("pan"))
    row = lambda a, b, c: a * F.col("u") + b * F.col("fy") + c
    below = row(0.00001, 0.0004, 1.0)
    wrong = F.when((F.col("i") == 3) & ((F.col("frame") + F.col("track")) % 5 == 0), 40.0).otherwise(0.0)
    return p.select("seq", "frame", "fx", "fy", (row(0.01, 0.001, -5.0) / below + wrong).alias("px"), (row(0.0005, 0.02, -3.0) / below - wrong).alias("py"))


#: Joints of five persons in each frame of a clip, made from embeddings: clip, frame, person, j, x, y, z.
JOINTS = """
SELECT clip, frame, person, j, person * 2 - 5 + frame * 5e-2 + e1 * 2e-1 AS x, 4 + e2 * 2e-1 - frame * 2e-2 AS y, 3e-1 * j AS z
FROM (SELECT 'p' || CAST(vec_id % 4 AS STRING) AS clip, CAST(floor(vec_id / 20) AS INT) + 1 AS frame, CAST(floor(vec_id / 4) AS INT) % 5 AS person, j, CAST(CASE j WHEN 0 THEN a[0] WHEN 1 THEN a[1] WHEN 2 THEN a[2] WHEN 3 THEN a[3] WHEN 4 THEN a[4] ELSE a[5] END AS DOUBLE) AS e1, CAST(CASE j WHEN 0 THEN a[6] WHEN 1 THEN a[7] WHEN 2 THEN a[8] WHEN 3 THEN a[9] WHEN 4 THEN a[10] ELSE a[11] END AS DOUBLE) AS e2
      FROM (SELECT vec_id, {array} AS a FROM {embeddings} WHERE embedding IS NOT NULL AND vec_id >= 0), (VALUES (0), (1), (2), (3), (4), (5)) AS js(j))"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, frame, person, joints)."""
    j = portable(spark, sf_dir, JOINTS.replace("{array}", "embedding"), "embeddings")
    g = j.groupBy("clip", "frame", "person").agg(F.sort_array(F.collect_list(F.struct("j", F.array("x", "y", "z").alias("p")))).alias("a"))
    return g.select("clip", "frame", F.col("person").cast("string").alias("person"), F.transform("a", lambda s: s["p"]).alias("joints"))


def cameras(poses: DataFrame) -> DataFrame:
    """(clip, cam, intrinsic, extrinsic): two cameras of each clip that look along the court."""
    lit = lambda m: F.array(*(F.array(*map(F.lit, r)) for r in m))
    inside = [[600.0, 0.0, 960.0, 0.0], [0.0, 600.0, 540.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    turned = lambda shift: [[1.0, 0.0, 0.0, shift], [0.0, 0.0, -1.0, 1.5], [0.0, 1.0, 0.0, 4.0], [0.0, 0.0, 0.0, 1.0]]
    cams = F.explode(F.array(*(F.struct(F.lit(c).alias("cam"), lit(inside).alias("intrinsic"), lit(turned(s)).alias("extrinsic")) for c, s in (("left", 1.0), ("right", -3.0))))).alias("c")
    return poses.select("clip").distinct().select("clip", cams).select("clip", "c.*")
