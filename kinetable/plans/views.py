"""Queries on two views of one event, maps from labelled points, camera motion and poses, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes, poses
from ..operators import geometry as geo
from ..sources import adapters as A
from . import trajectory
from .scoring import _rounded

SPAN, HOP, LEAST = 50, 25, 10
SCALE = 0.5


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips 2n and 2n + 1 stand for two views of event n; the second court is turned half round."""
    det = A.detections(spark, sf_dir)
    clips = A.clips(det)
    k = F.expr("CAST(substr(seq, 6) AS INT)")
    views = clips.select("seq", F.concat(F.lit("event_"), F.expr("CAST(CAST(substr(seq, 6) AS INT) DIV 2 AS STRING)")).alias("pair"), F.when(k % 2 == 0, "side").otherwise("top").alias("view"))
    players = det.join(geo.split_roles(det).where("role = 'player'").select("seq", "track"), ["seq", "track"])
    return boxes.cross_view(boxes.view_positions(players, clips, A.homographies(clips), views), "view", ("side", "top"), (28.0, 15.0))


def cross_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_instants(spark, sf_dir))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(boxes.alignment(_instants(spark, sf_dir)))


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = poses.compared(A.labelled_points(spark, sf_dir), SPAN, HOP)
    return poses.camera_motion(poses.fit_homographies(points), SPAN, HOP)


def fitted_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(poses.fit_homographies(A.labelled_points(spark, sf_dir)), 5)


def camera_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_motion(spark, sf_dir), 3)


def stillest_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.expr("CAST(substr(seq, 6) AS INT)")
    clips = A.clips(A.detections(spark, sf_dir)).select("seq", F.expr("CAST(substr(seq, 6) AS INT) DIV 4").alias("game"), F.when(k % 4 == 0, "hidden").otherwise("visible").alias("visibility"))
    motion = _motion(spark, sf_dir)
    return _rounded(poses.stillest_clips(motion.withColumn("motion", F.round("motion", 3)), clips, LEAST), 3)


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = A.poses(spark, sf_dir)
    return p, poses.joint_boxes(p, poses.projection(A.cameras(p)), 1920.0, 1080.0)


def joint_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_boxes(spark, sf_dir)[1])


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(poses.ground_xy(A.poses(spark, sf_dir)))


def pose_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, shown = _boxes(spark, sf_dir)
    return _rounded(poses.pose_windows(poses.ground_xy(p), shown, 9, 3, 10.0, SCALE))


QUERIES = {f.__name__: f for f in (cross_view, alignment, fitted_maps, camera_motion, stillest_clips, joint_boxes, ground, pose_windows)}

#: Positions of both views at the same instants, and the best assignment by trying all of the smaller side into the larger one.
_VIEWS = f"""{A.DETECTIONS}, {trajectory.ROLES}, at0 AS (SELECT seq, CAST(substr(seq, 6) AS INT) AS k, fps, unnest(range(1, CAST(floor((length / fps - 1) / 0.5::DOUBLE + 1e-9) AS INT) + 1)) * 0.5::DOUBLE AS t FROM clips
), at1 AS (SELECT seq, 'event_' || k // 2 AS pair, k % 2 AS top, t, CAST(round_even(t * fps, 0) + 1 AS INT) AS frame FROM at0
), pos AS (SELECT pair, top, t, track, (0.01::DOUBLE * (x + w / 2) + 0.001::DOUBLE * (y + h) - 5) / (0.00001::DOUBLE * (x + w / 2) + 0.0004::DOUBLE * (y + h) + 1) AS cx, (0.0005::DOUBLE * (x + w / 2) + 0.02::DOUBLE * (y + h) - 3) / (0.00001::DOUBLE * (x + w / 2) + 0.0004::DOUBLE * (y + h) + 1) AS cy
  FROM at1 JOIN detections USING (seq, frame) JOIN roles USING (seq, track) WHERE role = 'player'
), p AS (SELECT pair, top, t, CASE top WHEN 1 THEN 28 - cx ELSE cx END AS x, CASE top WHEN 1 THEN 15 - cy ELSE cy END AS y, row_number() OVER (PARTITION BY pair, t, top ORDER BY track) AS i, count(*) OVER (PARTITION BY pair, t, top) AS n FROM pos
), m AS (SELECT pair, t, max(n) FILTER (top = 0) AS n_a, max(n) FILTER (top = 1) AS n_b, avg(x) FILTER (top = 0) AS ax, avg(y) FILTER (top = 0) AS ay, avg(x) FILTER (top = 1) AS bx, avg(y) FILTER (top = 1) AS "by" FROM p GROUP BY pair, t HAVING n_a > 0 AND n_b > 0
), few AS (SELECT p.pair, p.t, i, x, y FROM p JOIN m ON m.pair = p.pair AND m.t = p.t WHERE top = CASE WHEN n_a <= n_b THEN 0 ELSE 1 END
), many AS (SELECT p.pair, p.t, i, x, y FROM p JOIN m ON m.pair = p.pair AND m.t = p.t WHERE top = CASE WHEN n_a <= n_b THEN 1 ELSE 0 END
), d AS (SELECT few.pair, few.t, few.i, many.i AS j, sqrt(pow(few.x - many.x, 2) + pow(few.y - many.y, 2)) AS d FROM few JOIN many ON few.pair = many.pair AND few.t = many.t
), tried AS (SELECT pair, t, 0 AS i, 0 AS used, 0.0::DOUBLE AS total, []::DOUBLE[] AS ds FROM m UNION ALL SELECT tried.pair, tried.t, tried.i + 1, used + (1 << j::INT), total + d, list_append(ds, d) FROM tried JOIN d ON d.pair = tried.pair AND d.t = tried.t AND d.i = tried.i + 1 AND (used & (1 << j::INT)) = 0
), best AS (SELECT pair, t, arg_min(ds, total) AS ds FROM tried JOIN m USING (pair, t) WHERE i = least(n_a, n_b) GROUP BY pair, t
), instants AS (SELECT m.*, list_aggregate(ds, 'median') AS matched FROM m JOIN best USING (pair, t))"""

_MAPS = f"""{A.DETECTIONS}, labelled AS (SELECT seq, frame, CAST((frame // 45) * (k % 5) AS DOUBLE) AS pan, 4 - CASE WHEN (frame + track) % 5 = 0 THEN 1 ELSE 0 END AS ok FROM (SELECT *, CAST(substr(seq, 6) AS INT) AS k FROM detections)
), maps AS (SELECT seq, frame, any_value(pan) AS pan, CAST(sum(ok) AS INT) AS inliers FROM labelled GROUP BY seq, frame HAVING count(*) >= 4), motion AS (SELECT a.seq, a.frame, abs(b.pan - a.pan) * 0.5::DOUBLE AS motion FROM maps a JOIN maps b ON a.seq = b.seq AND b.frame = a.frame + {SPAN} WHERE (a.frame - 1) % {HOP} = 0)"""
_CELL = {"h00": ("0.01", None), "h01": ("0.001", None), "h02": ("-5", "0.01"), "h10": ("0.0005", None), "h11": ("0.02", None), "h12": ("-3", "0.0005"), "h20": ("0.00001", None), "h21": ("0.0004", None), "h22": ("1", "0.00001")}
_MATRIX = ", ".join(f"round(({a}::DOUBLE{f' - {b}::DOUBLE * pan' if b else ''}) / (1 - 0.00001::DOUBLE * pan), 5) AS {c}" for c, (a, b) in _CELL.items())

_JOINTS = A.JOINTS.replace("{embeddings}", "embeddings").replace("AS STRING", "AS VARCHAR").replace("{array}", "embedding")
for _i in reversed(range(12)):
    _JOINTS = _JOINTS.replace(f"a[{_i}]", f"a[{_i + 1}]")
_POSES = f"""joints AS ({_JOINTS}), seen AS (SELECT *, cam, y + 4 AS depth, 600 * (x + shift) + 960 * (y + 4) AS un, 600 * (1.5::DOUBLE - z) + 540 * (y + 4) AS vn FROM joints, (VALUES ('left', 1.0::DOUBLE), ('right', -3.0::DOUBLE)) c(cam, shift)
), uv AS (SELECT *, un / depth AS u, vn / depth AS v FROM seen), bare AS (SELECT clip, cam, frame, person, min(u) AS a, min(v) AS b, max(u) AS c, max(v) AS d FROM uv GROUP BY ALL HAVING min(depth) > 1e-6 AND max(u) - min(u) >= 1 AND max(v) - min(v) >= 1
), padded AS (SELECT clip, cam, frame, CAST(person AS VARCHAR) AS person, a - (c - a) * 0.12::DOUBLE AS x0, b - (d - b) * 0.12::DOUBLE AS y0, c + (c - a) * 0.12::DOUBLE AS x1, d + (d - b) * 0.12::DOUBLE AS y1 FROM bare
), boxes AS (SELECT * FROM padded WHERE x0 >= 4 AND y0 >= 4 AND x1 <= 1916 AND y1 <= 1076), ground AS (SELECT clip, frame, CAST(person AS VARCHAR) AS person, median(x) AS gx, median(y) AS gy FROM joints GROUP BY ALL)"""

ORACLES = {
    "cross_view": f"WITH RECURSIVE {_VIEWS} SELECT pair, round(t, 6) AS t, n_a, n_b, round(ax, 6) AS ax, round(ay, 6) AS ay, round(bx, 6) AS bx, round(\"by\", 6) AS \"by\", round(matched, 6) AS matched FROM instants",
    "alignment": f"""WITH RECURSIVE {_VIEWS} SELECT pair, count(*) AS n, round(CASE WHEN stddev_pop(ax) > 0 AND stddev_pop(bx) > 0 THEN covar_pop(ax, bx) / (stddev_pop(ax) * stddev_pop(bx)) END, 6) AS pearson_x, round(CASE WHEN stddev_pop(ay) > 0 AND stddev_pop("by") > 0 THEN covar_pop(ay, "by") / (stddev_pop(ay) * stddev_pop("by")) END, 6) AS pearson_y,
  round(median(sqrt(pow(ax - bx, 2) + pow(ay - "by", 2))), 6) AS centroid_distance, round(median(matched), 6) AS matched FROM instants GROUP BY pair""",
    "fitted_maps": f"WITH {_MAPS} SELECT seq, frame, inliers, {_MATRIX} FROM maps",
    "camera_motion": f"WITH {_MAPS} SELECT seq, frame, round(motion, 3) AS motion FROM motion",
    "stillest_clips": f"""WITH {_MAPS}, g AS (SELECT seq, median(round(motion, 3)) AS motion, count(*) AS n FROM motion GROUP BY seq HAVING count(*) >= {LEAST}), c AS (SELECT g.*, CAST(substr(seq, 6) AS INT) // 4 AS game FROM g WHERE CAST(substr(seq, 6) AS INT) % 4 <> 0)
SELECT game, seq, round(motion, 3) AS motion, n FROM c QUALIFY row_number() OVER (PARTITION BY game ORDER BY motion, seq) = 1""",
    "joint_boxes": f"WITH {_POSES} SELECT clip, cam, frame, person, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM boxes",
    "ground": f"WITH {_POSES} SELECT clip, frame, person, round(gx, 6) AS gx, round(gy, 6) AS gy FROM ground",
    "pose_windows": f"""WITH {_POSES}, fr AS (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip) AS n FROM (SELECT DISTINCT clip, frame FROM ground)
), w AS (SELECT clip, frame, window_index, i - 3 * window_index AS k FROM (SELECT *, unnest(range(0, n // 3 + 1)) AS window_index FROM fr) WHERE 3 * window_index <= i AND i <= 3 * window_index + 9 AND 3 * window_index < n - 9
), st AS (SELECT clip, window_index, person, frame, sqrt(pow(gx - lag(gx) OVER o, 2) + pow(gy - lag(gy) OVER o, 2)) AS s FROM ground JOIN w USING (clip, frame) WINDOW o AS (PARTITION BY clip, window_index, person ORDER BY k)
), walked AS (SELECT clip, window_index, person, sum(s) AS path_m, min(frame) AS f0, max(frame) AS f1 FROM st GROUP BY ALL HAVING count(*) = 10
), sh AS (SELECT clip, cam, window_index, person, (y1 - y0) * {SCALE} AS h, sqrt(pow((x0 + x1) / 2 * {SCALE} - lag((x0 + x1) / 2 * {SCALE}) OVER o, 2) + pow(y1 * {SCALE} - lag(y1 * {SCALE}) OVER o, 2)) AS s FROM boxes JOIN w USING (clip, frame) WHERE k IN (0, 3, 6, 9) AND (y1 - y0) * {SCALE} >= 14 WINDOW o AS (PARTITION BY clip, cam, window_index, person ORDER BY k)
), v AS (SELECT clip, cam, window_index, person, sum(s) AS px, median(h) AS box_h FROM sh GROUP BY ALL HAVING count(*) = 4)
SELECT clip, cam, CAST(window_index AS INT) AS window_index, person, f0, f1, round(path_m, 6) AS path_m, round(path_m / ((f1 - f0) / 10.0::DOUBLE), 6) AS speed, round(px, 6) AS px_disp, round(box_h, 6) AS box_h FROM walked JOIN v USING (clip, window_index, person)""",
}
