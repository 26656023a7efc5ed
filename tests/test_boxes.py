"""Boxes, poses, maps and views on small data with known answers."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import boxes, poses


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 6, 2)
    cost = r.random((n, m)).round(2)
    small = cost if n <= m else cost.T
    best = min(sum(small[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(small.shape[1]), small.shape[0]))
    found = boxes.assigned_distance(cost)
    assert len(found) == min(n, m) and math.isclose(found.sum(), best, abs_tol=1e-9)


def test_views(spark):
    rows = [("p", v, float(t), x, y) for t in range(4) for v, turn in (("side", False), ("top", True)) for x, y in (((28 - (3.0 + t), 15 - (2.0 + t % 2)), (28 - 10.0, 15 - 5.0)) if turn else ((3.0 + t, 2.0 + t % 2), (10.0, 5.0)))]
    df = spark.createDataFrame(rows, "pair string, view string, t double, x double, y double")
    got = boxes.alignment(boxes.cross_view(df, "view", ("side", "top"), (28.0, 15.0))).first()
    assert got.n == 4 and math.isclose(got.pearson_x, 1) and math.isclose(got.pearson_y, 1) and got.centroid_distance < 1e-9 and got.matched < 1e-9
    assert boxes.cross_view(df.where("view = 'top'"), "view", ("side", "top")).count() == 0


@pytest.fixture(scope="module")
def shown(spark):
    b = [("c", 1, f, 100.0 + 2 * f, 300.0, 40.0, 120.0) for f in (0, 20, 40, 60)] + [("c", 2, f, 1.0, 10.0 * f, 40.0, 100.0) for f in (0, 20, 60)] + [("c", 4, f, 300.0 + 9 * (f // 20) ** 2, 300.0, 40.0, 60.0) for f in (0, 20, 40, 60)]
    det = spark.createDataFrame(b, "seq string, track int, frame int, x double, y double, w double, h double")
    names = lambda t: [f"c_w0_t{t}_f{f}" for f in (0, 20, 40, 60)]
    tall = "Assume a typical player on this court is 1.93 m tall. "
    cats = [("a", 1, "dynamics_speed_player", tall, None), ("b", 1, "dynamics_path_player", tall, None), ("c", 1, "dynamics_time_intercept", tall, None), ("h", 1, "dynamics_path_player", tall.replace("1.93", "3.86"), None), ("i", 1, "dynamics_path_player", "q", None), ("d", 4, "relational_reasoning_dyn_accel", "(A) speeding up (B) slowing down", None), ("e", 4, "relational_reasoning_dyn_accel", "(A) slowing down (B) speeding up", None), ("f", 1, "relational_reasoning_dyn_faster", "q", 4), ("g", 2, "dynamics_speed_player", "q", None)]
    items = spark.createDataFrame([(i, "c", t, 0, 60, [0, 20, 40, 60], names(t), c, q, 2.0, b2) for i, t, c, q, b2 in cats], "item string, seq string, track int, f0 int, f1 int, frames array<int>, image_ids array<string>, category string, question string, dur double, track_b int")
    return det, items


def test_sparse_oracle(spark, shown):
    det, items = shown
    balls = spark.createDataFrame([("c", 60, 240.0, 420.0 + 193.0)], "seq string, frame int, bx double, by double")
    got = {r.item: r.answer for r in boxes.sparse_oracle(items, det, balls).collect()}
    # 120 px in 2 s at 1.93 / 120 m a px; the ball is 193 px away; 81 px at 1.93 / 60 is faster; the height is the question's
    assert got == {"a": "1.0", "b": "1.9", "c": f"{193 / 60:.1f}", "d": "A", "e": "B", "f": "B", "g": None, "h": "3.9", "i": None}


def test_box_checks(shown):
    det, items = shown
    flags = {r.item: r for r in boxes.box_qc_flags(boxes.presented(items, det, 0.5), 960, 540).collect()}
    assert (flags["a"].present, flags["a"].edge, flags["a"].px_disp, flags["a"].max_step, flags["a"].median_h) == (4, False, 60.0, 20.0, 60.0)
    assert (flags["g"].present, flags["g"].edge, flags["g"].px_disp, flags["g"].median_h) == (3, True, None, 50.0)
    h = {r.item: (r.heights, r.reason) for r in boxes.presented_heights(items, det).collect()}
    assert h["a"] == ([120.0] * 4, None) and h["g"] == (None, "missing")
    hurt = items.withColumn("image_ids", F.transform("image_ids", lambda n: F.concat(n, F.lit("x"))))
    assert {r.reason for r in boxes.presented_heights(hurt, det).collect()} == {"names"}
    assert {r.reason for r in boxes.presented_heights(items.withColumn("f1", F.lit(61)), det).collect()} == {"window"}


def test_verdicts(spark):
    df = spark.createDataFrame([("a", True, True, True), ("b", False, True, True), ("c", None, True, False), ("d", True, None, None)], "item string, q1 boolean, q2 boolean, q3 boolean")
    got = {r.question: (r.passed, r.failed) for r in boxes.qc_rates(df, ["q1", "q2", "q3"]).collect()}
    assert got == {"q1": (2, 1), "q2": (3, 0), "q3": (2, 1), "all": (1, 1)}


def test_pose_windows(spark):
    p = [[500.0, 0.0, 320.0, 0.0], [0.0, 500.0, 240.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    cams = spark.createDataFrame([("c", "cam", p, np.eye(4).tolist())], "clip string, cam string, intrinsic array<array<double>>, extrinsic array<array<double>>")
    rows = [("c", 10 * f, "1", [[0.1 * f, 0.0, 5.0], [0.1 * f, 0.5, 5.0], [0.1 * f + 0.2, 0.2, 5.0]]) for f in range(9)] + [("c", 10 * f, "2", [[0.0, 0.0, 5.0 if f else -1.0], [0.5, 0.5, 5.0]]) for f in range(9)]
    pose = spark.createDataFrame(rows, "clip string, frame int, person string, joints array<array<double>>")
    b = poses.joint_boxes(pose, poses.projection(cams), 640, 480)
    assert b.where("person = '2' and frame = 0").count() == 0
    one = b.where("person = '1' and frame = 0").first()
    assert math.isclose(one.x0, 320 - 20 * 0.12) and math.isclose(one.y1, 290 + 50 * 0.12)
    w = {(r.window_index, r.person): r for r in poses.pose_windows(poses.ground_xy(pose), b, 4, 2, 10.0, 1.0).collect()}
    # nine frames: windows of five start at 0, 2 and 4; person 2 has no box in the first frame
    assert set(w) == {(0, "1"), (1, "1"), (1, "2"), (2, "1"), (2, "2")}
    assert math.isclose(w[0, "1"].path_m, 0.4) and (w[0, "1"].f0, w[0, "1"].f1) == (0, 40) and math.isclose(w[0, "1"].speed, 0.1) and math.isclose(w[0, "1"].px_disp, 40.0)


def test_maps_and_motion(spark):
    true = np.array([[0.05, 0.01, -40.0], [0.002, 0.09, -30.0], [0.00001, 0.0009, 1.0]])
    r = random.Random(2)
    rows = []
    for frame, shift in ((1, 0.0), (51, 30.0)):
        for k in range(14):
            x, y = r.uniform(100, 1800), r.uniform(300, 1000)
            q = true @ [x, y, 1]
            bad = 9.0 if k == 3 else 0.0
            rows.append(("s", frame, x + shift, y, float(q[0] / q[2]) + bad, float(q[1] / q[2])))
    rows += [("s", 99, 1.0, 2.0, 3.0, 4.0)] * 5
    df = spark.createDataFrame(rows, "seq string, frame int, fx double, fy double, px double, py double")
    maps = poses.fit_homographies(df)
    got = {x.frame: x for x in maps.collect()}
    assert set(got) == {1, 51} and got[1].inliers == 13
    h = np.array([[got[1][f"h{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(h, true, atol=1e-6)
    move = poses.camera_motion(maps).collect()
    assert [m.frame for m in move] == [1] and math.isclose(move[0].motion, 15.0, abs_tol=1e-3)
    clips = spark.createDataFrame([("s", "g", "visible"), ("t", "g", "hidden")], "seq string, game string, visibility string")
    many = poses.camera_motion(maps).crossJoin(spark.range(25)).select("seq", "motion")
    assert poses.stillest_clips(many, clips).first().seq == "s" and poses.stillest_clips(many.limit(3), clips).count() == 0
