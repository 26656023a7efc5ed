"""Readers and writers on files of a few lines."""

import json

from kinetable.sources import io


def test_mot_and_seqinfo(spark, tmp_path):
    d = tmp_path / "clip_a" / "gt"
    d.mkdir(parents=True)
    (d / "gt.txt").write_text("1,3,10.5,20,30,40,1,1,1\n\n2,3,11,20,30,40\n")
    (tmp_path / "clip_a" / "seqinfo.ini").write_text("[Sequence]\nname=clip_a\nframeRate=29.97\nimWidth=3840\nimHeight=2160\nseqLength=900\n")
    got = io.read_mot(spark, f"{tmp_path}/*/gt/gt.txt").orderBy("frame").collect()
    assert [tuple(r) for r in got] == [("clip_a", 3, 1, 10.5, 20.0, 30.0, 40.0), ("clip_a", 3, 2, 11.0, 20.0, 30.0, 40.0)]
    assert tuple(io.read_seqinfo(spark, f"{tmp_path}/*/seqinfo.ini").first()) == ("clip_a", 29.97, 3840, 2160, 900)


def test_qa(spark, tmp_path):
    item = {"category": "speed", "question": "q", "answer": "1.0", "meta": {"seq": "c", "track": 3, "window": [6, 66]}}
    (tmp_path / "a.json").write_text(json.dumps([item, item]))
    (tmp_path / "b.json").write_text(json.dumps({"qa": [item]}))
    got = io.read_qa(spark, f"{tmp_path}/*.json").collect()
    assert len(got) == 3 and all(r.meta.track == 3 and r.answer == "1.0" for r in got)


def test_predictions_of_complete_cells(spark, tmp_path):
    for cell, done in (("m_s1/c1/full", True), ("m_s2/c1/full", False)):
        d = tmp_path / cell
        d.mkdir(parents=True)
        (d / "log.jsonl").write_text(json.dumps({"index": 0, "raw_answer": "1"}) + "\n")
        (d / "summary.json").write_text("{}")
        if done:
            (d / "run_config.json").write_text("{}")
    r = io.read_predictions(spark, str(tmp_path)).collect()
    assert [(x.model, x.seed, x.seq, x.arm, x.raw_answer) for x in r] == [("m", 1, "c1", "full", "1")]


def test_homography_and_digests(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"H_img2court_m": [[1, 2, 3], [4, 5, 6], [7, 8, 9.5]]}))
    assert tuple(io.read_homography(spark, f"{tmp_path}/c.json").first())[:10] == ("c", 1, 2, 3, 4, 5, 6, 7, 8, 9.5)
    found = io.file_digests(spark, str(tmp_path))
    assert {r.status for r in io.compare_digests(found, found).collect()} == {"same"}
    assert {r.status for r in io.compare_digests(found, found.limit(0)).collect()} == {"unrecorded"}


def test_gamestate(spark, tmp_path):
    d = tmp_path / "g1"
    d.mkdir()
    box = {"x": 1, "y": 2, "w": 3, "h": 4, "x_center": 2.5, "y_center": 4}
    ann = [{"image_id": "i1", "category_id": c, "track_id": c, "bbox_image": box, "bbox_pitch": p} for c, p in ((1, {"x_bottom_middle": 5, "y_bottom_middle": 6}), (2, None), (3, {"x_bottom_middle": 5, "y_bottom_middle": 6}))]
    (d / "Labels.json").write_text(json.dumps({"images": [{"image_id": "i1", "file_name": "000007.jpg"}], "annotations": ann}))
    r = io.read_gamestate(spark, f"{d}/Labels.json").collect()
    assert [(x.clip, x.frame, x.track, x.fx, x.fy, x.px) for x in r] == [("g1", 7, 1, 2.5, 6.0, 5.0)]


def test_write_items(spark, tmp_path):
    df = spark.createDataFrame([("speed", "1.0"), ("path", "2.0")], "category string, answer string")
    io.write_items(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("category = 'path'").first().answer == "2.0"


def test_poses_and_cameras(spark, tmp_path):
    import json

    (tmp_path / "clip" / "pose_calib").mkdir(parents=True)
    (tmp_path / "clip" / "camera_calibration").mkdir()
    (tmp_path / "clip" / "pose_calib" / "00012.json").write_text(json.dumps({"3": [[1, 2, 3], [4, 5, 6]], "7": [[0, 0, 1]]}))
    (tmp_path / "clip" / "camera_calibration" / "side.json").write_text(json.dumps({"intrinsic": [[2, 0, 1, 0], [0, 2, 1, 0], [0, 0, 1, 0]], "extrinsic": [[1, 0, 0, 5], [0, 1, 0, 6], [0, 0, 1, 7], [0, 0, 0, 1]]}))
    got = {r.person: (r.clip, r.frame, r.joints) for r in io.read_poses(spark, f"{tmp_path}/clip/pose_calib/*.json").collect()}
    assert got == {"3": ("clip", 12, [[1, 2, 3], [4, 5, 6]]), "7": ("clip", 12, [[0, 0, 1]])}
    from kinetable.operators import poses

    p = poses.projection(io.read_camera(spark, f"{tmp_path}/clip/camera_calibration/*.json")).first()
    assert (p.clip, p.cam, p.p00, p.p02, p.p03, p.p13, p.p23) == ("clip", "side", 2, 1, 17, 19, 7)
