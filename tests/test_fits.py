"""Maps fitted many at a time against a plain fit of each set, and how often maps are made for the camera's motion."""

import time

import numpy as np

from kinetable.operators import poses
from kinetable.plans import views


def plain_fit(image, pitch, seed, rounds=64):
    """One set at a time by singular values, as maps of four points and of all that agree."""

    def solve(a, b):
        rows = [r for (x, y), (u, v) in zip(a, b, strict=True) for r in ((x, y, 1, 0, 0, 0, -u * x, -u * y, -u), (0, 0, 0, x, y, 1, -v * x, -v * y, -v))]
        return np.linalg.svd(np.array(rows, float))[2][-1].reshape(3, 3)

    c, s = image.mean(0), image.std(0) + 1e-9
    scaled, best, most = (image - c) / s, None, -1.0
    for some in np.argsort(np.random.default_rng(seed).random((rounds, len(image))), 1)[:, :4]:
        q = np.c_[scaled, np.ones(len(image))] @ solve(scaled[some], pitch[some]).T
        off = np.linalg.norm(q[:, :2] / q[:, 2:] - pitch, axis=1)
        score = (off <= 1).sum() - (np.minimum(off, 1) ** 2).sum() / (len(image) + 1)
        if score > most:
            best, most = off <= 1, score
    if best.sum() < 6:
        return None, best.sum()
    h = solve(scaled[best], pitch[best]) @ np.array([[1 / s[0], 0, -c[0] / s[0]], [0, 1 / s[1], -c[1] / s[1]], [0, 0, 1]])
    return h / h[2, 2], best.sum()


def test_many_sets_at_once_are_the_plain_fits_and_faster():
    r, true = np.random.default_rng(4), np.array([[0.01, 0.001, -5.0], [0.0005, 0.02, -3.0], [0.00001, 0.0004, 1.0]])
    image = r.random((60, 16, 2)) * (1900, 900)
    q = np.concatenate([image, np.ones((60, 16, 1))], 2) @ true.T
    pitch = q[:, :, :2] / q[:, :, 2:] + r.normal(0, 0.02, (60, 16, 2))
    pitch[np.arange(60) % 3 > 0, 3] += (40, -40)
    pitch[np.arange(60) % 4 == 1, 7] += (-25, 30)
    pitch[50:] = r.random((10, 16, 2)) * 1000  # of these no six agree
    start = time.perf_counter()
    maps, n = poses.fits(image, pitch, list(range(60)))
    middle = time.perf_counter()
    plain = [plain_fit(image[i], pitch[i], i) for i in range(60)]
    assert middle - start < (time.perf_counter() - middle) / 3
    assert n.tolist() == [k for _, k in plain]
    for i, (h, k) in enumerate(plain):
        assert (np.isnan(maps[i]).all() and k < 6) if h is None else np.allclose(maps[i], h, rtol=1e-6, atol=1e-9)


def test_frames_of_uneven_numbers_of_points_in_one_batch(spark):
    rows = [("a", f, float(x), float(y), 0.5 * x, 0.25 * y) for f, n in ((1, 4), (2, 6), (3, 9), (4, 6)) for x, y in ((10 * i * i + f, 7 * i + (i % 3) * 40) for i in range(n))]
    got = {r.frame: (r.inliers, round(r.h00, 6), round(r.h11, 6), round(r.h20, 6)) for r in poses.fit_homographies(spark.createDataFrame(rows, "seq string, frame int, fx double, fy double, px double, py double").coalesce(1)).collect()}
    assert got == {2: (6, 0.5, 0.25, 0.0), 3: (9, 0.5, 0.25, 0.0), 4: (6, 0.5, 0.25, 0.0)}


def test_the_camera_motion_makes_each_map_once_and_only_those_it_compares(spark):
    plan = views.camera_motion(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan
    frames = spark.range(-60, 300).select(views.F.col("id").cast("int").alias("frame"))
    got = {r.frame for r in poses.compared(frames, 50, 30).collect()}
    assert got == {f for f in range(-60, 300) if (f - 1) % 30 == 0 or (f - 51) % 30 == 0}
