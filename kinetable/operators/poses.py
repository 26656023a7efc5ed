"""Poses in space, their boxes in a camera, and maps from labelled image points to the pitch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Margin at which a box counts as cut, padding of boxes around joints, and the least height in rendered pixels.
EDGE, PAD, LEAST_PX = 4.0, 0.12, 14.0
_P = [f"p{i}{j}" for i in range(3) for j in range(4)]


def projection(cameras: DataFrame) -> DataFrame:
    """(clip, cam, p00..p23): the product of an intrinsic 3 x 4 and an extrinsic 4 x 4 matrix."""
    cell = lambda i, j: sum((F.col("intrinsic")[i][k] * F.col("extrinsic")[k][j] for k in range(4)), F.lit(0.0))
    return cameras.select("clip", "cam", *(cell(i, j).alias(f"p{i}{j}") for i in range(3) for j in range(4)))


def ground_xy(poses: DataFrame) -> DataFrame:
    """(clip, frame, person, gx, gy): where a person stands: medians of all joints. ``poses``: (clip, frame, person, joints array<array<double>>)."""
    j = poses.select("clip", "frame", "person", F.explode("joints").alias("j"))
    return j.groupBy("clip", "frame", "person").agg(F.median(F.col("j")[0]).alias("gx"), F.median(F.col("j")[1]).alias("gy"))


def joint_boxes(poses: DataFrame, projections: DataFrame, width: float, height: float) -> DataFrame:
    """(clip, cam, frame, person, x0, y0, x1, y1): padded boxes around the joints' images; none if a joint is behind the camera, the box
    is under a pixel, or it comes within the edge."""
    j = poses.select("clip", "frame", "person", F.explode("joints").alias("j")).join(projections.select("clip", "cam", *_P), "clip")
    row = lambda i: F.col(f"p{i}0") * F.col("j")[0] + F.col(f"p{i}1") * F.col("j")[1] + F.col(f"p{i}2") * F.col("j")[2] + F.col(f"p{i}3")
    ahead = F.when(row(2) > 1e-6, row(2))
    j = j.select("clip", "cam", "frame", "person", (row(0) / ahead).alias("u"), (row(1) / ahead).alias("v"))
    g = j.groupBy("clip", "cam", "frame", "person").agg(F.bool_and(F.col("u").isNotNull()).alias("_ok"), F.min("u").alias("a"), F.min("v").alias("b"), F.max("u").alias("c"), F.max("v").alias("d")).where("_ok and c - a >= 1 and d - b >= 1")
    w, h = (F.col("c") - F.col("a")) * PAD, (F.col("d") - F.col("b")) * PAD
    g = g.select("clip", "cam", "frame", "person", (F.col("a") - w).alias("x0"), (F.col("b") - h).alias("y0"), (F.col("c") + w).alias("x1"), (F.col("d") + h).alias("y1"))
    return g.where((F.col("x0") >= EDGE) & (F.col("y0") >= EDGE) & (F.col("x1") <= width - EDGE) & (F.col("y1") <= height - EDGE))


def pose_windows(ground: DataFrame, boxes: DataFrame, win: int, hop: int, fps: float, scale: float, n_frames: int = 4) -> DataFrame:
    """(clip, cam, window_index, person, f0, f1, path_m, speed, px_disp, box_h): windows over the list of a clip's frames, persons who are in every
    frame and whose presented boxes are large enough; paths on the ground, displacement and median height in rendered pixels."""
    frames = ground.select("clip", "frame").distinct().withColumn("i", F.row_number().over(Window.partitionBy("clip").orderBy("frame")) - 1)
    n = frames.groupBy("clip").agg(F.count(F.lit(1)).alias("_n"))
    f = frames.join(n, "clip")
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - win) / hop)).cast("int"), F.least(F.floor(F.col("i") / hop), F.ceil((F.col("_n") - win) / hop) - 1).cast("int")
    f = f.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("window_index", F.explode(F.sequence("_a", "_b"))).withColumn("k", F.col("i") - F.col("window_index") * hop)
    f = f.select("clip", "frame", "window_index", "k")
    key = ["clip", "window_index", "person"]
    order = Window.partitionBy(*key).orderBy("k")
    g = ground.join(f, ["clip", "frame"]).withColumn("_s", F.sqrt(F.pow(F.col("gx") - F.lag("gx").over(order), 2) + F.pow(F.col("gy") - F.lag("gy").over(order), 2)))
    walked = g.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"), F.sum("_s").alias("path_m"), F.min("frame").alias("f0"), F.max("frame").alias("f1")).where(F.col("_c") == win + 1)
    shown = f.where(F.col("k").isin([round(j * win / (n_frames - 1)) for j in range(n_frames)]))
    at = boxes.join(shown, ["clip", "frame"]).where((F.col("y1") - F.col("y0")) * scale >= LEAST_PX)
    view = ["clip", "cam", "window_index", "person"]
    near = Window.partitionBy(*view).orderBy("k")
    fx, fy = (F.col("x0") + F.col("x1")) / 2 * scale, F.col("y1") * scale
    at = at.withColumns({"fx": fx, "fy": fy}).withColumn("_s", F.sqrt(F.pow(F.col("fx") - F.lag("fx").over(near), 2) + F.pow(F.col("fy") - F.lag("fy").over(near), 2)))
    seen = at.groupBy(*view).agg(F.count(F.lit(1)).alias("_c"), F.sum("_s").alias("px_disp"), F.median((F.col("y1") - F.col("y0")) * scale).alias("box_h")).where(F.col("_c") == n_frames).drop("_c")
    out = walked.drop("_c").join(seen, key).withColumn("speed", F.col("path_m") / ((F.col("f1") - F.col("f0")) / fps))
    return out.select("clip", "cam", "window_index", "person", "f0", "f1", "path_m", "speed", "px_disp", "box_h")


#: Frames whose samples are tried at a time in one numpy call; these fit a core's cache.
FRAMES = 16


@lru_cache(4096)
def _samples(seed: int, rounds: int, n: int) -> np.ndarray:
    """(rounds, 4): four of ``n`` points in each round."""
    return np.argsort(np.random.default_rng(seed).random((rounds, n)), 1)[:, :4].astype(np.int16)


def _maps_of_four(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(k, 3, rounds, 3): the rows of the maps that take four points ``a`` to ``b`` (k, rounds, 4, 2), up to a factor: from the first four points to
    the projective frame, from there to the others. Three points in a line give a map of lower rank, which no fourth point fits."""

    def frame(p):
        x, y = p[..., 0], p[..., 1]
        across = [np.stack([y[..., i] - y[..., j], x[..., j] - x[..., i], x[..., i] * y[..., j] - x[..., j] * y[..., i]], -1) for i, j in ((1, 2), (2, 0), (0, 1))]
        return across, [c[..., 0] * x[..., 3] + c[..., 1] * y[..., 3] + c[..., 2] for c in across]

    (across, u), (_, v) = frame(a), frame(b)
    parts = [(v[i] * u[(i + 1) % 3] * u[(i + 2) % 3])[..., None] * across[i] for i in range(3)]
    return np.stack([sum(b[..., i, c, None] * parts[i] for i in range(3)) for c in (0, 1)] + [sum(parts)], 1)


def fits(image: np.ndarray, pitch: np.ndarray, seeds: list[int], rounds: int = 64, most: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(image-to-pitch maps (k, 3, 3), inliers (k)) of k sets of n labelled points (k, n, 2), six at least: the best of seeded samples of four by points
    within ``most`` metres, then all of these. Sets of which fewer than six points agree have no map: NaN."""
    k, n = image.shape[:2]
    centre, spread = image.mean(1, keepdims=True), image.std(1, keepdims=True) + 1e-9
    image = (image - centre) / spread
    some = np.stack([_samples(s, rounds, n) for s in seeds])
    each = np.arange(k)[:, None, None]
    with np.errstate(all="ignore"):
        maps = _maps_of_four(image[each, some], pitch[each, some])
        seen = np.concatenate([image, np.ones((k, n, 1))], 2)
        q = (maps.reshape(k, -1, 3) @ seen.transpose(0, 2, 1)).reshape(k, 3, rounds, n)
        off = ((q[:, 0] / q[:, 2] - pitch[:, None, :, 0]) ** 2 + (q[:, 1] / q[:, 2] - pitch[:, None, :, 1]) ** 2) / most**2
    near = off <= 1
    # of maps with equally many points, the one that is nearest to them
    best = near[np.arange(k), (near.sum(2) - np.fmin(off, 1).sum(2) / (n + 1)).argmax(1)]
    found, inliers = np.full((k, 3, 3), np.nan), best.sum(1)
    ok = inliers >= 6
    if ok.any():
        p, b, zero = seen[ok], pitch[ok], np.zeros((int(ok.sum()), n, 3))
        rows = np.concatenate([np.concatenate([p, zero, -b[:, :, :1] * p], 2), np.concatenate([zero, p, -b[:, :, 1:] * p], 2)], 1)
        rows = np.where(np.concatenate([best[ok], best[ok]], 1)[:, :, None], rows, 0.0)  # rows of zeros change nothing
        turn = np.zeros((len(p), 3, 3))
        turn[:, (0, 1), (0, 1)], turn[:, :2, 2], turn[:, 2, 2] = 1 / spread[ok, 0], -centre[ok, 0] / spread[ok, 0], 1
        h = np.linalg.svd(rows, full_matrices=False)[2][:, -1].reshape(-1, 3, 3) @ turn
        last = h[:, 2:, 2:]
        found[ok] = h / np.where(np.abs(last) > 1e-12, last, 1.0)
    return found, inliers


def fit(image: np.ndarray, pitch: np.ndarray, rounds: int = 64, most: float = 1.0, seed: int = 1) -> tuple[np.ndarray | None, int]:
    """(map or None, inliers) of one set of points: see ``fits``."""
    h, n = fits(image[None], pitch[None], [seed], rounds, most)
    return (h[0] if n[0] >= 6 else None), int(n[0])


def fit_homographies(points: DataFrame) -> DataFrame:
    """(seq, frame, inliers, h00..h22) from labelled points (seq, frame, fx, fy, px, py) of frames with at least six, of which six must agree.
    Samples are seeded by the frame. Frames with equally many points are fitted together, ``FRAMES`` at a time."""
    cells = [f"h{i}{j}" for i in range(3) for j in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, frames = batch.column("points"), batch.column("frame").to_numpy(zero_copy_only=False)
            starts = np.asarray(lists.offsets)
            flat = lists.values
            values = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("fx", "fy", "px", "py")], 1)
            sizes = np.diff(starts)
            h, inliers = np.full((len(frames), 9), np.nan), np.zeros(len(frames), np.int32)
            for n in np.unique(sizes[sizes >= 6]):
                alike = np.flatnonzero(sizes == n)
                for at in (alike[i : i + FRAMES] for i in range(0, len(alike), FRAMES)):
                    p = values[starts[at][:, None] + np.arange(n)]
                    order = np.lexsort((*p.reshape(-1, 4).T[::-1], np.repeat(np.arange(len(at)), n)))
                    p = p.reshape(-1, 4)[order].reshape(p.shape)
                    maps, inliers[at] = fits(p[:, :, :2], p[:, :, 2:], [int(f) for f in frames[at]])
                    h[at] = maps.reshape(-1, 9)
            kept = np.flatnonzero(inliers >= 6)
            yield pa.RecordBatch.from_arrays([batch.column("seq").take(pa.array(kept)), pa.array(frames[kept], pa.int32()), pa.array(inliers[kept]), *(pa.array(h[kept, i]) for i in range(9))], names=["seq", "frame", "inliers", *cells])

    as_double = [F.col(c).cast("double").alias(c) for c in ("fx", "fy", "px", "py")]
    sets = points.groupBy("seq", "frame").agg(F.collect_list(F.struct(*as_double)).alias("points"))
    return sets.mapInArrow(run, f"seq string, frame int, inliers int, {', '.join(f'{c} double' for c in cells)}")


def compared(frames: DataFrame, span: int = 50, hop: int = 25) -> DataFrame:
    """The rows (frame, ...) of the frames whose maps ``camera_motion`` compares: the maps of all others needn't be fitted for it."""
    start = lambda f: F.pmod(f - 1, F.lit(hop)) == 0
    return frames.where(start(F.col("frame")) | start(F.col("frame") - span))


def camera_motion(maps: DataFrame, span: int = 50, hop: int = 25, width: float = 1920, height: float = 1080, canvas: float = 960) -> DataFrame:
    """(seq, frame, motion): how far, in canvas pixels, fixed points of the pitch move in the image within ``span`` frames: the median over a grid of
    points that one frame's map takes to the pitch and the inverse of the other's back. ``maps``: of ``fit_homographies``, one a frame; a map enters
    once for its own frame and once for the earlier one, so that they are made once."""
    h = {(i, j): f"h{i}{j}" for i in range(3) for j in range(3)}
    cells = F.struct(*h.values())
    none = F.when(F.lit(False), cells)
    side = lambda frame, own, later: F.struct(frame.alias("frame"), own.alias("h"), later.alias("g"))
    sides = F.array(side(F.col("frame"), cells, none), side(F.col("frame") - span, none, cells))
    two = compared(maps, span, hop).select("seq", F.explode(sides).alias("s")).select("seq", "s.*").where(F.pmod(F.col("frame") - 1, F.lit(hop)) == 0)
    j = two.groupBy("seq", "frame").agg(F.first("h", True).alias("h"), F.first("g", True).alias("g")).where("h is not null and g is not null")
    j = j.select("seq", "frame", *(F.col(f"h.{c}").alias(c) for c in h.values()), *(F.col(f"g.{c}").alias(f"g{c[1:]}") for c in h.values()))
    g = lambda i, k: F.col(f"g{i}{k}")
    # the adjugate is the inverse but for a factor, which a projective map doesn't see
    inv = [[g((j + 1) % 3, (i + 1) % 3) * g((j + 2) % 3, (i + 2) % 3) - g((j + 1) % 3, (i + 2) % 3) * g((j + 2) % 3, (i + 1) % 3) for j in range(3)] for i in range(3)]
    moved = []
    for x in (0.3 * width, 0.5 * width, 0.7 * width):
        for y in (0.45 * height, 0.625 * height, 0.8 * height):
            w = [F.col(f"h{r}0") * x + F.col(f"h{r}1") * y + F.col(f"h{r}2") for r in range(3)]
            q = [sum((inv[r][c] * w[c] for c in range(1, 3)), inv[r][0] * w[0]) for r in range(3)]
            moved.append(F.sqrt(F.pow(F.try_divide(q[0], q[2]) - x, 2) + F.pow(F.try_divide(q[1], q[2]) - y, 2)) * (canvas / width))
    det = g(0, 0) * inv[0][0] + g(0, 1) * inv[1][0] + g(0, 2) * inv[2][0]
    middle = F.array_sort(F.array(*moved))[4]
    return j.where(F.abs(det) > 1e-12).select("seq", "frame", middle.alias("motion"))


def stillest_clips(motion: DataFrame, clips: DataFrame, least: int = 20) -> DataFrame:
    """(game, seq, motion, n): of each game the visible clip with the lowest median camera motion over at least ``least`` windows.
    ``clips``: (seq, game, visibility)."""
    g = motion.groupBy("seq").agg(F.median("motion").alias("motion"), F.count("motion").alias("n")).where(F.col("n") >= least)
    j = g.join(clips.where("visibility = 'visible'").select("seq", "game"), "seq")
    return j.groupBy("game").agg(F.min(F.struct("motion", "seq", "n")).alias("m")).select("game", "m.seq", "m.motion", "m.n")
