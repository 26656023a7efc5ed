"""Trajectory geometry: roles, smoothing, windows and path metrics, all keyed by clip, track and window.

Frames meet windows by arithmetic on the frame's number, never by a join. A track's rows are dealt by (clip, track) once; its
windows, their halves and all medians and paths are made from the rows of one window, which are as many as its frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLAYER_PX = 60.0
HALF = 5
STRIDE = 5
HEIGHT_M = 1.93
STABLE = 0.15
EDGE_START, EDGE_END = 6, 5


def split_roles(detections: DataFrame) -> DataFrame:
    """(seq, track, median_h, role): tracks of median height 60 px or more are players; of the rest the lowest is the ball."""
    tracks = detections.groupBy("seq", "track").agg(F.median("h").alias("median_h"))
    player = F.col("median_h") >= PLAYER_PX
    first = F.row_number().over(Window.partitionBy("seq", player).orderBy("median_h", "track"))
    return tracks.select("seq", "track", "median_h", F.when(player, "player").when(first == 1, "ball").otherwise("other").alias("role"))


def foot_points(detections: DataFrame) -> DataFrame:
    return detections.select("seq", "track", "frame", (F.col("x") + F.col("w") / 2).alias("fx"), (F.col("y") + F.col("h")).alias("fy"))


def ball_center(detections: DataFrame, roles: DataFrame) -> DataFrame:
    """(seq, frame, bx, by): centres of the ball's boxes."""
    balls = roles.where("role = 'ball'").select("seq", "track")
    return detections.join(balls, ["seq", "track"]).select("seq", "frame", (F.col("x") + F.col("w") / 2).alias("bx"), (F.col("y") + F.col("h") / 2).alias("by"))


def _spine(detections: DataFrame, half: int) -> DataFrame:
    """Every frame from ``half`` before a track's first box to ``half`` after its last: seq, track, frame, h, fx, fy (null where
    the box is missing) and the other columns of ``detections``, which has the clip's ``length``."""
    order = Window.partitionBy("seq", "track").orderBy("frame")
    before, after = F.lag("frame").over(order), F.lead("frame").over(order)
    rows = detections.withColumns({"_a": F.when(before.isNull(), F.greatest(F.lit(1), F.col("frame") - half)).otherwise(F.col("frame")), "_b": F.coalesce(after - 1, F.least("length", F.col("frame") + half), "frame")})
    rows = rows.withColumn("_f", F.explode(F.sequence("_a", F.greatest("_a", "_b"))))
    here = lambda c: F.when(F.col("_f") == F.col("frame"), c)
    rest = [c for c in detections.columns if c not in ("seq", "track", "frame", "x", "y", "w", "h")]
    return rows.select("seq", "track", F.col("_f").alias("frame"), here(F.col("h")).alias("h"), here(F.col("x") + F.col("w") / 2).alias("fx"), here(F.col("y") + F.col("h")).alias("fy"), *rest)


def _smoothed(detections: DataFrame, half: int) -> DataFrame:
    near = Window.partitionBy("seq", "track").orderBy("frame").rangeBetween(-half, half)
    return _spine(detections, half).withColumns({"sx": F.avg("fx").over(near), "sy": F.avg("fy").over(near)})


def smooth_feet(detections: DataFrame, clips: DataFrame, half: int = HALF) -> DataFrame:
    """(seq, track, frame, sx, sy): centred mean over the frames present within ``half``, also where the box is missing."""
    own = detections.select("seq", "track", "frame", "x", "y", "w", "h").join(clips.select("seq", "length"), "seq").repartition("seq", "track")
    return _smoothed(own, half).select("seq", "track", "frame", "sx", "sy").where("sx is not null")


def window_grid(clips: DataFrame, win_s: float = 2.0, hop_s: float = 1.0) -> DataFrame:
    """(seq, fps, length, win, hop, n): frames of a clip's windows and hops, and how many windows it has; a window ends 5 frames
    before the clip does."""
    win, hop = F.bround(F.lit(win_s) * F.col("fps")).cast("int"), F.bround(F.lit(hop_s) * F.col("fps")).cast("int")
    g = clips.select("seq", "fps", "length", win.alias("win"), hop.alias("hop"))
    return g.withColumn("n", F.greatest(F.lit(0), F.floor((F.col("length") - EDGE_END - F.col("win") - EDGE_START) / F.col("hop")) + 1).cast("int"))


def make_windows(clips: DataFrame, win_s: float = 2.0, hop_s: float = 1.0, n_frames: int = 4) -> DataFrame:
    """(seq, window_index, f0, f1, mid, frames, dur, fps): windows from frame 6 while they end 5 frames before the clip does."""
    w = window_grid(clips, win_s, hop_s).where("n > 0").withColumn("window_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    w = w.withColumn("f0", EDGE_START + F.col("window_index") * F.col("hop"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(n_frames - 1)), lambda i: F.bround(F.col("f0") + i * F.col("win") / (n_frames - 1)).cast("int"))
    f1 = F.col("f0") + F.col("win")
    return w.select("seq", "window_index", "f0", f1.alias("f1"), F.expr("(f0 + f0 + win) div 2").alias("mid"), frames.alias("frames"), (F.col("win") / F.col("fps")).alias("dur"), "fps")


def assign_frames(rows: DataFrame) -> DataFrame:
    """Rows (frame, and win, hop, n of their clip's grid) with each ``window_index`` whose frames contain theirs, and its ``f0``."""
    f = F.col("frame") - EDGE_START
    first = F.greatest(F.lit(0), F.ceil((f - F.col("win")) / F.col("hop"))).cast("int")
    last = F.least(F.col("n") - 1, F.floor(f / F.col("hop")).cast("int"))
    out = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("window_index", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return out.withColumn("f0", EDGE_START + F.col("window_index") * F.col("hop"))


def _player_windows(detections: DataFrame, grid: DataFrame, fields: list[str], points=None, half: int = HALF) -> DataFrame:
    """(seq, track, window_index, fps, f0, f1, at): ``at`` holds the smoothed rows of a player's window in order of frames:
    structs of frame, h, fx, fy and ``fields``. ``points`` adds columns to the smoothed rows. Dealt once, by (seq, track)."""
    cols = ["seq", "track", "frame", "x", "y", "w", "h"]
    own = detections.select(*cols).join(grid.where("n > 0"), "seq").repartition("seq", "track")
    own = own.withColumn("_m", F.median("h").over(Window.partitionBy("seq", "track"))).where(F.col("_m") >= PLAYER_PX).drop("_m")
    rows = _smoothed(own, half)
    rows = assign_frames(points(rows) if points else rows)
    g = rows.groupBy("seq", "track", "window_index", "f0", "win", "fps").agg(F.sort_array(F.collect_list(F.struct("frame", "h", "fx", "fy", *fields))).alias("at"))
    return g.select("seq", "track", "window_index", "fps", "f0", (F.col("f0") + F.col("win")).alias("f1"), "at")


def _parts(windows: DataFrame) -> DataFrame:
    """Each window as a whole and in its two halves: part, a, b."""
    part = lambda n, a, b: F.struct(F.lit(n).alias("part"), F.col(a).alias("a"), F.col(b).alias("b"))
    w = windows.withColumn("mid", F.expr("(f0 + f1) div 2"))
    w = w.withColumn("p", F.explode(F.array(part("full", "f0", "f1"), part("first", "f0", "mid"), part("second", "mid", "f1"))))
    return w.select("seq", "track", "window_index", "fps", "at", "p.part", "p.a", "p.b")


def _at(frame: Column) -> Column:
    """The struct of a frame in ``at``, whose frames have no holes; null beyond its ends."""
    return F.get("at", frame - F.element_at("at", 1)["frame"])


def _heights(low: Column, high: Column) -> Column:
    """The heights of the boxes in frames low to high, in ascending order."""
    first = F.element_at("at", 1)["frame"]
    start = F.greatest(low, first)
    rows = F.slice("at", start - first + 1, F.greatest(high - start + 1, F.lit(0)))
    return F.sort_array(F.array_compact(rows["h"]))


def _middle(ordered: str) -> Column:
    """Median of an array in ascending order; null if it is empty."""
    n = F.size(ordered)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def _points(x: str, y: str, stride: int = STRIDE) -> Column:
    """The points at a, a+stride, ..., b as structs of x and y, null where there is none. A column of its own, so that a path reads it more than once."""
    frames = F.array_distinct(F.concat(F.sequence("a", "b", F.lit(stride)), F.array("b")))
    first = F.element_at("at", 1)["frame"]
    return F.transform(F.transform(frames, lambda i: F.get("at", i - first)), lambda p: F.struct(p[x].alias("x"), p[y].alias("y")))


def _path(points: str) -> Column:
    """Sum of the steps between neighbouring points; null if any is missing or there is one only."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points)), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
    whole = F.forall(points, lambda p: p["x"].isNotNull())
    return F.when((F.size(points) >= 2) & whole, F.aggregate(steps, F.lit(0.0), lambda s, v: s + v))


def body_metrics(detections: DataFrame, clips: DataFrame, win_s: float = 2.0, hop_s: float = 1.0, height_m: float = HEIGHT_M) -> DataFrame:
    """Path and mean speed of every player, window and half in the body-height ruler; null without a stable depth: the median
    heights of the first and the last 11 frames differ by 15 % at most.

    (seq, track, window_index, part, a, b, fps, median_h, stable, path_px, path_m, speed, foot_x, foot_y); the foot is that of
    the box in frame b itself."""
    w = _parts(_player_windows(detections, window_grid(clips, win_s, hop_s), ["sx", "sy"]))
    a, b = F.col("a"), F.col("b")
    w = w.select("*", _heights(a, b).alias("_all"), _heights(a, F.least(a + 10, b)).alias("_early"), _heights(F.greatest(b - 10, a), b).alias("_late"), _points("sx", "sy").alias("_points"), _at(b).alias("_foot")).drop("at")
    w = w.select("*", _middle("_all").alias("median_h"), _middle("_early").alias("_h0"), _middle("_late").alias("_h1"), _path("_points").alias("path_px")).where("median_h is not null")
    stable = F.when((F.col("_h0") > 0) & (F.col("_h1") > 0), F.abs(F.col("_h1") / F.col("_h0") - 1) <= STABLE).otherwise(False)
    w = w.withColumn("stable", stable).withColumn("path_m", F.when(F.col("stable"), F.col("path_px") * height_m / F.col("median_h")))
    return w.select("seq", "track", "window_index", "part", "a", "b", "fps", "median_h", "stable", "path_px", "path_m", (F.col("path_m") / ((b - a) / F.col("fps"))).alias("speed"), F.col("_foot.fx").alias("foot_x"), F.col("_foot.fy").alias("foot_y"))


_H = [f"h{i}{j}" for i in range(3) for j in range(3)]


def court_point(x: Column, y: Column) -> tuple[Column, Column]:
    """The projective image of a point in court metres, by the columns h00 to h22."""
    v = [F.col(f"h{r}0") * x + F.col(f"h{r}1") * y + F.col(f"h{r}2") for r in range(3)]
    return F.try_divide(v[0], v[2]), F.try_divide(v[1], v[2])


def to_court(points: DataFrame, homographies: DataFrame, x: str = "sx", y: str = "sy") -> DataFrame:
    """``points`` with (cx, cy): the projective image in court metres."""
    cx, cy = court_point(F.col(x), F.col(y))
    return points.join(homographies, "seq").select(*points.columns, cx.alias("cx"), cy.alias("cy"))


def court_parts(detections: DataFrame, clips: DataFrame, homographies: DataFrame, win_s: float = 2.0, hop_s: float = 1.0) -> DataFrame:
    """(seq, track, window_index, part, a, b, fps, path_m, speed, foot_x, foot_y) on the court, smoothed in the image first; no
    depth gate. The foot is that of the box in frame b itself, in metres."""
    grid = window_grid(clips, win_s, hop_s).join(homographies.select("seq", *_H), "seq")

    def points(rows: DataFrame) -> DataFrame:
        (cx, cy), (gx, gy) = court_point(F.col("sx"), F.col("sy")), court_point(F.col("fx"), F.col("fy"))
        return rows.withColumns({"cx": cx, "cy": cy, "gx": gx, "gy": gy})

    w = _parts(_player_windows(detections, grid, ["cx", "cy", "gx", "gy"], points))
    w = w.select("*", _points("cx", "cy").alias("_points"), _at(F.col("b")).alias("_foot")).drop("at").withColumn("path_m", _path("_points"))
    speed = F.col("path_m") / ((F.col("b") - F.col("a")) / F.col("fps"))
    return w.select("seq", "track", "window_index", "part", "a", "b", "fps", "path_m", speed.alias("speed"), F.col("_foot.gx").alias("foot_x"), F.col("_foot.gy").alias("foot_y"))


def court_metrics(detections: DataFrame, clips: DataFrame, homographies: DataFrame, win_s: float = 2.0, hop_s: float = 1.0) -> DataFrame:
    """(seq, track, window_index, path_m, speed) of whole windows on the court."""
    return court_parts(detections, clips, homographies, win_s, hop_s).where("part = 'full' and path_m is not null").select("seq", "track", "window_index", "path_m", "speed")


def time_to_intercept(detections: DataFrame, metrics: DataFrame, height_m: float = HEIGHT_M) -> DataFrame:
    """(seq, track, window_index, seconds, dist_m): distance to the ball at the window's last frame over the mean speed; both
    boxes must be present in that very frame."""
    full = metrics.where("part = 'full' and speed > 0 and foot_x is not null").select("seq", "track", "window_index", F.col("b").alias("frame"), "median_h", "speed", "foot_x", "foot_y")
    at = full.join(ball_center(detections, split_roles(detections)), ["seq", "frame"])
    px = F.sqrt(F.pow(F.col("foot_x") - F.col("bx"), 2) + F.pow(F.col("foot_y") - F.col("by"), 2))
    at = at.withColumn("dist_m", px * height_m / F.col("median_h"))
    return at.select("seq", "track", "window_index", (F.col("dist_m") / F.col("speed")).alias("seconds"), "dist_m")


def time_to_ball_court(detections: DataFrame, parts: DataFrame, homographies: DataFrame) -> DataFrame:
    """(seq, track, window_index, seconds, dist_m) on the court, the ball taken to lie on the floor. ``parts``: of ``court_parts``."""
    balls = to_court(ball_center(detections, split_roles(detections)), homographies, "bx", "by").select("seq", "frame", "cx", "cy")
    full = parts.where("part = 'full' and speed > 0 and foot_x is not null").select("seq", "track", "window_index", F.col("b").alias("frame"), "speed", "foot_x", "foot_y")
    at = full.join(balls, ["seq", "frame"]).withColumn("dist_m", F.sqrt(F.pow(F.col("foot_x") - F.col("cx"), 2) + F.pow(F.col("foot_y") - F.col("cy"), 2)))
    return at.select("seq", "track", "window_index", (F.col("dist_m") / F.col("speed")).alias("seconds"), "dist_m")


def box_overlap(detections: DataFrame, presented: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(seq, track, frame, max_iou) of presented boxes: the largest overlap with another player's box of the same frame.

    ``presented``: (seq, track, frame). Boxes meet only in x cells of their own width, so a crowded frame isn't squared."""
    cell = lambda v: F.floor(v / 64).cast("int")
    boxes = detections.withColumn("cell", F.explode(F.sequence(cell(F.col("x")), cell(F.col("x") + F.col("w")))))
    left = boxes.join(presented, ["seq", "track", "frame"], "left_semi")
    players = (split_roles(detections) if roles is None else roles).where("role = 'player'").select("seq", "track")
    right = boxes.join(players, ["seq", "track"]).select("seq", "frame", "cell", F.col("track").alias("other"), *(F.col(c).alias(f"o{c}") for c in "xywh"))
    pairs = left.join(right, ["seq", "frame", "cell"]).where("track <> other")
    wide = F.greatest(F.lit(0.0), F.least(F.col("x") + F.col("w"), F.col("ox") + F.col("ow")) - F.greatest("x", "ox"))
    high = F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("h"), F.col("oy") + F.col("oh")) - F.greatest("y", "oy"))
    both = wide * high
    iou = both / (F.col("w") * F.col("h") + F.col("ow") * F.col("oh") - both)
    found = pairs.select("seq", "track", "frame", iou.alias("iou")).groupBy("seq", "track", "frame").agg(F.max("iou").alias("max_iou"))
    return presented.join(found, ["seq", "track", "frame"], "left").select("seq", "track", "frame", F.coalesce("max_iou", F.lit(0.0)).alias("max_iou"))
