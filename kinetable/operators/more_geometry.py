"""Further trajectory operators: clip scale, dense windows, crops, visual acceleration pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def clip_scale(paths_px: DataFrame, paths_m: DataFrame, rendered: float, least_m: float = 0.3, least_n: int = 20, most_spread: float = 0.05) -> DataFrame:
    """(seq, n, k, spread, ok): pixels of the rendered width per metre, the median over path windows, with the spread of
    index-picked quartiles. ``paths_px`` and ``paths_m``: (seq, track, window_index, path); ``rendered``: scale of the rendering."""
    j = paths_px.select("seq", "track", "window_index", F.col("path").alias("px")).join(paths_m.select("seq", "track", "window_index", F.col("path").alias("m")), ["seq", "track", "window_index"])
    g = j.where(F.col("m") >= least_m).groupBy("seq").agg(F.median(F.col("px") * rendered / F.col("m")).alias("k"), F.sort_array(F.collect_list(F.col("px") * rendered / F.col("m"))).alias("ks"))
    n = F.size("ks")
    at = lambda e: F.get("ks", e.cast("int"))
    spread = F.try_divide(at(F.floor(3 * n / 4)) - at(F.floor(n / 4)), F.col("k"))
    return g.select("seq", n.cast("long").alias("n"), "k", spread.alias("spread"), ((n >= least_n) & (spread <= most_spread)).alias("ok"))


def px_answers(paths_px: DataFrame, clips: DataFrame, dur: float, width: float = 960.0) -> DataFrame:
    """(seq, track, window_index, path_px, speed_px) in pixels of the rendered width."""
    j = paths_px.where("path is not null").join(clips.select("seq", "width"), "seq").withColumn("path_px", F.col("path") * width / F.col("width"))
    return j.select("seq", "track", "window_index", "path_px", (F.col("path_px") / dur).alias("speed_px"))


def dense_windows(detections: DataFrame, frames: int = 51, hop: int = 25, least_h: float = 40.0, margin: float = 10.0, width: int = 1920, height: int = 1080) -> DataFrame:
    """(seq, track, window_index, path): windows in which the track has a large enough box, away from the edges, in every
    frame; the path of feet smoothed over 5 frames inside the window. If ``detections`` has places on the pitch (pitch_x, pitch_y), also their
    path_m, smoothed in the same way."""
    f = F.col("frame")
    first = F.greatest(F.lit(0), F.ceil((f - frames) / hop)).cast("int")
    rows = detections.withColumn("window_index", F.explode(F.when(first <= F.floor((f - 1) / hop), F.sequence(first, F.floor((f - 1) / hop).cast("int")))))
    ok = (F.col("h") >= least_h) & (F.col("x") >= margin) & (F.col("y") >= margin) & (F.col("x") + F.col("w") <= width - margin) & (F.col("y") + F.col("h") <= height - margin)
    key = ["seq", "track", "window_index"]
    order = Window.partitionBy(*key).orderBy("frame")
    points = {"path": (F.col("x") + F.col("w") / 2, F.col("y") + F.col("h"))}
    if "pitch_x" in detections.columns:
        points["path_m"] = (F.col("pitch_x"), F.col("pitch_y"))
    smooth = [F.avg(c).over(order.rowsBetween(-2, 2)).alias(f"_{name}{axis}") for name, p in points.items() for axis, c in enumerate(p)]
    p = rows.select(*key, "frame", ok.alias("ok"), *smooth)
    moved = lambda c: F.pow(F.col(c) - F.lag(c).over(order), 2)
    p = p.withColumns({f"_{name}": F.sqrt(moved(f"_{name}0") + moved(f"_{name}1")) for name in points})
    g = p.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok"), *(F.sum(f"_{name}").alias(name) for name in points))
    return g.where((F.col("n") == frames) & F.col("ok")).select(*key, *points)


def crop_rect(boxes: DataFrame, item: list[str], width: int, height: int, crop_w: int, crop_h: int, fill: float = 1.0) -> DataFrame:
    """(item, left, top, w, h): one crop of fixed size around the middle of all boxes of an item, pushed inside the image; null if the
    boxes reach over more than ``fill`` of it (0.9 for the half-size zoom)."""
    g = boxes.groupBy(*item).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    fits = (F.col("x1") - F.col("x0") <= crop_w * fill) & (F.col("y1") - F.col("y0") <= crop_h * fill)
    at = lambda a, b, size, most: F.bround(F.least(F.greatest((F.col(a) + F.col(b)) / 2 - size / 2, F.lit(0.0)), F.lit(float(most - size))))
    sides = {"left": at("x0", "x1", crop_w, width), "top": at("y0", "y1", crop_h, height), "w": F.lit(float(crop_w)), "h": F.lit(float(crop_h))}
    return g.select(*item, *(F.when(fits, v).alias(k) for k, v in sides.items()))


def accel_events(metrics: DataFrame, ratio: float = 1.35) -> DataFrame:
    """(seq, track, window_index, a, b, v1, v2, up): windows in which a player clearly speeds up or slows down."""
    key = ["seq", "track", "window_index"]
    half = lambda p, v, f=F.max: f(F.when(F.col("part") == p, F.col(v)))
    wide = metrics.groupBy(*key).agg(half("first", "a").alias("a"), half("second", "b").alias("b"), half("first", "speed").alias("v1"), half("second", "speed").alias("v2"))
    return wide.where((F.col("v1") > 0) & (F.col("v2") > 0)).where(F.greatest("v1", "v2") / F.least("v1", "v2") >= ratio).withColumn("up", F.col("v2") > F.col("v1"))


def accel_visual(events: DataFrame) -> DataFrame:
    """(seq, track, k, up, down): disjoint windows of one track, one speeding up and one slowing down, nearest first (then the first
    up, the first down), each used once; k counts a track's pairs in that order.

    The choice is one small group a track; distances are taken one by one, so no list of all pairs is made."""

    def greedy(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("window_index")
        a, b = dict(zip(part.window_index, part.a, strict=True)), dict(zip(part.window_index, part.b, strict=True))
        ups, downs = part.window_index[part.up].tolist(), set(part.window_index[~part.up])
        out = []
        for gap in range(1, int(part.window_index.max() - part.window_index.min()) + 1):
            if not ups or not downs:
                break
            left = []
            for u in ups:
                d = next((d for d in (u - gap, u + gap) if d in downs and (b[u] < a[d] or b[d] < a[u])), None)
                if d is None:
                    left.append(u)
                else:
                    downs.discard(d)
                    out.append((part.seq.iloc[0], int(part.track.iloc[0]), len(out), int(u), int(d)))
            ups = left
        return pd.DataFrame(out, columns=["seq", "track", "k", "up", "down"])

    return events.select("seq", "track", "window_index", "a", "b", "up").groupBy("seq", "track").applyInPandas(greedy, "seq string, track int, k int, up int, down int")
