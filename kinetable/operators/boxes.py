"""What the presented frames of an item show: box checks, crowding, answers from these frames alone, and views side by side.

Items: (item, seq, track, f0, f1, frames array<int>, ...). Frames meet boxes exactly, never the nearest one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..functions import texts
from .geometry import foot_points, to_court
from .ranks import middle, quantiles
from .stats import spearman

#: Overlap that counts, presented frames that must have it, and the movement in rendered pixels that is little.
CROWD_IOU, CROWD_FRAMES, CROWD_PX = 0.15, 2, 30.0


def presented(items: DataFrame, boxes: DataFrame, scale: float = 1.0, track: str = "track") -> DataFrame:
    """(item, shown): the boxes of the presented frames in order, structs of frame, x, y, w, h (scaled), null where there is no box."""
    at = items.select("item", "seq", F.col(track).alias("track"), F.posexplode("frames").alias("i", "frame"))
    b = boxes.select("seq", "track", "frame", *((F.col(c) * scale).alias(c) for c in "xywh"))
    j = at.join(b, ["seq", "track", "frame"], "left")
    box = F.when(F.col("h").isNotNull(), F.struct("frame", *"xywh"))
    return j.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("i", box.alias("box")))).alias("_s")).select("item", F.transform("_s", lambda s: s["box"]).alias("shown"))


def _steps(shown: Column) -> Column:
    """Distances between the feet of neighbouring presented boxes."""
    foot = lambda b: (b["x"] + b["w"] / 2, b["y"] + b["h"])

    def step(a, b):
        (ax, ay), (bx, by) = foot(a), foot(b)
        return F.sqrt(F.pow(bx - ax, 2) + F.pow(by - ay, 2))

    return F.zip_with(F.slice(shown, 1, F.greatest(F.size(shown) - 1, F.lit(0))), F.slice(shown, 2, F.size(shown)), step)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _median(a: Column) -> Column:
    v = F.sort_array(F.filter(a, lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def box_qc_flags(shown: DataFrame, width: float, height: float) -> DataFrame:
    """(item, present, n_frames, edge, px_disp, max_step, median_h) of ``presented``: boxes there are, whether one touches the image's
    edge, total and largest foot step (only if all boxes are there), and the median height."""
    have = F.filter("shown", lambda b: b.isNotNull())
    edge = F.exists(have, lambda b: (b["x"] <= 2) | (b["y"] <= 2) | (b["x"] + b["w"] >= width - 3) | (b["y"] + b["h"] >= height - 3))
    whole = (F.size(have) == F.size("shown")) & (F.size("shown") >= 2)
    steps = F.when(whole, _steps(F.col("shown")))
    return shown.select("item", F.size(have).alias("present"), F.size("shown").alias("n_frames"), edge.alias("edge"), F.when(whole, _sum(steps)).alias("px_disp"), F.array_max(steps).alias("max_step"), _median(F.transform(have, lambda b: b["h"])).alias("median_h"))


def presented_heights(items: DataFrame, boxes: DataFrame, scale: float = 1.0, name_pattern: str = r"^.*_t([0-9]+)_f([0-9]+)$") -> DataFrame:
    """(item, heights, reason) of items that also have image_ids: heights of exactly the four presented boxes, or why there are none."""
    j = items.join(presented(items, boxes, scale), "item", "left")
    f = F.col("frames")
    ordered = F.coalesce((F.size(f) == 4) & (F.size("image_ids") == 4) & (f == F.array_sort(F.array_distinct(f))), F.lit(False))
    named = F.forall(F.zip_with("image_ids", f, lambda n, k: F.struct(n.alias("n"), k.alias("k"))), lambda s: F.coalesce((F.regexp_extract(s["n"], name_pattern, 1) == F.col("track").cast("string")) & (F.regexp_extract(s["n"], name_pattern, 2) == s["k"].cast("string")), F.lit(False)))
    there = F.forall("shown", lambda b: b.isNotNull())
    positive = F.forall("shown", lambda b: ~F.isnan(b["h"]) & (b["h"] > 0))
    reason = F.when(~ordered, "frames").when((f[0] != F.col("f0")) | (f[3] != F.col("f1")), "window").when(~F.coalesce(named, F.lit(False)), "names").when(~F.coalesce(there, F.lit(False)), "missing").when(~positive, "height")
    return j.select("item", F.when(reason.isNull(), F.transform("shown", lambda b: b["h"])).alias("heights"), reason.alias("reason"))


def sparse_oracle(items: DataFrame, boxes: DataFrame, balls: DataFrame) -> DataFrame:
    """(item, answer): what the presented boxes alone say; null if one is missing. ``items`` also has category, question, dur and, for pairs,
    track_b; ``balls``: (seq, frame, bx, by). The metre ruler is
    the height that the question names; without one there is no number. Accelerations compare the last step with the first one, pairs use their own rulers."""
    j = items.join(presented(items, boxes), "item").withColumn("_last", F.element_at("frames", -1)).join(balls.select("seq", F.col("frame").alias("_last"), "bx", "by"), ["seq", "_last"], "left")
    j = j.join(presented(items.where("track_b is not null"), boxes, track="track_b").withColumnRenamed("shown", "_b"), "item", "left")
    whole = F.forall("shown", lambda b: b.isNotNull())
    steps = _steps(F.col("shown"))
    height = F.regexp_extract("question", texts.NAMED_HEIGHT, 1).try_cast("double")
    path, ruler = _sum(steps), F.when(height > 0, height) / _median(F.transform("shown", lambda b: b["h"]))
    last = F.element_at("shown", -1)
    gap = F.sqrt(F.pow(last["x"] + last["w"] / 2 - F.col("bx"), 2) + F.pow(last["y"] + last["h"] - F.col("by"), 2)) * ruler
    speed = path * ruler / F.col("dur")
    up = (F.element_at(steps, -1) > F.element_at(steps, 1)) == F.contains("question", F.lit("(A) speeding up"))
    c = F.col("category")
    number = F.when(c.startswith("dynamics_speed"), speed).when(c.startswith("dynamics_path"), path * ruler).when(c.startswith("dynamics_time") & (speed > 0), gap / F.when(speed > 0, speed))
    own = path / _median(F.transform("shown", lambda b: b["h"]))
    other = F.when(F.forall("_b", lambda b: b.isNotNull()), _sum(_steps(F.col("_b"))) / _median(F.transform("_b", lambda b: b["h"])))
    faster = F.when(other.isNotNull(), F.when(own > other, "A").otherwise("B"))
    letter = F.when(c.endswith("_faster"), faster).when(F.contains(c, F.lit("_accel")), F.when(up, "A").otherwise("B"))
    return j.select("item", F.when(whole, F.coalesce(F.when(number.isNotNull(), fn.one_decimal(number)), letter)).alias("answer"))


def crowd_signature(items: DataFrame, overlaps: DataFrame, paths: DataFrame) -> DataFrame:
    """(item, seq, crowded, px, flagged): presented frames with a large overlap (``overlaps``: seq, track, frame, max_iou), the path in rendered
    pixels (``paths``: item, px), and whether much overlap meets little movement."""
    at = items.select("item", "seq", "track", F.explode("frames").alias("frame")).join(overlaps, ["seq", "track", "frame"], "left")
    g = at.groupBy("item", "seq").agg(F.count_if(F.col("max_iou") >= CROWD_IOU).alias("crowded")).join(paths.select("item", "px"), "item", "left")
    return g.withColumn("flagged", (F.col("crowded") >= CROWD_FRAMES) & F.coalesce(F.col("px") < CROWD_PX, F.lit(False)))


def robustness(rows: DataFrame, flagged: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, n, n_clean, rho, rho_clean, delta): rank correlation of answers with and without the flagged items."""
    clean = rows.join(flagged.where("flagged").select("item"), "item", "left_anti")
    a, b = spearman(rows, cell, "prediction", "reference_value"), spearman(clean, cell, "prediction", "reference_value")
    j = a.join(b.select(*cell, F.col("n").alias("n_clean"), F.col("rho").alias("rho_clean")), cell, "left")
    return j.withColumn("delta", F.col("rho_clean") - F.col("rho"))


def qc_rates(verdicts: DataFrame, questions: list[str]) -> DataFrame:
    """(question, passed, failed, rate, lo, hi) of three-valued verdicts, not judged ones (null) left out; ``all`` counts the items that are judged
    in full. Percent, with Wilson intervals of z = 1.96."""
    judged, clean = F.lit(True), F.lit(True)
    for q in questions:
        judged, clean = judged & F.col(q).isNotNull(), clean & F.coalesce(F.col(q), F.lit(False))
    pairs = [(q, F.count_if(F.col(q)), F.count_if(~F.col(q))) for q in questions] + [("all", F.count_if(judged & clean), F.count_if(judged & ~clean))]
    g = verdicts.agg(F.array(*(F.struct(F.lit(n).alias("question"), p.alias("passed"), f.alias("failed")) for n, p, f in pairs)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    n = F.col("passed") + F.col("failed")
    lo, hi = fn.wilson(F.col("passed"), n, 1.96)
    return g.select("question", "passed", "failed", (100 * F.try_divide("passed", n)).alias("rate"), (100 * lo).alias("lo"), (100 * hi).alias("hi"))


def px_world_rho(rows: DataFrame, camera: list[str], model: list[str]) -> DataFrame:
    """(camera, model, n, rho, px_world): a model's rank correlation with the world's motion beside that of the pixels' motion in the same camera.

    ``rows``: (camera, model, item, prediction, world, px); pixels are counted once an item."""
    once = rows.groupBy(*camera, "item").agg(F.max("px").alias("px"), F.max("world").alias("world"))
    base = spearman(once, camera, "px", "world").select(*camera, F.col("rho").alias("px_world"))
    return spearman(rows, [*camera, *model], "prediction", "world").join(base, camera)


def assigned_distance(cost: np.ndarray) -> np.ndarray:
    """Distances of the one-to-one assignment of least total cost (rows to columns, the smaller side whole)."""
    if cost.shape[0] > cost.shape[1]:
        return assigned_distance(cost.T)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], column = row, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[column] = True
            now = cost[match[column] - 1] - u[match[column]] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], column
            free = np.flatnonzero(~used[1:]) + 1
            nxt = int(free[np.argmin(least[free])])
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            column = nxt
            if match[column] == 0:
                break
        while column:
            match[column], column = match[way[column]], way[column]
    return np.array([cost[match[c] - 1, c - 1] for c in range(1, m + 1) if match[c]])


def view_positions(players: DataFrame, clips: DataFrame, maps: DataFrame, views: DataFrame, step: float = 0.5) -> DataFrame:
    """(pair, view, t, track, x, y): where the players of two clips of one event stand at the same instants, ``step`` seconds apart until a second
    before a clip's end: the foot of the box in frame round(t fps) + 1 (half to even), in court metres. ``players``: boxes of players; ``views``:
    (seq, pair, view). The instants of a clip are made from its length and meet the boxes by frame."""
    last = F.floor((F.col("length") / F.col("fps") - 1) / step + 1e-9).cast("int")
    at = clips.join(views, "seq").where(last >= 1).select("seq", "pair", "view", "fps", F.explode(F.sequence(F.lit(1), last)).alias("_i")).withColumn("t", F.col("_i") * F.lit(step))
    at = at.select("seq", "pair", "view", "t", (F.rint(F.col("t") * F.col("fps")) + 1).cast("int").alias("frame"))
    feet = foot_points(players).join(at, ["seq", "frame"])
    return to_court(feet, maps, "fx", "fy").select("pair", "view", "t", "track", F.col("cx").alias("x"), F.col("cy").alias("y"))


def cross_view(positions: DataFrame, view: str, views: tuple[str, str], rotate: tuple[float, float] | None = None) -> DataFrame:
    """(pair, t, n_a, n_b, ax, ay, bx, by, matched): the same instant in two views: how many players, their centroids and the median
    distance of the best one-to-one assignment. ``positions``: (pair, view, t, x, y) in court metres; ``rotate``: sides of a
    court by which the second view is turned half round. One small task an instant."""
    b = F.col(view) == views[1]
    p = positions
    if rotate:
        p = p.withColumns({"x": F.when(b, rotate[0] - F.col("x")).otherwise(F.col("x")), "y": F.when(b, rotate[1] - F.col("y")).otherwise(F.col("y"))})

    def match(part: pd.DataFrame) -> pd.DataFrame:
        one, two = (part[part[view] == v][["x", "y"]].to_numpy(float) for v in views)
        if not len(one) or not len(two):
            return pd.DataFrame(columns=["pair", "t", "n_a", "n_b", "ax", "ay", "bx", "by", "matched"])
        d = assigned_distance(np.linalg.norm(one[:, None] - two[None], axis=-1))
        return pd.DataFrame([(part.pair.iloc[0], part.t.iloc[0], len(one), len(two), *one.mean(0), *two.mean(0), float(np.median(d)))], columns=["pair", "t", "n_a", "n_b", "ax", "ay", "bx", "by", "matched"])

    return p.groupBy("pair", "t").applyInPandas(match, "pair string, t double, n_a long, n_b long, ax double, ay double, bx double, by double, matched double")


def alignment(instants: DataFrame) -> DataFrame:
    """(pair, n, pearson_x, pearson_y, centroid_distance, matched): of ``cross_view``: correlations of the centroids, their median distance,
    and the median of the matched distances; a correlation is null if a side is constant."""
    pearson = lambda a, b: F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.covar_pop(a, b) / F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.stddev_pop(a) * F.stddev_pop(b)))
    apart = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2))
    g = instants.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), pearson("ax", "bx").alias("pearson_x"), pearson("ay", "by").alias("pearson_y"))
    return g.join(quantiles(instants, ["pair"], {"centroid_distance": (apart, middle()), "matched": ("matched", middle())}), "pair", "left")
