"""Question items from trajectory metrics, their paired twins, controlled arms and hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import answers as fn
from ..functions import texts
from ..functions.answers import one_decimal
from ..sources.shared import settled

#: Accepted ranges of the numeric families: category, metric, unit word, lowest, highest.
RANGES = {"speed": (0.4, 9.0), "path": (0.8, 30.0), "time": (0.4, 8.0)}
ACCEL_RATIO = 1.35
FASTER_RATIO = 1.4


def numeric_items(metrics: DataFrame, intercepts: DataFrame) -> DataFrame:
    """(category, seq, track, window_index, value, answer, reason): one row per player window and numeric family; ``answer``
    is null where the item is dropped, ``reason`` says why (unstable, range or missing)."""
    full = metrics.where("part = 'full'")
    keys = ["seq", "track", "window_index"]
    values = full.select(*keys, "stable", F.explode(F.array(F.struct(F.lit("speed").alias("category"), F.col("speed").alias("value")), F.struct(F.lit("path").alias("category"), F.col("path_m").alias("value")))).alias("i"))
    values = values.select(*keys, "stable", "i.category", "i.value")
    timed = intercepts.select(*keys, F.lit(True).alias("stable"), F.lit("time").alias("category"), F.col("seconds").alias("value"))
    every = values.unionByName(timed)
    inside = F.lit(False)
    for category, (low, high) in RANGES.items():
        inside = inside | ((F.col("category") == category) & F.col("value").between(low, high))
    reason = F.when(~F.col("stable"), "unstable").when(F.col("value").isNull(), "missing").when(~inside, "range")
    return every.select("category", *keys, "value", F.when(reason.isNull(), one_decimal(F.col("value"))).alias("answer"), reason.alias("reason"))


def drop_counters(items: DataFrame) -> DataFrame:
    return items.groupBy("category", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def accel_swap(metrics: DataFrame) -> DataFrame:
    """(seq, track, window_index, pair_role, answer): full window stable, both halves moving, ratio of 1.35 or more; each with
    its option-swapped twin."""
    keys = ["seq", "track", "window_index"]
    wide = metrics.groupBy(*keys).agg(
        F.max(F.when(F.col("part") == "full", F.col("stable"))).alias("stable"), F.max(F.when(F.col("part") == "first", F.col("speed"))).alias("v1"), F.max(F.when(F.col("part") == "second", F.col("speed"))).alias("v2")
    )
    found = wide.where("stable and v1 > 0 and v2 > 0").where(F.greatest("v1", "v2") / F.least("v1", "v2") >= ACCEL_RATIO)
    up = F.col("v2") > F.col("v1")
    twins = F.array(F.struct(F.lit("orig").alias("role"), F.when(up, "A").otherwise("B").alias("answer")), F.struct(F.lit("twin").alias("role"), F.when(up, "B").otherwise("A").alias("answer")))
    return found.select(*keys, F.explode(twins).alias("t")).select(*keys, F.col("t.role").alias("pair_role"), "t.answer")


def faster_pairs(metrics: DataFrame) -> DataFrame:
    """(seq, a, b, k, win_window, loss_window): for players a < b the k-th window that a wins clearly with the k-th it loses."""
    low, high = RANGES["speed"]
    v = metrics.where("part = 'full'").where(F.col("speed").between(low, high)).select("seq", "window_index", "track", "speed")
    a, b = v.select("seq", "window_index", F.col("track").alias("a"), F.col("speed").alias("va")), v.select("seq", "window_index", F.col("track").alias("b"), F.col("speed").alias("vb"))
    both = a.join(b, ["seq", "window_index"]).where("a < b").withColumn("r", F.col("va") / F.col("vb"))
    clear = both.where((F.col("r") >= FASTER_RATIO) | (F.col("r") <= 1 / FASTER_RATIO)).withColumn("win", F.col("r") >= FASTER_RATIO)
    ranked = clear.withColumn("k", F.row_number().over(Window.partitionBy("seq", "a", "b", "win").orderBy("window_index")))
    return ranked.groupBy("seq", "a", "b", "k").agg(F.max(F.when(F.col("win"), F.col("window_index"))).alias("win_window"), F.max(F.when(~F.col("win"), F.col("window_index"))).alias("loss_window")).where(
        "win_window is not null and loss_window is not null"
    )


def hash_order(seed: str, *keys: str) -> Column:
    """A reproducible order instead of a seeded shuffle."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def cap_per_group(items: DataFrame, group: list[str], order: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each group, in hash order."""
    return items.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_o"))).where(F.col("_r") <= most).drop("_o", "_r")


def cap_families(items: DataFrame, group: list[str], keys: list[str], most: int, seed: str = "cap") -> DataFrame:
    """At most ``most`` items of each group (clip and category), in hash order; items with a pair_id stay or go as whole pairs, of
    which half as many, but one at least, are kept."""
    single = cap_per_group(items.where("pair_id is null"), group, hash_order(seed, *keys), most)
    pairs = items.where("pair_id is not null").select(*group, "pair_id").distinct()
    kept = cap_per_group(pairs, group, hash_order(seed, *group, "pair_id"), max(1, most // 2))
    return single.unionByName(items.where("pair_id is not null").join(kept, [*group, "pair_id"], "left_semi").select(*single.columns))


#: Columns of a pool of questions.
ROWS = ["category", "seq", "track", "window_index", "pair_id", "pair_role", "question", "answer", "f0", "f1", "frames", "image_ids", "highlight"]


def _rows(df: DataFrame, windows: DataFrame, pair_id: Column, role: Column, colors: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` (category, seq, track, window_index, question without its lead, answer) as rows of a pool."""
    j = df.join(windows.select("seq", "window_index", "f0", "f1", "frames", "dur"), ["seq", "window_index"])
    image = lambda f: F.concat_ws("_", "seq", F.concat(F.lit("w"), F.col("window_index").cast("string")), F.concat(F.lit("t"), F.col("track").cast("string")), F.concat(F.lit("f"), f.cast("string")))
    marks = F.array(*(F.struct(F.col(c).cast("int").alias("track"), F.lit(color).alias("color"), F.lit(shape).alias("shape")) for c, color, shape in colors))
    j = j.withColumns({"pair_id": pair_id, "pair_role": role, "image_ids": F.transform("frames", image), "highlight": F.filter(marks, lambda m: m["track"].isNotNull())})
    return j.select(*ROWS)


def numeric_rows(items: DataFrame, windows: DataFrame, balls: DataFrame, height_m: float = 1.93) -> DataFrame:
    """Numeric items as rows of a pool; a time item also marks the ball. ``balls``: (seq, ball)."""
    kept = items.where("answer is not null").join(windows.select("seq", "window_index", "dur"), ["seq", "window_index"]).join(balls, "seq", "left")
    name = F.when(F.col("category") == "speed", texts.CATEGORIES["speed"]).when(F.col("category") == "path", texts.CATEGORIES["path"]).otherwise(texts.CATEGORIES["time"])
    ball = F.when(F.col("category") == "time", F.col("ball"))
    kept = kept.select(name.alias("category"), "seq", "track", "window_index", texts.numeric_question(F.col("category"), F.col("dur"), height_m=height_m).alias("question"), "answer", ball.alias("ball"))
    none = F.lit(None).cast("string")
    return _rows(kept, windows, none, none, [("track", "red", "box"), ("ball", "yellow", "circle")])


def _letters(df: DataFrame, windows: DataFrame, category: str, ask: Column) -> DataFrame:
    j = df.join(windows.select("seq", "window_index", "dur"), ["seq", "window_index"])
    return j.withColumns({"category": F.lit(texts.CATEGORIES[category]), "question": texts.letter_question(ask, F.col("dur"))}).drop("dur")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def accel_rows(swap: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of ``accel_swap`` as rows: the twin's options are swapped."""
    ask = F.when(F.col("pair_role") == "orig", texts.ASK["accel"]).otherwise(texts.ASK["accel_swapped"])
    pair = F.concat(F.lit("acc_w"), F.lpad(F.col("window_index").cast("string"), 3, "0"), F.lit("_t"), F.col("track").cast("string"))
    return _rows(_letters(swap, windows, "accel", ask), windows, pair, F.col("pair_role"), [("track", "red", "box")])


def faster_rows(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of ``faster_pairs`` as rows: the same text on two windows."""
    side = lambda role, w, letter: F.struct(F.lit(role).alias("pair_role"), F.col(w).alias("window_index"), F.lit(letter).alias("answer"))
    two = pairs.select("seq", F.col("a").alias("track"), "b", "k", F.explode(F.array(side("orig", "win_window", "A"), side("twin", "loss_window", "B"))).alias("s")).select("seq", "track", "b", "k", "s.*")
    pair = F.concat(F.lit("vis_t"), F.col("track").cast("string"), F.lit("_"), F.col("b").cast("string"), F.lit("_"), _two(F.col("k") - 1))
    return _rows(_letters(two, windows, "faster", F.lit(texts.ASK["faster"])), windows, pair, F.col("pair_role"), [("track", "red", "box"), ("b", "blue", "box")])


def accel_visual_rows(pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """Pairs of ``accel_visual`` (seq, track, up, down, k) as rows: the same text on two disjoint windows."""
    side = lambda role, w, letter: F.struct(F.lit(role).alias("pair_role"), F.col(w).alias("window_index"), F.lit(letter).alias("answer"))
    two = pairs.select("seq", "track", "k", F.explode(F.array(side("orig", "up", "A"), side("twin", "down", "B"))).alias("s")).select("seq", "track", "k", "s.*")
    pair = F.concat(F.lit("accvis_t"), F.col("track").cast("string"), F.lit("_"), _two(F.col("k")))
    return _rows(_letters(two, windows, "accel_vis", F.lit(texts.ASK["accel"])), windows, pair, F.col("pair_role"), [("track", "red", "box")])


def recompute_answers(rows: DataFrame, parts: DataFrame, balls: DataFrame) -> DataFrame:
    """Rows of a pool with the answer in another ruler (``new_answer``, null if undefined) and what it rests on (``detail``: metres, metres a
    second or seconds; the ratio of speeds for letters). Letters follow the order of the options in the question.

    ``parts``: of ``court_parts``; ``balls``: of ``time_to_ball_court``."""
    keys = ["seq", "track", "window_index"]
    speed = lambda p: F.max(F.when(F.col("part") == p, F.col("speed")))
    wide = parts.groupBy(*keys).agg(speed("full").alias("v"), speed("first").alias("v1"), speed("second").alias("v2"), F.max(F.when(F.col("part") == "full", F.col("path_m"))).alias("d"))
    other = wide.select("seq", F.col("track").alias("_b"), "window_index", F.col("v").alias("vb"))
    j = rows.join(wide, keys, "left").withColumn("_b", F.when(F.col("category") == texts.CATEGORIES["faster"], F.get("highlight", F.lit(1))["track"])).join(other, ["seq", "_b", "window_index"], "left")
    j = j.join(balls.select(*keys, F.col("seconds").alias("t")), keys, "left")
    c = lambda name: F.col("category") == texts.CATEGORIES[name]
    accel = c("accel") | c("accel_vis")
    first = F.contains("question", F.lit("(A) speeding up"))
    up = F.when(F.col("v1").isNotNull() & F.col("v2").isNotNull(), F.when((F.col("v2") > F.col("v1")) == first, "A").otherwise("B"))
    faster = F.when(F.col("v").isNotNull() & F.col("vb").isNotNull(), F.when(F.col("v") > F.col("vb"), "A").otherwise("B"))
    ratio = lambda a, b: F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1e-9))
    number = F.when(c("speed"), F.col("v")).when(c("path"), F.col("d")).when(c("time"), F.col("t"))
    detail = F.coalesce(number, F.when(accel & up.isNotNull(), ratio("v1", "v2")), F.when(c("faster") & faster.isNotNull(), ratio("v", "vb")))
    return j.select(*rows.columns, F.coalesce(F.when(number.isNotNull(), one_decimal(number)), F.when(accel, up), F.when(c("faster"), faster)).alias("new_answer"), detail.alias("detail"))


def half_cuts(hashed: DataFrame, stratum: list[str], h: str, digits: int = 4) -> DataFrame:
    """(stratum, _cut): the hash up to which the lower half of a stratum goes; none if it has one item. ``h``: hashes as hexadecimal text.

    Items are counted by the first digits of their hash. Sums of these counts, which are 16**digits rows a stratum at most, say in which
    bucket the middle lies, and only the items of that bucket are ranked: no stratum is sorted in one task."""
    counts = hashed.groupBy(*stratum, F.substring(h, 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*stratum)
    upto = F.sum("_c").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    edge = counts.withColumns({"_upto": upto, "_half": F.floor(F.sum("_c").over(by) / 2)})
    edge = edge.where((F.col("_upto") - F.col("_c") < F.col("_half")) & (F.col("_half") <= F.col("_upto")))
    edge = edge.select(*(F.col(c).alias(f"_{c}") for c in stratum), F.col("_b").alias("_edge"), (F.col("_half") - F.col("_upto") + F.col("_c")).alias("_place"))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in stratum]
    near = hashed.select(*stratum, F.col(h).alias("_cut")).join(edge, [*match, F.substring("_cut", 1, digits) == F.col("_edge")])
    ranked = near.withColumn("_r", F.row_number().over(Window.partitionBy(*stratum).orderBy("_cut")))
    return ranked.where("_r = _place").select(*stratum, "_cut")


def mixed_units(items: DataFrame, stratum: list[str], keys: list[str], answer: str = "answer", fine: str | None = None) -> DataFrame:
    """``items`` with unit and answer: the half of each stratum with the lowest hash is asked in cm, its answer times 100
    in exact decimals. An odd item of a stratum stays in metres (see ``odd_strata``). ``fine`` names the unrounded value from
    which cm speeds are rounded instead."""
    hashed = settled(items.withColumn("_h", hash_order("mixed", *keys)))
    cut = half_cuts(hashed, stratum, "_h").select(*(F.col(c).alias(f"_at_{c}") for c in stratum), "_cut")
    ranked = hashed.join(cut, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in stratum], "left").drop(*(f"_at_{c}" for c in stratum))
    cm = F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))
    value = (F.col(answer).cast("decimal(20,4)") * 100).cast("decimal(20,1)").cast("string")
    if fine:
        value = F.when(F.col("category") == "speed", one_decimal(F.bround(F.col(fine) * 100))).otherwise(value)
    return ranked.withColumn("_cm", cm).withColumn("unit", F.when(F.col("_cm"), "cm").otherwise("m")).withColumn(answer, F.when(F.col("_cm"), value).otherwise(F.col(answer))).drop("_h", "_cut", "_cm")


def odd_strata(items: DataFrame, stratum: list[str]) -> DataFrame:
    """(stratum, n): strata that can't be cut into halves; a pool with any is to be refused."""
    return items.groupBy(*stratum).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")


#: unit, factor from metres
ARMS = (("m", 1.0), ("cm", 100.0), ("px", 27.0))
TOLERANCE = {"speed": (0.3, 1.0), "path": (0.5, 2.0)}


def control_arms(items: DataFrame, dur: float = 2.0) -> DataFrame:
    """Each speed and path item in three units, with and without the height sentence: question, tolerance, floor and
    reference go with the unit."""
    arms = F.array(*(F.struct(F.lit(u).alias("unit"), F.lit(f).alias("factor"), F.lit(h).alias("prior")) for u, f in ARMS for h in ("height", "noheight")))
    out = items.where("category in ('speed', 'path') and answer is not null").withColumn("arm", F.explode(arms))
    tol = F.when(F.col("category") == "speed", TOLERANCE["speed"][0]).otherwise(TOLERANCE["path"][0])
    floor = F.when(F.col("category") == "speed", TOLERANCE["speed"][1]).otherwise(TOLERANCE["path"][1])
    f = F.col("arm.factor")
    return out.select(
        "category", "seq", "track", "window_index", F.concat_ws("_", "arm.unit", "arm.prior").alias("arm"), "arm.unit", (tol * f).alias("score_tolerance"), (floor * f).alias("score_floor"),
        (F.col("value") * f).alias("reference_value"), one_decimal(F.col("value") * f).alias("answer"),
        texts.arm_question(F.col("category"), F.col("arm.unit"), F.col("arm.prior") == "height", F.lit(dur)).alias("question"),
    )


def soccer_arms(windows: DataFrame, scale: DataFrame, dur: float = 2.0, span: int = 50) -> DataFrame:
    """Speed and path items of dense windows (seq, track, t, path_m, path_px) in metres, centimetres and rendered pixels; tolerances and
    floors go with the unit, for pixels with the clip's pixels per metre ``k`` of ``scale``."""
    arms = F.array(*(F.struct(F.lit(f"{u}_height").alias("arm"), F.lit(u).alias("unit"), F.lit(f).alias("family")) for u in ("m", "cm", "px") for f in TOLERANCE))
    j = windows.join(scale.select("seq", "k"), "seq").withColumn("a", F.explode(arms)).select("*", "a.*")
    speed = F.col("family") == "speed"
    whole = F.when(F.col("unit") == "m", F.col("path_m")).when(F.col("unit") == "cm", F.col("path_m") * 100).otherwise(F.col("path_px"))
    value, factor = whole / F.when(speed, dur).otherwise(1.0), F.when(F.col("unit") == "m", 1.0).when(F.col("unit") == "cm", 100.0).otherwise(F.col("k"))
    t, e = (F.when(speed, TOLERANCE["speed"][i]).otherwise(TOLERANCE["path"][i]) for i in (0, 1))
    name = F.when(speed, texts.CATEGORIES["speed"]).otherwise(texts.CATEGORIES["path"])
    return j.select(name.alias("category"), "seq", "track", "t", F.array("t", F.col("t") + span).alias("window"), "arm", "unit", one_decimal(value).alias("answer"), value.alias("reference_value"), F.round(t * factor, 6).alias("score_tolerance"), F.round(e * factor, 6).alias("score_floor"))


def arm_invariants(arms: DataFrame, height_m: float = 1.93) -> DataFrame:
    """(rule, violations) of controlled arms: a rounded reference scores 100, texts differ only in the unit's word, or only in
    the prior sentence, and a score doesn't change with the unit of everything in it (metres against centimetres)."""
    score = lambda p: fn.tmra_scaled(p, F.col("reference_value"), F.col("score_tolerance"), F.col("score_floor"))
    wrong = arms.where(score(F.col("answer").cast("double")) != 100).agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit("reference"))
    item = ["category", "seq", "track", "window_index"]
    words = "|".join(texts.UNIT_WORDS.values())
    a = arms.withColumns({"prior": F.split_part("arm", F.lit("_"), F.lit(2)), "q": F.regexp_replace("question", f" in ({words})", " in [UNIT]"), "n": F.replace("question", F.lit(texts.PRIOR.format(height_m)), F.lit(""))})
    unit = a.groupBy(*item, "prior").agg(F.count_distinct("q").alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit("unit_text"))
    prior = a.groupBy(*item, "unit").agg(F.count_distinct("n").alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit("prior_text"))
    scaled = arms.where("unit in ('m', 'cm')").select(*item, "arm", F.explode(F.array(*(score(F.lit(k) * F.col("reference_value")) for k in (0.0, 0.7, 1.0, 1.5)))).alias("s"))
    moved = scaled.groupBy(*item).agg(F.sum(F.when(F.startswith("arm", F.lit("m_")), F.col("s")).otherwise(-F.col("s"))).alias("d")).where("abs(d) > 1e-9").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit("scale"))
    return wrong.unionByName(unit).unionByName(prior).unionByName(moved).select("rule", "violations")
