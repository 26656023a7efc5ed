"""Controlled variants of question pools: priors, frames, images and samples. Seeded shuffles are hash orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .generate import hash_order
from .pools import lowest
from ..functions import texts
from ..functions.answers import one_decimal

def with_question(items: DataFrame, windows: DataFrame, height_m: float = 1.93) -> DataFrame:
    """Numeric items (category: speed, path or time) with their question; ``windows``: (seq, window_index, dur, ...)."""
    j = items.join(windows.select("seq", "window_index", "dur"), ["seq", "window_index"])
    return j.withColumn("question", texts.numeric_question(F.col("category"), F.col("dur"), height_m=height_m)).select(*items.columns, "question")


def rescale_prior(items: DataFrame, old: float = 1.93, new: float = 1.45) -> DataFrame:
    """Items whose question states the prior, asked with another height: speed and path answers scale from the rounded
    answer, times don't."""
    said = f"{old:.2f} m tall"
    scaled = one_decimal(F.col("answer").cast("double") * new / old)
    kept = items.where(F.contains("question", F.lit(said))).withColumn("original", F.col("answer"))
    invariant = F.col("category") == "time"
    return kept.withColumns({"answer": F.when(invariant, F.col("answer")).otherwise(scaled), "effect": F.when(invariant, "invariant").otherwise("rescaled"), "question": F.replace("question", F.lit(said), F.lit(f"{new:.2f} m tall"))})


def strip_prior(items: DataFrame) -> DataFrame:
    """Numeric items without the prior sentence, blanks squeezed, and how often it was there."""
    found = F.regexp_count("question", F.lit(texts.ANY_PRIOR))
    squeezed = F.trim(F.regexp_replace(F.regexp_replace("question", texts.ANY_PRIOR, " "), r"\s{2,}", " "))
    return items.withColumn("removed", found).withColumn("question", squeezed)


def ruler_variant(items: DataFrame, court: DataFrame, scale: DataFrame) -> DataFrame:
    """Speed and path items that state the clip's pixels per metre instead of a height, answered on the court: the answers of both
    conventions are kept. Clips whose scale isn't even enough (``ok``) and items without a court answer are left out.

    ``court``: (seq, track, window_index, path_m, speed); ``scale``: (seq, k, ok)."""
    j = items.where("category in ('speed', 'path')").join(court, ["seq", "track", "window_index"]).join(scale.where("ok").select("seq", "k"), "seq")
    answer = one_decimal(F.when(F.col("category") == "speed", F.col("speed")).otherwise(F.col("path_m")))
    sentence = F.concat(F.lit(texts.RULER[0]), F.bround("k").cast("long").cast("string"), F.lit(texts.RULER[1]))
    at = F.regexp_replace("question", texts.ANY_PRIOR, " \u0001")
    return j.withColumns({"v1_answer": F.col("answer"), "answer": answer, "question": F.replace(at, F.lit("\u0001"), sentence), "ruler_px_per_m": F.round("k", 3)}).select(*items.columns, "v1_answer", "ruler_px_per_m")


def pixel_variant(items: DataFrame, pixels: DataFrame) -> DataFrame:
    """Speed and path items asked and answered in pixels, without a prior. ``pixels``: (seq, track, window_index, path_px, speed_px)."""
    j = items.where("category in ('speed', 'path')").join(pixels, ["seq", "track", "window_index"])
    answer = one_decimal(F.when(F.col("category") == "speed", F.col("speed_px")).otherwise(F.col("path_px")))
    q = F.regexp_replace("question", texts.ANY_PRIOR, " ")
    for family in ("speed", "path"):
        q = F.replace(q, F.lit(texts.ASK[family]), F.lit(texts.PIXEL_ASK[family]))
    return j.withColumns({"m_answer": F.col("answer"), "answer": answer, "question": q}).select(*items.columns, "m_answer")


def in_template(arms: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Metre and centimetre rows of the controlled arms with the training wording of the same item; rows whose frames differ
    aren't joined."""
    j = arms.where("unit in ('m', 'cm')").drop("question").join(items.select(*keys, "frames", "question"), [*keys, "frames"])
    cm = F.replace(F.replace("question", F.lit("in meters per second?"), F.lit("in centimeters per second?")), F.lit("in meters?"), F.lit("in centimeters?"))
    return j.withColumn("question", F.when(F.col("unit") == "cm", cm).otherwise(F.col("question"))).withColumn("arm", F.concat(F.lit("legacy_"), F.col("unit")))


def relabel_pool(items: DataFrame, court: DataFrame, groups: DataFrame, held_out: DataFrame) -> DataFrame:
    """The same rows with court answers: the old answer is kept, items without a court answer or of a held-out event go.

    ``court``: (category, seq, track, window_index, answer); ``groups``: (seq, event); ``held_out``: (event)."""
    clean = items.join(groups, "seq").join(held_out, "event", "left_anti").drop("event")
    new = court.select("category", "seq", "track", "window_index", F.col("answer").alias("_new"))
    j = clean.join(new.where("_new is not null"), ["category", "seq", "track", "window_index"])
    return j.withColumns({"v1_answer": F.col("answer"), "answer": F.col("_new"), "label_convention": F.lit("court")}).select(*items.columns, "v1_answer", "label_convention")


def chat_records(items: DataFrame, present: DataFrame) -> DataFrame:
    """(item, messages): a user turn with the frames and the question, then the answer; items with a missing frame or an empty text
    are left out. ``present``: (image) of the frames that exist."""
    have = items.select("item", F.explode("image_ids").alias("image")).join(present.withColumn("_ok", F.lit(True)), "image", "left")
    whole = have.groupBy("item").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_ok")).where("_ok").select("item")
    ok = (F.length(F.trim("question")) > 0) & (F.length(F.trim("answer")) > 0)
    turn = lambda role, text, images: F.struct(F.lit(role).alias("role"), text.alias("text"), images.alias("images"))
    none = F.array().cast("array<string>")
    return items.where(ok).join(whole, "item", "left_semi").select("item", F.array(turn("user", F.col("question"), F.col("image_ids")), turn("assistant", F.col("answer"), none)).alias("messages"))


def frame_mode(frames: Column, key: Column, mode: str) -> Column:
    """full, single (first), static4 (the first as often as there are frames) or shuffle (a hash order of the places that is never the original)."""
    n = F.size(frames)
    if mode == "single":
        return F.slice(frames, 1, 1)
    if mode == "static4":
        return F.transform(frames, lambda x: F.element_at(frames, 1))
    if mode == "shuffle":
        keyed = F.transform(frames, lambda x, i: F.struct(F.sha2(F.concat_ws("|", key.cast("string"), i.cast("string")), 256).alias("k"), x.alias("x")))
        mixed = F.transform(F.array_sort(keyed), lambda s: s["x"])
        return F.when((mixed == frames) & (n > 1), F.reverse(frames)).otherwise(mixed)
    return frames


def cross_image_map(items: DataFrame, image: str, seed: str = "cross") -> DataFrame:
    """(image, other): a derangement of the distinct images: hash order, each followed by the next, the last by the first.

    The hash order is cut into 256 buckets; only a bucket's ends meet other buckets."""
    ranked = items.select(image).distinct().withColumn("_o", hash_order(seed, image)).withColumn("_b", F.substring("_o", 1, 2))
    own = ranked.withColumn("other", F.lead(image).over(Window.partitionBy("_b").orderBy("_o")))
    firsts = ranked.groupBy("_b").agg(F.min_by(image, "_o").alias("_first"))
    heads = firsts.agg(F.array_sort(F.collect_list(F.struct("_b", "_first"))).alias("_all"))
    after = F.expr("coalesce(get(filter(_all, x -> x._b > _b), 0), _all[0])._first")
    return own.join(F.broadcast(heads)).select(image, F.coalesce("other", after).alias("other"))


def quota_sample(items: DataFrame, stratum: list[str], keys: list[str], n: int, seed: str = "quota") -> DataFrame:
    """``n`` items in proportion to their strata: floors, then the largest remainders (ties by name), each in hash order."""
    sizes = items.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_c"))
    total = sizes.agg(F.sum("_c").alias("_t"))
    q = sizes.join(total).withColumn("_share", F.col("_c") * n / F.col("_t")).withColumn("_q", F.floor("_share"))
    # one row a stratum from here on
    left = F.lit(n) - F.sum("_q").over(Window.partitionBy())
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("_share") - F.col("_q")).desc(), *stratum))
    q = q.withColumn("_left", left).withColumn("_r", order).select(*stratum, (F.col("_q") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("_q"))
    return lowest(items, stratum, [hash_order(seed, *keys)], q, "_q")
