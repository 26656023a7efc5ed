"""Frame contracts: each rule is a column, each audit a small table of violations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two research tracks, what their answers come from, and the schema's version.
CALIBRATION, ANNOTATION = "synloc_calibration_only", "gsr_annotation_backed"
SOURCES = {CALIBRATION: "calibration_geometry", ANNOTATION: "bbox_pitch_annotation"}
VERSION = "soccer-spatial-frame-v1"
#: Keys that metadata of the calibration track must not have at any depth, whatever their case.
FORBIDDEN = ("annotations", "position_on_pitch", "bbox_pitch", "bbox_pitch_raw", "keypoints_3d", "world_position", "pitch_xy")
#: Plausible sides of a pitch, its axes, and how far beyond it a position may lie.
LENGTHS, WIDTHS, AXES, BEYOND = (90.0, 120.0), (45.0, 90.0), "x_goal_to_goal_y_sideline_z_up", 3.0
SCHEMA = (
    "schema_version string, research_track string, dataset_id string, split string, scene_group_id string, frame_id string, image_path string, width int, height int, "
    "pitch struct<length_m:double,width_m:double,origin:string,axes:string>, "
    "calibration struct<model:string,intrinsic:array<array<double>>,rotation_world_to_camera:array<array<double>>,translation_world_to_camera:array<double>,distortion:array<double>,native_camera_matrix:array<array<double>>>, "
    "observations array<struct<entity_id:string,kind:string,bbox_xywh:array<double>,pitch_xy_m:array<double>,track_id:string>>, source_metadata string"
)
PROVENANCE = ("answer_source", "uses_target_qa_labels", "uses_entity_world_annotations", "uses_human_target_annotations", "external_test_only", "training_allowed")


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def _all_finite(rows: Column) -> Column:
    return F.forall(F.coalesce(F.flatten(rows), F.array().cast("array<double>")), _finite)


def _shape(m: Column, rows: int, cols: int) -> Column:
    return m.isNull() | ((F.size(m) == rows) & F.forall(m, lambda r: F.size(r) == cols))


def _rectangular(m: Column) -> Column:
    """Rows of one length, one at least."""
    return m.isNull() | ((F.size(m) > 0) & F.forall(m, lambda r: F.size(r) == F.size(F.get(m, F.lit(0)))))


def forbidden_key(metadata: Column) -> Column:
    """Whether a JSON text has a forbidden key at any depth: a quoted name before a colon."""
    return F.coalesce(metadata, F.lit("")).rlike(r'(?i)"(' + "|".join(FORBIDDEN) + r')"\s*:')


def frame_violations(frames: DataFrame) -> DataFrame:
    """(dataset_id, split, scene_group_id, frame_id, reason): the first rule that a frame breaks; sound frames are left out."""
    track, p, c = F.col("research_track"), F.col("pitch"), F.col("calibration")
    empty = F.lit(False)
    for name in ("dataset_id", "split", "scene_group_id", "frame_id", "image_path"):
        empty = empty | (F.length(F.trim(F.coalesce(name, F.lit("")))) == 0)
    number = lambda v, low, high: F.coalesce(v.between(low, high), F.lit(False))
    pitch = number(p["length_m"], *LENGTHS) & number(p["width_m"], *WIDTHS) & F.coalesce((p["origin"] == "center") & (p["axes"] == AXES), F.lit(False))
    has = lambda f: c[f].isNotNull()
    parts = F.when(c["model"] == "opencv_pinhole", has("intrinsic") & has("rotation_world_to_camera") & has("translation_world_to_camera")).when(c["model"] == "synloc_sskit", has("native_camera_matrix")).otherwise(F.lit(False))
    shapes = _shape(c["intrinsic"], 3, 3) & _shape(c["rotation_world_to_camera"], 3, 3) & _rectangular(c["native_camera_matrix"]) & (c["translation_world_to_camera"].isNull() | (F.size(c["translation_world_to_camera"]) == 3))
    none = F.array().cast("array<double>")
    finite = _all_finite(F.array(F.coalesce(c["distortion"], none), F.coalesce(c["translation_world_to_camera"], none)))
    for f in ("intrinsic", "rotation_world_to_camera", "native_camera_matrix"):
        finite = finite & _all_finite(c[f])
    seen = F.coalesce(F.size("observations") > 0, F.lit(False))
    obs = F.coalesce("observations", F.array().cast(frames.schema["observations"].dataType))
    box = F.forall(obs, lambda o: F.coalesce((F.size(o["bbox_xywh"]) == 4) & F.forall(o["bbox_xywh"], _finite) & (o["bbox_xywh"][2] > 0) & (o["bbox_xywh"][3] > 0), F.lit(False)))
    half = lambda side: p[side] / 2 + BEYOND
    inside = F.forall(obs, lambda o: F.coalesce((F.size(o["pitch_xy_m"]) == 2) & F.forall(o["pitch_xy_m"], _finite) & (F.abs(o["pitch_xy_m"][0]) <= half("length_m")) & (F.abs(o["pitch_xy_m"][1]) <= half("width_m")), F.lit(False)))
    calibration = track == CALIBRATION
    reason = (
        F.when(F.coalesce(F.col("schema_version") != VERSION, F.lit(True)), "version").when(~F.coalesce(track.isin(CALIBRATION, ANNOTATION), F.lit(False)), "track").when(empty, "empty")
        .when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "size").when(~pitch, "pitch").when(calibration & c.isNull(), "calibration").when(calibration & ~(parts & shapes), "matrices")
        .when(calibration & ~finite, "finite").when(calibration & seen, "observations").when(calibration & forbidden_key(F.col("source_metadata")), "forbidden").when(~calibration & ~seen, "unobserved")
        .when(~calibration & ~box, "box").when(~calibration & ~inside, "position")
    )
    return frames.select("dataset_id", "split", "scene_group_id", "frame_id", reason.alias("reason")).where("reason is not null")


def with_provenance(frames: DataFrame) -> DataFrame:
    """Frames with the columns that follow from their track: where answers come from and what the frame may be used for."""
    annotated = F.col("research_track") == ANNOTATION
    derived = {"answer_source": F.when(annotated, SOURCES[ANNOTATION]).otherwise(SOURCES[CALIBRATION]), "uses_target_qa_labels": F.lit(False), "uses_entity_world_annotations": annotated, "uses_human_target_annotations": annotated, "external_test_only": annotated, "training_allowed": ~annotated}
    return frames.withColumns(derived)


def provenance_mismatches(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, declared, derived): declared provenance that isn't what the track says; an undeclared (null) field passes."""
    named = frames.select(*keys, "research_track", *(F.col(f).cast("string").alias(f"_d_{f}") for f in PROVENANCE if f in frames.columns))
    both = with_provenance(named)
    found = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_d_{f}").alias("declared"), F.col(f).cast("string").alias("derived")) for f in PROVENANCE if f in frames.columns))
    return both.select(*keys, F.explode(found).alias("x")).select(*keys, "x.*").where("declared is not null and declared <> derived")


def frame_counts(frames: DataFrame) -> DataFrame:
    """(research_track, dataset_id, split, scene_group_id, n): frames of each scene; grouped further by the caller."""
    return frames.groupBy("research_track", "dataset_id", "split", "scene_group_id").agg(F.count(F.lit(1)).alias("n"))


def qa_violations(qa: DataFrame) -> DataFrame:
    """(qa_id, reason): the first rule a question breaks: its id, the provenance that its track asks for, axes, and letters."""
    track = F.col("research_track")
    flag = lambda f, v: F.coalesce(F.col(f) == F.lit(v), F.lit(False))
    own = lambda t, a: flag("answer_source", SOURCES[t]) & flag("uses_entity_world_annotations", a) & flag("uses_human_target_annotations", a) & flag("external_test_only", a) & flag("training_allowed", not a)
    signed = F.col("category").isin("localization_2d_pitch", "pitch_region_signed_marker")
    relational = F.startswith("category", F.lit("relational_reasoning"))
    counts = qa.groupBy("qa_id").agg(F.count(F.lit(1)).alias("_n"))
    reason = (
        F.when(F.length(F.coalesce("qa_id", F.lit(""))) == 0, "missing_id").when(F.col("_n") > 1, "repeated_id").when(~F.coalesce(track.isin(CALIBRATION, ANNOTATION), F.lit(False)), "track")
        .when(((track == CALIBRATION) & ~own(CALIBRATION, False)) | ((track == ANNOTATION) & ~own(ANNOTATION, True)), "provenance").when(~flag("uses_target_qa_labels", False), "target_labels").when(F.col("signed_axes_visible").isNull(), "axes_unknown")
        .when(F.coalesce(signed, F.lit(False)) & ~flag("signed_axes_visible", True), "axes_hidden").when((track == ANNOTATION) & flag("signed_axes_visible", True), "axes_claimed")
        .when(F.coalesce(relational, F.lit(False)) & ~F.coalesce(F.upper(F.trim("answer")).isin("A", "B"), F.lit(False)), "letter")
    )
    j = qa.join(counts, qa["qa_id"].eqNullSafe(counts["qa_id"]), "left").drop(counts["qa_id"])
    return j.select("qa_id", reason.alias("reason")).where("reason is not null")


def training_gate(qa: DataFrame) -> DataFrame:
    """(qa_id) of questions that may not be trained on: seven fields must all say so."""
    ok = (F.col("research_track") == CALIBRATION) & (F.col("answer_source") == SOURCES[CALIBRATION]) & F.col("training_allowed")
    for f in ("uses_target_qa_labels", "uses_entity_world_annotations", "external_test_only", "uses_human_target_annotations"):
        ok = ok & ~F.col(f)
    return qa.where(~F.coalesce(ok, F.lit(False))).select("qa_id")


def manifest_overlaps(sources: DataFrame, markers: DataFrame, places: int = 8) -> DataFrame:
    """(kind, key, splits): source hashes, rounded marker coordinates and coordinate seeds that independently made splits share. A seed
    is reused only if all splits have it. ``sources``: (split, source_hash); ``markers``: (split, dataset_id, x, y, seed)."""
    sets = lambda df, key: df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set("split")).alias("s"))
    hashes = sets(sources.where("source_hash <> ''"), F.col("source_hash")).where(F.size("s") > 1).withColumn("kind", F.lit("source"))
    at = lambda c: F.call_function("format_number", F.bround(c, places), F.lit("0." + "0" * places))
    points = sets(markers, F.concat_ws(":", "dataset_id", at("x"), at("y"))).where(F.size("s") > 1).withColumn("kind", F.lit("coordinate"))
    splits = markers.agg(F.count_distinct("split").alias("_n"))
    seeds = sets(markers, F.col("seed").cast("string")).join(splits).where((F.size("s") == F.col("_n")) & (F.col("_n") > 1)).drop("_n").withColumn("kind", F.lit("seed"))
    return hashes.unionByName(points).unionByName(seeds).select("kind", "key", F.array_join("s", ",").alias("splits"))


def _digest_in_order(pieces: DataFrame) -> DataFrame:
    """(n, digest): the hash of all pieces' hashes in order. They pass through one task as a stream, so that none are gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole, n, between = hashlib.sha256(), 0, ""
        for b in batches:
            if len(b):
                whole.update((between + "|".join(b["h"])).encode())
                n, between = n + int(b["n"].sum()), "|"
        if between:
            yield pd.DataFrame({"n": [n], "digest": [whole.hexdigest()]})

    return pieces.select("_p", "n", "h").repartition(1).sortWithinPartitions("_p").mapInPandas(run, "n long, digest string")


def _pieces(rows: DataFrame, parts: int, level: int) -> DataFrame:
    """(_p, n, h) of each ``parts`` places of ``rows``, which has the same columns; on the lowest level hashes stand behind their place."""
    text = F.col("h") if level else F.concat_ws(":", F.col("_p").cast("string"), "h")
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", text.alias("t")))), lambda x: x["t"]), "|"), 256)
    return rows.groupBy(F.floor(F.col("_p") / parts).alias("_k")).agg(F.sum("n").alias("n"), whole.alias("h")).withColumnRenamed("_k", "_p")


def sequence_digest(samples: DataFrame, position: str, parts: int = 4096, levels: int | None = None) -> DataFrame:
    """(n, digest): an order-sensitive hash of a list of samples: a hash of each row, hashed in order within pieces of ``parts`` places, these
    hashed in order within pieces of ``parts`` pieces, and so on to one. No more than ``parts`` hashes are ever gathered; no rows give no digest.
    With ``levels`` (two at least) the last of so many takes all pieces that are left, however many."""
    columns = sorted(c for c in samples.columns if c != position)
    row = samples.select(F.col(position).cast("long").alias("_p"), F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    if levels is not None:
        for level in range(levels - 1):
            row = _pieces(row, parts, level)
        return _digest_in_order(row)
    last, level = row.agg(F.max("_p")).first()[0], 0
    while last is not None and (level < 2 or last > 0):
        row, last, level = _pieces(row, parts, level), last // parts, level + 1
    return row.select("n", F.col("h").alias("digest"))
