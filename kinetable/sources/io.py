"""Readers of clips, items, prediction logs and tracking labels; writers of item and metric tables. Paths may be globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QA_SCHEMA = (
    "category string, question string, answer string, pair_id string, pair_role string, image_id string, image_ids array<string>, "
    "highlight array<struct<track:int,color:string,shape:string>>, meta struct<seq:string,track:int,window:array<int>,fps:double,arm:string,unit:string,score_tolerance:double,score_floor:double,reference_value:double>"
)
PREDICTION_SCHEMA = (
    "index int, category string, seq string, track int, window array<int>, fps double, unit string, score_tolerance double, score_floor double, "
    "reference_value double, reference_convention string, prediction double, lenient_prediction double, raw_answer string"
)


def _path_part(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_mot(spark: SparkSession, paths: str | list[str], clip_pattern: str = r"([^/]+)/gt/[^/]*$") -> DataFrame:
    """MOT text without a header: the first six columns, the clip's name from the path; blank lines are skipped."""
    raw = spark.read.text(paths).select(_path_part(clip_pattern).alias("seq"), F.split("value", ",").alias("v")).where(F.size("v") >= 6)
    names = ("x", "y", "w", "h")
    cast = lambda i, t: F.trim(F.get("v", F.lit(i))).try_cast(t)
    return raw.select("seq", cast(1, "double").cast("int").alias("track"), cast(0, "double").cast("int").alias("frame"), *(cast(i + 2, "double").alias(n) for i, n in enumerate(names))).where("frame is not null")


def read_seqinfo(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a clip from INI files: seq, fps, width, height, length."""
    lines = spark.read.text(paths).where(F.contains("value", F.lit("="))).select(F.col("_metadata.file_path").alias("file"), F.split("value", "=", 2).alias("kv"))
    keys = ["name", "frameRate", "imWidth", "imHeight", "seqLength"]
    wide = lines.select("file", F.trim(F.col("kv")[0]).alias("k"), F.trim(F.col("kv")[1]).alias("v")).groupBy("file").pivot("k", keys).agg(F.first("v"))
    return wide.select(F.col("name").alias("seq"), F.col("frameRate").cast("double").alias("fps"), F.col("imWidth").cast("int").alias("width"), F.col("imHeight").cast("int").alias("height"), F.col("seqLength").cast("int").alias("length"))


def read_qa(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Items from JSON files that hold an array or an object with the array under ``qa``."""
    wrapped = T.StructType([*T.StructType.fromDDL(QA_SCHEMA).fields, T.StructField("qa", T.ArrayType(T.StructType.fromDDL(QA_SCHEMA)))])
    rows = spark.read.schema(wrapped).option("multiLine", True).json(paths)
    return rows.where("qa is null").drop("qa").unionByName(rows.where("qa is not null").select(F.explode("qa").alias("q")).select("q.*"))


def read_predictions(spark: SparkSession, root: str, cell_pattern: str = r"([^/]+)_s(\d+)/([^/]+)/([^/]+)/[^/]*$", files: str = "*.jsonl") -> DataFrame:
    """Prediction logs (JSON lines) with their cell (model, seed, seq, arm) from the path; only of cells whose folder also has
    the completion files summary.json and run_config.json."""
    log = spark.read.schema(PREDICTION_SCHEMA).option("recursiveFileLookup", True).option("pathGlobFilter", files).json(root)
    log = log.select("*", F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "").alias("_dir"), *(F.regexp_extract(F.col("_metadata.file_path"), cell_pattern, i).alias(n) for i, n in ((1, "model"), (2, "_seed"), (3, "_seq"), (4, "arm"))))
    marks = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{summary,run_config}.json").load(root).select("path")
    done = marks.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("_dir")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.regexp_replace("_dir", "^file:/+", "/").alias("_dir"))
    return log.withColumn("_dir", F.regexp_replace("_dir", "^file:/+", "/")).join(done, "_dir", "left_semi").withColumn("seed", F.col("_seed").cast("int")).withColumn("seq", F.coalesce("seq", "_seq")).drop("_dir", "_seed", "_seq")


def read_homography(spark: SparkSession, paths: str | list[str], clip_pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """(seq, h00..h22, meta as JSON text) from JSON files with a 3 x 3 matrix; the clip's name is the file's."""
    raw = spark.read.schema("H_img2court_m array<array<double>>, meta string").option("multiLine", True).json(paths)
    return raw.select(_path_part(clip_pattern).alias("seq"), *(F.col("H_img2court_m")[i][j].alias(f"h{i}{j}") for i in range(3) for j in range(3)), "meta")


def read_gamestate(spark: SparkSession, paths: str | list[str], clip_pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """Players and goalkeepers with both boxes: clip, image, track, foot point in the image and on the pitch."""
    box = "struct<x:double,y:double,w:double,h:double,x_center:double,y_center:double>"
    pitch = "struct<x_bottom_middle:double,y_bottom_middle:double>"
    schema = f"images array<struct<image_id:string,file_name:string>>, annotations array<struct<image_id:string,category_id:int,track_id:int,bbox_image:{box},bbox_pitch:{pitch}>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(paths).withColumn("clip", _path_part(clip_pattern))
    images = raw.select("clip", F.explode("images").alias("i")).select("clip", "i.image_id", F.regexp_extract("i.file_name", r"(\d+)", 1).cast("int").alias("frame"))
    boxes = raw.select("clip", F.explode("annotations").alias("a")).where("a.category_id in (1, 2) and a.bbox_image is not null and a.bbox_pitch is not null")
    boxes = boxes.select("clip", "a.image_id", F.col("a.track_id").alias("track"), F.col("a.bbox_image.x_center").alias("fx"), (F.col("a.bbox_image.y") + F.col("a.bbox_image.h")).alias("fy"), F.col("a.bbox_image.h").alias("h"), F.col("a.bbox_pitch.x_bottom_middle").alias("px"), F.col("a.bbox_pitch.y_bottom_middle").alias("py"))
    return boxes.join(images, ["clip", "image_id"])


def read_poses(spark: SparkSession, paths: str | list[str], clip_pattern: str = r"([^/]+)/[^/]+/[^/]*$", frame_pattern: str = r"([0-9]+)\.json$") -> DataFrame:
    """(clip, frame, person, joints) from JSON files of a frame each, which map a person to a list of joints; the clip is the folder above."""
    raw = spark.read.text(paths, wholetext=True).select(_path_part(clip_pattern).alias("clip"), _path_part(frame_pattern).cast("int").alias("frame"), F.from_json("value", "map<string,array<array<double>>>").alias("m"))
    return raw.select("clip", "frame", F.explode("m").alias("person", "joints"))


def read_camera(spark: SparkSession, paths: str | list[str], clip_pattern: str = r"([^/]+)/[^/]+/[^/]*$", cam_pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """(clip, cam, intrinsic, extrinsic) from JSON files; the camera is the file's name and the clip the folder above."""
    raw = spark.read.schema("intrinsic array<array<double>>, extrinsic array<array<double>>").option("multiLine", True).json(paths)
    return raw.select(_path_part(clip_pattern).alias("clip"), _path_part(cam_pattern).alias("cam"), "intrinsic", "extrinsic")


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_digests(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, status): same, changed, missing or unrecorded."""
    j = found.select("path", F.col("sha256").alias("a")).join(recorded.select("path", F.col("sha256").alias("b")), "path", "full")
    return j.select("path", F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unrecorded").when(F.col("a") == F.col("b"), "same").otherwise("changed").alias("status"))


def write_items(items: DataFrame, path: str, kind: str = "parquet") -> None:
    """Items or metrics by category, as Parquet or JSON lines."""
    items.write.partitionBy("category").mode("errorifexists").format(kind).save(path)
