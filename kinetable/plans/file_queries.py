"""Queries on readers and writers: rows of the tables are written by Spark in each format into the shared folder, read back, and held against the
table they came from. Files lie in folders that Spark's writers name (``seq=clip_1/part-...``), so each reader gets the pattern of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import poses
from ..sources import adapters as A
from ..sources import io
from ..sources.shared import settled, through_files
from . import trajectory, views
from .scoring import _rounded

CLIP = r"seq=([^/]+)/[^/]*$"


def _texts(rows: DataFrame, keys: list[str], value: Column, path: str) -> None:
    """One text file for each row, in the folder of its keys."""
    rows.select(*keys, value.alias("value")).repartition(*keys).write.partitionBy(*keys).text(path)


def io_mot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO1: frame, track and box of all detections as comma-separated lines with further columns, and blank lines between them."""
    d = A.detections(spark, sf_dir)
    line = F.concat_ws(",", "frame", "track", *(F.col(c).cast("string") for c in ("x", "y", "w", "h")), F.lit("1"), F.lit("-1"))
    lines = d.select("seq", F.when(F.col("frame") % 7 == 0, F.concat(F.lit("\n"), line)).otherwise(line).alias("value"))
    return through_files(spark, lambda p: lines.repartition("seq").write.partitionBy("seq").text(p), lambda p: io.read_mot(spark, f"{p}/seq=*/*.txt", CLIP))


def io_seqinfo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO2: INI files of all clips."""
    c = A.clips(A.detections(spark, sf_dir))
    text = F.concat(F.lit("[Sequence]\nname="), "seq", F.lit("\nimDir = img1\nframeRate="), F.col("fps").cast("string"), F.lit("\nimWidth = "), F.col("width").cast("string"), F.lit("\nimHeight="), F.col("height").cast("string"), F.lit("\nseqLength="), F.col("length").cast("string"))
    return through_files(spark, lambda p: _texts(c.withColumn("clip", F.col("seq")), ["clip"], text, p), lambda p: io.read_seqinfo(spark, f"{p}/clip=*/*.txt"))


def io_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO3: a clip's numeric items as a JSON array, those of every other clip under ``qa``."""
    it = trajectory._items(spark, sf_dir)[1].where("answer is not null")
    meta = F.struct("seq", "track", F.array("window_index").alias("window"))
    one = it.select("seq", F.struct("category", "answer", F.concat(F.lit("Track "), F.col("track").cast("string"), F.lit(" \"now\"?\n")).alias("question"), meta.alias("meta")).alias("i"))
    files = one.groupBy("seq").agg(F.collect_list("i").alias("qa"))
    text = F.when(F.endswith("seq", F.lit("0")), F.to_json(F.struct("qa"))).otherwise(F.to_json("qa"))
    read = lambda p: io.read_qa(spark, f"{p}/seq=*/*.txt").select("category", "question", "answer", F.col("meta.seq").alias("seq"), F.col("meta.track").alias("track"), F.element_at("meta.window", 1).alias("window_index"))
    return through_files(spark, lambda p: _texts(files, ["seq"], text, p), read)


def _mark(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
        out.writeBytes("{}")
        out.close()


def io_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO4: prediction logs of every cell (model, seed, clip, arm) as JSON lines; cells of model_2's second seed lack a completion file."""
    p = A.predictions(spark, sf_dir).withColumns({"seed": (F.col("item") % 2).cast("int"), "seq": F.concat(F.lit("clip_"), (F.col("item") % 4).cast("string")), "index": F.col("item").cast("int")})
    rows = p.select("model", "seed", "seq", "arm", F.to_json(F.struct("index", "category", "reference_value", "score_tolerance", "score_floor", "raw_answer")).alias("value"))

    def write(path: str) -> None:
        keys = ["model", "seed", "seq", "arm"]
        rows.repartition(*keys).write.partitionBy(*keys).text(path)
        for m in range(3):  # a cell is a folder of its own: 48 of them, whatever the number of items
            for k in range(16):
                whole = m != 2 or k % 2 == 0
                _mark(spark, f"{path}/model=model_{m}/seed={k % 2}/seq=clip_{k // 2 % 4}/arm={('m', 'cm')[k // 8]}", "summary.json", *(["run_config.json"] * whole))

    pattern = r"model=([^/]+)/seed=(\d+)/seq=([^/]+)/arm=([^/]+)/[^/]*$"
    read = lambda path: io.read_predictions(spark, path, pattern, "part-*.txt").select("model", "seed", "seq", "arm", "index", "category", F.round("reference_value", 6).alias("reference_value"), F.round("score_tolerance", 6).alias("score_tolerance"), "raw_answer")
    return through_files(spark, write, read)


def io_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO5: maps of all clips; h22 carries the clip's length, so that files can't be mistaken for each other."""
    c = A.clips(A.detections(spark, sf_dir))
    h = A.homographies(c).join(c.select("seq", "length"), "seq").withColumn("h22", F.col("h22") + F.col("length"))
    matrix = F.array(*(F.array(*(f"h{i}{j}" for j in range(3))) for i in range(3)))
    text = F.to_json(F.struct(matrix.alias("H_img2court_m"), F.concat(F.lit("of "), "seq").alias("meta")))
    return through_files(spark, lambda p: _texts(h, ["seq"], text, p), lambda p: io.read_homography(spark, f"{p}/seq=*/*.txt", CLIP))


def io_gamestate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO6: images and annotations of all clips; the ball is of another category, and each eleventh frame has no place on the pitch."""
    d = A.detections(spark, sf_dir).withColumn("image_id", F.concat(F.lit("i"), F.col("frame").cast("string")))
    image = F.struct((F.col("x")).alias("x"), F.col("y").alias("y"), F.col("w").alias("w"), F.col("h").alias("h"), (F.col("x") + F.col("w") / 2).alias("x_center"), (F.col("y") + F.col("h") / 2).alias("y_center"))
    pitch = F.when(F.col("frame") % 11 != 0, F.struct((F.col("x") / 8).alias("x_bottom_middle"), (F.col("y") / 8).alias("y_bottom_middle")))
    category = F.when(F.col("track") == A.BALL, 4).when(F.col("track") == 1, 2).otherwise(1)
    note = F.struct("image_id", category.alias("category_id"), F.col("track").alias("track_id"), image.alias("bbox_image"), pitch.alias("bbox_pitch"))
    name = F.struct("image_id", F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".jpg")).alias("file_name"))
    files = d.groupBy("seq").agg(F.collect_set(name).alias("images"), F.collect_list(note).alias("annotations"))
    read = lambda p: _rounded(io.read_gamestate(spark, f"{p}/seq=*/*.txt", CLIP).select("clip", "frame", "track", "fx", "fy", "h", "px", "py"))
    return through_files(spark, lambda p: _texts(files, ["seq"], F.to_json(F.struct("images", "annotations")), p), read)


def io_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO7: joints of every frame and the cameras of every clip, through files, then boxes as in ``joint_boxes``."""
    p = A.poses(spark, sf_dir)
    frames = p.groupBy("clip", "frame").agg(F.map_from_entries(F.collect_list(F.struct("person", "joints"))).alias("m"))
    cams = A.cameras(p)

    def write(path: str) -> None:
        _texts(frames, ["clip", "frame"], F.to_json("m"), f"{path}/poses")
        _texts(cams, ["clip", "cam"], F.to_json(F.struct("intrinsic", "extrinsic")), f"{path}/cameras")

    def read(path: str) -> DataFrame:
        seen = io.read_poses(spark, f"{path}/poses/*/*/*.txt", r"clip=([^/]+)/", r"frame=(\d+)/")
        through = io.read_camera(spark, f"{path}/cameras/*/*/*.txt", r"clip=([^/]+)/", r"cam=([^/]+)/")
        return _rounded(poses.joint_boxes(seen, poses.projection(through), 1920.0, 1080.0))

    return through_files(spark, write, read)


def io_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO8: one file a customer, against a record in which some digests differ, are missing, or belong to no file."""
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 16).alias("part"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("value"))
    files = c.where("k % 13 <> 5").groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("value"))
    record = c.where("k % 13 <> 5").unionByName(c.where("k = 1").withColumn("part", F.lit(99).cast(c.schema["part"].dataType))).groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("v"))
    digest = F.sha2(F.concat(F.when(F.col("part") % 5 == 1, F.lit("x")).otherwise(F.lit("")), "v", F.lit("\n")), 256)
    recorded = record.where("part <> 7").select(F.col("part").cast("string").alias("path"), digest.alias("sha256"))

    def read(path: str) -> DataFrame:
        found = io.file_digests(spark, f"{path}/part=*/*.txt").withColumn("path", F.regexp_extract("path", r"part=(\d+)/", 1))
        return io.compare_digests(found, recorded).join(found.select("path", "bytes"), "path", "left")

    return through_files(spark, lambda p: _texts(files, ["part"], F.col("value"), p), read)


def io_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO9: numeric items by category, as Parquet and as JSON lines."""
    it = settled(trajectory.numeric_items(spark, sf_dir).where("answer is not null").drop("reason"))  # written in two formats
    schema = "seq string, track int, window_index int, answer string, category string"

    def write(path: str) -> None:
        for kind in ("parquet", "json"):
            io.write_items(it, f"{path}/{kind}", kind)

    def read(path: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/parquet").withColumn("kind", F.lit("parquet")).unionByName(spark.read.schema(schema).json(f"{path}/json").withColumn("kind", F.lit("json")))

    return through_files(spark, write, read)


QUERIES = {f.__name__: f for f in (io_mot, io_seqinfo, io_items, io_predictions, io_homography, io_gamestate, io_poses, io_digests, io_sinks)}
ORACLES = {
    "io_mot": f"WITH {A.DETECTIONS} SELECT seq, track, frame, x, y, w, h FROM detections",
    "io_seqinfo": f"WITH {A.DETECTIONS} SELECT seq, fps, width, height, length FROM clips",
    "io_items": f"WITH {trajectory.ITEMS} SELECT category, 'Track ' || track || ' \"now\"?' || chr(10) AS question, answer, seq, track, window_index FROM items WHERE answer IS NOT NULL",
    "io_predictions": f"""WITH {A.PREDICTIONS} SELECT model, CAST(item % 2 AS INT) AS seed, 'clip_' || item % 4 AS seq, arm, CAST(item AS INT) AS index, category, round(reference_value, 6) AS reference_value, round(score_tolerance, 6) AS score_tolerance, raw_answer
FROM predictions WHERE NOT (model = 'model_2' AND item % 2 = 1)""",
    "io_homography": f"WITH {A.DETECTIONS} SELECT seq, 0.01::DOUBLE AS h00, 0.001::DOUBLE AS h01, -5.0::DOUBLE AS h02, 0.0005::DOUBLE AS h10, 0.02::DOUBLE AS h11, -3.0::DOUBLE AS h12, 0.00001::DOUBLE AS h20, 0.0004::DOUBLE AS h21, 1.0::DOUBLE + length AS h22, 'of ' || seq AS meta FROM clips",
    "io_gamestate": f"WITH {A.DETECTIONS} SELECT seq AS clip, frame, track, round(x + w / 2, 6) AS fx, round(y + h, 6) AS fy, h, round(x / 8, 6) AS px, round(y / 8, 6) AS py FROM detections WHERE track <> 0 AND frame % 11 <> 0",
    "io_poses": views.ORACLES["joint_boxes"],
    "io_digests": """WITH f AS (SELECT c_custkey % 16 AS part, string_agg(v, chr(10) ORDER BY v) || chr(10) AS body FROM (SELECT c_custkey, 'customer ' || c_custkey AS v FROM customer WHERE c_custkey % 13 <> 5) GROUP BY 1)
SELECT CAST(part AS VARCHAR) AS path, CASE WHEN part = 7 THEN 'unrecorded' WHEN part % 5 = 1 THEN 'changed' ELSE 'same' END AS status, strlen(body) AS bytes FROM f UNION ALL SELECT '99', 'missing', NULL""",
    "io_sinks": f"WITH {trajectory.ITEMS} SELECT category, seq, track, window_index, answer, kind FROM items, (VALUES ('parquet'), ('json')) k(kind) WHERE answer IS NOT NULL",
}
