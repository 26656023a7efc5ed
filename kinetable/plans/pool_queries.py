"""Queries on pools, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pools, stats
from ..sources import adapters as A
from . import scoring, trajectory


def _r(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def event_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    items = c.groupBy("conv_id").agg(F.collect_list("turn").alias("frames")).withColumn("event", F.floor(F.col("conv_id") / 5))
    held = c.where("conv_id % 37 = 0").select(F.floor(F.col("conv_id") / 5).alias("event"))
    return pools.event_holdout(items, held, "event", prefix="c/").select("conv_id", "event", F.array_join(F.array_sort("frames"), ",").alias("frames"))


def holdout_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations").withColumn("event", F.floor(F.col("conv_id") / 5))
    return pools.holdout_overlap(c, c.where("conv_id % 37 = 0"), "event")


def dev_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = trajectory._items(spark, sf_dir)[1].where("answer is not null")
    rows = items.join(trajectory._base(spark, sf_dir)[2].select("seq", "window_index", "f0", "f1"), ["seq", "window_index"])
    return pools.dev_clip(rows, rows.where("seq <> 'clip_1'"), "clip_1")


def small_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.small_strata(A.table(spark, sf_dir, "customer"), ["c_nationkey"], 60)


def live_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stats.family_stats(stats.scored(A.predictions(spark, sf_dir)).withColumn("seed", F.col("item") % 50), ["model", "category", "seed", "arm"])
    return pools.live_units(cells, ["model", "category", "seed"], ["m", "cm"])


def select_per_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.select_per_stratum(A.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 2)


def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.evenly_spaced_pick(A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 60)


def sample_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.sample_fixed(A.table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"], 3)


def pool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(pools.pool_stats(trajectory.mixed_units(spark, sf_dir), ["category", "unit"], "answer"))


def quotable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.scored(A.predictions(spark, sf_dir)).withColumn("seed", F.col("item") % 5)
    return _r(pools.quotable_ranges(stats.family_stats(rows, ["model", "arm", "category", "seed"]), ["model", "arm"], "rho"))


def speed_path_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = trajectory._items(spark, sf_dir)[1].where("answer is not null").select("category", "seq", "track", "window_index", F.col("answer").cast("double").alias("prediction"), "value", F.lit(2.0).alias("dur"))
    return _r(pools.speed_path_consistency(items, ["track", "window_index"], ["seq"], "dur", reference="value"))


QUERIES = {
    "event_holdout": event_holdout, "select_per_stratum": select_per_stratum, "evenly_spaced": evenly_spaced, "sample_fixed": sample_fixed, "pool_stats": pool_stats,
    "quotable_ranges": quotable_ranges, "live_units": live_units, "small_strata": small_strata, "holdout_overlap": holdout_overlap, "dev_clip": dev_clip, "speed_path_consistency": speed_path_consistency,
}
ORACLES = {
    "event_holdout": "WITH i AS (SELECT conv_id, count(*) AS n, string_agg('c/' || turn, ',' ORDER BY 'c/' || turn) AS fr, conv_id // 5 AS event FROM conversations GROUP BY conv_id) SELECT conv_id, event, fr AS frames FROM i WHERE n = 4 AND event NOT IN (SELECT conv_id // 5 FROM conversations WHERE conv_id % 37 = 0)",
    "select_per_stratum": "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 2",
    "evenly_spaced": """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus FROM r WHERE n <= 60 OR p IN (SELECT i * n // 60 FROM range(60) t(i))""",
    "sample_fixed": "SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY sha256('fixed|' || doc_id)) <= 3",
    "pool_stats": f"""WITH m AS ({trajectory.ORACLES["mixed_units"]}), d AS (SELECT category, unit, substr(answer, 1, 1) AS digit, count(*) AS c FROM m GROUP BY ALL
), b AS (SELECT *, row_number() OVER (PARTITION BY category, unit ORDER BY c DESC, digit) AS k FROM d), g AS (SELECT category, unit, count(*) AS n, median(CAST(answer AS DOUBLE)) AS median FROM m GROUP BY ALL)
SELECT category, unit, n, round(median, 6) AS median, digit, round(c / n, 6) AS digit_share FROM g JOIN b USING (category, unit) WHERE k = 1""",
    "quotable_ranges": f"""WITH {scoring.SCORED.replace("SELECT *, CASE WHEN regexp", "SELECT *, item % 5 AS seed, CASE WHEN regexp")}, {scoring._sql_rho("scored", "model, arm, category, seed", "prediction", "reference_value")}
, g AS (SELECT model, arm, category, seed, count(DISTINCT prediction) <= 2 AS d FROM scored GROUP BY ALL)
SELECT model, arm, count(*) FILTER (NOT d AND rho IS NOT NULL) AS live, count(*) FILTER (d) AS degenerate, round(min(rho) FILTER (NOT d), 6) AS lo, round(max(rho) FILTER (NOT d), 6) AS hi FROM g LEFT JOIN rho USING (model, arm, category, seed) GROUP BY model, arm""",
    "live_units": f"""WITH {scoring.SCORED}, c AS (SELECT model, category, item % 50 AS seed, arm, count(DISTINCT prediction) AS d FROM scored GROUP BY ALL) SELECT model, category, seed, count(*) FILTER (d >= 3 AND arm IN ('m', 'cm')) = 2 AS live FROM c GROUP BY ALL""",
    "small_strata": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) < 60",
    "holdout_overlap": "SELECT DISTINCT conv_id // 5 AS event FROM conversations WHERE conv_id // 5 IN (SELECT conv_id // 5 FROM conversations WHERE conv_id % 37 = 0)",
    "dev_clip": f"WITH {trajectory.ITEMS} SELECT category, seq, track, 6 + 30 * window_index AS f0, 66 + 30 * window_index AS f1, answer FROM items WHERE answer IS NOT NULL AND seq = 'clip_1'",
    "speed_path_consistency": f"""WITH {trajectory.ITEMS}, w AS (
  SELECT seq, track, window_index, max(CAST(answer AS DOUBLE)) FILTER (category = 'speed') AS s, max(CAST(answer AS DOUBLE)) FILTER (category = 'path') AS p, max(value) FILTER (category = 'speed') AS rs, max(value) FILTER (category = 'path') AS rp FROM items WHERE answer IS NOT NULL GROUP BY ALL
) SELECT seq, count(*) AS n, count(*) FILTER (s > 0) AS positive, round(median(p / (2 * s)) FILTER (s > 0), 6) AS median_s, round(avg((abs(p - 2 * s) <= 0.05 * 3 + 1e-9)::INT), 6) AS share_consistent, round(avg((abs(p - 2 * s) <= 0.15 + 1e-9)::INT), 6) AS share_nominal,
  0 AS changed, round(max(abs(rp - 2 * rs)), 6) AS identity_error FROM w WHERE s IS NOT NULL AND p IS NOT NULL GROUP BY seq""",
}
