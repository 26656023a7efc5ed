"""Queries for audits, rules and variants, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as fn
from ..functions import texts
from ..operators import audit, rules, stats, variants
from ..sources import adapters as A
from . import scoring, trajectory


def _r(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def duplicate_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_keys(A.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def split_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = A.table(spark, sf_dir, "documents").select("lang", (F.floor(F.col("doc_id") / 9) % 3).cast("string").alias("split"), F.floor(F.col("doc_id") / 20).alias("scene"))
    return audit.split_isolation(docs, ["lang", "scene"], "split")


def coordinate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).cast("string").alias("split"), ((F.col("c_custkey") % 21) / 8).alias("x"), ((F.col("c_custkey") % 5) / 4).alias("y"))
    return _r(audit.coordinate_overlap(c, "split", "x", "y"))


def letter_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("cell"), F.when(F.col("o_orderkey") % 5 < F.col("o_custkey") % 5, "A").when(F.col("o_orderkey") % 5 == 4, "C").otherwise("B").alias("answer"))
    return _r(audit.letter_balance(qa, ["cell"], "answer"))


def audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 2).alias("pair_id"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise(F.when(F.col("o_custkey") % 9 == 0, "A").otherwise("B")).alias("answer"), F.concat(F.lit("q"), (F.col("o_custkey") % 2).cast("string")).alias("question"), (F.col("o_custkey") % 40).alias("f0"))
    return audit.audit_pairs(o.withColumn("f1", F.col("f0") + 10))


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.scored(A.predictions(spark, sf_dir))
    now = rows.groupBy(*scoring.CELL).agg(F.avg("score").alias("v"))
    then = rows.where("item % 3 <> 0").groupBy(*scoring.CELL).agg(F.avg("score").alias("v")).where("category <> 'dynamics_path_player' or arm = 'm'")
    return _r(audit.reconcile(now, then, scoring.CELL, "v", 0.5))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.scored(A.predictions(spark, sf_dir)).where("arm = 'm'").withColumn("index", F.floor((F.col("item") - 1) / 4).cast("long"))
    log = p.withColumn("prediction", F.when(F.col("item") % 101 == 0, 1.0).otherwise(F.col("prediction")))
    return audit.audit_prediction_log(log, p.where("item % 17 <> 0").select("index").distinct(), fn.parse_strict)


def cell_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.scored(A.predictions(spark, sf_dir)).withColumn("seed", F.col("item") % 4)
    cells = stats.family_stats(rows, ["model", "arm", "seed"])
    return rules.cell_count_rule(cells, ["model", "arm"], "tmra", 70.0, 40.0, 3, 3)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = trajectory._items(spark, sf_dir)[1].where("answer is not null").select("category", "seq", "track", "window_index", "answer")
    return variants.with_question(items, trajectory._base(spark, sf_dir)[2])


def rescale_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.rescale_prior(_questions(spark, sf_dir))


def strip_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.strip_prior(_questions(spark, sf_dir).where("category <> 'time'"))


def frame_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = trajectory._base(spark, sf_dir)[2]
    key = F.concat_ws("/", "seq", F.col("window_index").cast("string"))
    text = lambda m: F.array_join(F.transform(variants.frame_mode(F.col("frames"), key, m), lambda x: x.cast("string")), ",").alias(m)
    return w.select("seq", "window_index", text("single"), text("static4"), text("shuffle"))


def cross_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.cross_image_map(A.table(spark, sf_dir, "pages").select("url"), "url")


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return variants.quota_sample(c, ["c_nationkey"], ["c_custkey"], 100)


_C = "model, arm, category"
QUERIES = {
    "duplicate_detections": duplicate_detections, "split_isolation": split_isolation, "coordinate_overlap": coordinate_overlap, "letter_balance": letter_balance, "audit_pairs": audit_pairs, "reconcile": reconcile,
    "prediction_log": prediction_log, "cell_rule": cell_rule, "rescale_prior": rescale_prior, "strip_prior": strip_prior, "frame_modes": frame_modes, "cross_images": cross_images, "quota_sample": quota_sample,
}
_LEAD = f"'{texts.FRAMES[0]}4{texts.FRAMES[1]}2.0{texts.FRAMES[2]}'"


def _ask(family: str, prior: str | None) -> str:
    """SQL text of a numeric question of 2-second windows."""
    said = f"'{prior}'" if prior else "''"
    return f"{_LEAD} || {said} || CASE {family} WHEN 'speed' THEN '{texts.ASK['speed']}' WHEN 'path' THEN '{texts.ASK['path']}' ELSE '{texts.ASK['time']}' END || '{texts.NUMBER_ONLY}'"


_ASK = _ask("category", texts.PRIOR.format(1.93))
ORACLES = {
    "duplicate_detections": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "split_isolation": "SELECT lang, doc_id // 20 AS scene, string_agg(DISTINCT CAST(doc_id // 9 % 3 AS VARCHAR), ',' ORDER BY CAST(doc_id // 9 % 3 AS VARCHAR)) AS splits FROM documents GROUP BY ALL HAVING count(DISTINCT doc_id // 9 % 3) > 1",
    "coordinate_overlap": """SELECT round(x, 6) AS x, round(y, 6) AS y, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT CAST(c_custkey % 4 AS VARCHAR) AS s, (c_custkey % 21) / 8.0::DOUBLE AS x, (c_custkey % 5) / 4.0::DOUBLE AS y FROM customer)
GROUP BY x, y HAVING count(DISTINCT s) > 1""",
    "letter_balance": """WITH q AS (SELECT o_custkey % 50 AS cell, CASE WHEN o_orderkey % 5 < o_custkey % 5 THEN 'A' WHEN o_orderkey % 5 = 4 THEN 'C' ELSE 'B' END AS a FROM orders
), l AS (SELECT cell, a, count(*) AS c FROM q WHERE a IN ('A', 'B') GROUP BY ALL), g AS (SELECT cell, CAST(sum(c) AS BIGINT) AS n, max(c) / sum(c) AS share FROM l GROUP BY cell) SELECT cell, n, round(share, 6) AS share, n < 10 OR share <= 0.6 AS ok FROM g""",
    "audit_pairs": """WITH g AS (
  SELECT CAST(floor(o_orderkey / 2) AS BIGINT) AS pair_id, count(*) AS n, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 OR o_custkey % 9 = 0 THEN 'A' ELSE 'B' END) AS a, count(DISTINCT o_custkey % 2) AS t, max(o_custkey % 40) AS later, min(o_custkey % 40 + 10) AS sooner FROM orders GROUP BY 1
) SELECT pair_id, CASE WHEN n <> 2 THEN 'rows' WHEN a <> 2 THEN 'answers' WHEN t <> 1 THEN 'text' ELSE 'windows' END AS reason FROM g WHERE n <> 2 OR a <> 2 OR t <> 1 OR later <= sooner""",
    "reconcile": f"""WITH {scoring.SCORED}, c AS (SELECT {_C}, avg(score) AS computed FROM scored GROUP BY {_C}), p AS (SELECT {_C}, avg(score) AS published FROM scored WHERE item % 3 <> 0 AND (category <> 'dynamics_path_player' OR arm = 'm') GROUP BY {_C})
SELECT {_C}, round(computed, 6) AS computed, round(published, 6) AS published, coalesce(abs(computed - published) <= 0.5, false) AS ok FROM c FULL JOIN p USING ({_C})""",
    "prediction_log": f"""WITH {scoring.SCORED}, log AS (SELECT CAST(floor((item - 1) / 4) AS BIGINT) AS idx, prediction AS p, CASE WHEN item % 101 = 0 THEN 1.0 ELSE prediction END AS q, item FROM scored WHERE arm = 'm')
SELECT 'extra' AS problem, count(*) AS n FROM log WHERE idx NOT IN (SELECT idx FROM log WHERE item % 17 <> 0) UNION ALL SELECT 'parse', count(*) FROM log WHERE p IS DISTINCT FROM q UNION ALL SELECT 'holes', max(idx) + 1 - count(DISTINCT idx) FROM log""",
    "cell_rule": f"""WITH {scoring.SCORED}, c AS (SELECT model, arm, item % 4 AS seed, coalesce(sum(score), 0) / count(*) AS tmra, count(DISTINCT prediction) <= 2 AS d FROM scored GROUP BY ALL
), g AS (SELECT model, arm, count(*) FILTER (NOT d) AS live, count(*) FILTER (NOT d AND tmra >= 70) AS highs, count(*) FILTER (NOT d AND tmra <= 40) AS lows FROM c GROUP BY ALL)
SELECT *, CASE WHEN highs >= 3 THEN 'S' WHEN lows >= 3 THEN 'N' WHEN live < 3 THEN 'limited' ELSE 'I' END AS verdict FROM g""",
    "rescale_prior": f"""WITH {trajectory.ITEMS} SELECT category, seq, track, window_index, CASE WHEN category = 'time' THEN answer ELSE printf('%.1f', CAST(answer AS DOUBLE) * 1.45::DOUBLE / 1.93::DOUBLE) END AS answer, {_ask("category", texts.PRIOR.format(1.45))} AS question, answer AS original,
  CASE WHEN category = 'time' THEN 'invariant' ELSE 'rescaled' END AS effect FROM items WHERE answer IS NOT NULL""",
    "strip_prior": f"WITH {trajectory.ITEMS} SELECT category, seq, track, window_index, answer, {_ask('category', None)} AS question, 1 AS removed FROM items WHERE answer IS NOT NULL AND category <> 'time'",
    "frame_modes": f"""WITH {A.DETECTIONS}, {trajectory.WINDOWS}, w AS (SELECT seq, window_index, [f0, f0 + 20, f0 + 40, f0 + 60] AS fr FROM windows
), e AS (SELECT seq, window_index, fr, unnest(fr) AS x, unnest([0, 1, 2, 3]) AS i FROM w
), s AS (SELECT seq, window_index, fr, list(x ORDER BY sha256(seq || '/' || window_index || '|' || i), x) AS m FROM e GROUP BY ALL)
SELECT seq, window_index, CAST(fr[1] AS VARCHAR) AS single, array_to_string([fr[1], fr[1], fr[1], fr[1]], ',') AS static4, array_to_string(CASE WHEN m = fr THEN list_reverse(fr) ELSE m END, ',') AS shuffle FROM s""",
    "cross_images": """WITH d AS (SELECT DISTINCT url, sha256('cross|' || url) AS o FROM pages), r AS (SELECT url, lead(url) OVER (ORDER BY o) AS nxt, first_value(url) OVER (ORDER BY o) AS f FROM d) SELECT url, coalesce(nxt, f) AS other FROM r""",
    "quota_sample": """WITH s AS (SELECT c_nationkey, count(*) * 100 / (SELECT count(*) FROM customer) AS share FROM customer GROUP BY 1
), q AS (SELECT c_nationkey, floor(share) AS q, row_number() OVER (ORDER BY share - floor(share) DESC, c_nationkey) AS r, 100 - sum(floor(share)) OVER () AS l FROM s
), k AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('quota|' || c_custkey)) AS k FROM customer)
SELECT c_custkey, k.c_nationkey FROM k JOIN q ON k.c_nationkey = q.c_nationkey WHERE k <= q + CASE WHEN r <= l THEN 1 ELSE 0 END""",
}
