"""Windows of tracks are made once a query, and their medians and paths are those of a plain restatement."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from kinetable.operators import geometry as geo


@pytest.mark.parametrize("name", ["crowding", "crowd_shares", "sparse_oracle", "chat_records", "pool_pair", "speed_path_consistency", "numeric_items"])
def test_no_plan_makes_windows_again(spark, name):
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RDD" in plan and "collect_list(struct(frame" not in plan


def test_middle_of_heights_and_path_over_points(spark):
    at = [(f, None if f in (4, 9) else float((f * 7) % 11), float(f), float(f * f)) for f in range(3, 20)]
    df = spark.createDataFrame([(at, 3, 13), (at, 15, 19), (at, 9, 9), (at, 1, 8)], "at array<struct<frame:int,h:double,sx:double,sy:double>>, a int, b int")
    got = df.select(geo._heights(F.col("a"), F.col("b")).alias("h"), geo._points("sx", "sy").alias("p")).select(geo._middle("h").alias("m"), geo._path("p").alias("path")).collect()
    step = lambda f, g: ((g - f) ** 2 + (g * g - f * f) ** 2) ** 0.5
    assert [r.m for r in got] == [4.0, 5.0, None, 5.0]
    assert [r.path and round(r.path, 9) for r in got] == [round(step(3, 8) + step(8, 13), 9), round(step(15, 19), 9), None, None]
