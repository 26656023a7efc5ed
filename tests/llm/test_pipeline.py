"""The pipeline's stages on a small table, each against what the operators' own tests establish."""

import corpus_pipeline as cp
from kinetable.llm.decontaminate import contamination
from kinetable.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out = cp.stored(out, f"test-{name}")
        assert 0 < out.count() <= docs.count()
        docs = out
    classes, _ = near_duplicates(docs)
    assert classes.groupBy("class_id").count().where("count > 1").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination(docs, bench).where("contaminated").count() == 0
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_stages_on_nulls_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, " \n\t", None, None, 1), (900_004, "word " * 30_000, "en", "s", 150_000)], docs.schema)
    extra = ["n", "g", "d", "h", "hits", "leaf", "score", "_row", "node", "rows", "ids_x", "toxic", "class_id"]
    docs = docs.unionByName(odd).select("*", *(F.lit(7).alias(c) for c in extra))
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stored(stage(spark, docs, SF), f"odd-{name}")
        assert docs.columns[-len(extra) :] == extra, name
        if name in ("toxicity", "line_dedup"):  # later, texts without words are one class of near-duplicates
            assert docs.where("text is null").count() == 2, name
    assert docs.where("coalesce(text, '') not rlike '[0-9A-Za-z]'").count() == 1
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_run_leaves_only_its_result(spark):
    from kinetable.llm.common import stored_paths

    before = stored_paths()
    out = cp.run(spark, SF)
    left = [p for p in stored_paths() if p not in before]
    assert out.count() > 0 and len(left) == 1 and "pipeline-bpe" in left[0]
