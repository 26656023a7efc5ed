"""Corpus pipeline: toxic documents go, recurring lines go, one document of each near-duplicate class stays, documents
that contain benchmark passages go, and the rest is encoded.

Each stage takes the rows its predecessor kept and, but for the last, returns them with the columns of ``documents``.
Null or empty texts pass every filter (as one class of near-duplicates); empty tables give empty results; further
columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import bpe
from kinetable.llm.common import discard, id_text, stored, stored_paths, table
from kinetable.llm.decontaminate import decontaminate
from kinetable.llm.line_dedup import line_dedup
from kinetable.llm.near_dedup import near_dedup
from kinetable.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32 bit) and the digests of ids and decoded text."""
    path = bpe.word_bpe_path()
    coded = bpe.transcode(id_text(docs), path)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark),
    ("bpe", encode),
]

#: Not expressible in SQL: a fitted model, a similarity join's components and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. Once a stage's rows are stored, the tables it was made from are deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = stored_paths()
        source, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(spark, source, *(p for p in stored_paths()[:-1] if p not in before))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
