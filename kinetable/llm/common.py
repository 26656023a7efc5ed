"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = str(Path(__file__).resolve().parents[2])

#: Bytes of one Arrow batch sent to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = "4m"
#: A key is hot if it has more than one in so many of all rows, so that there are fewer hot keys than this.
HOT = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give a worker's freed memory back to the system, as the worker stays for later stages."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a local master gets a folder of its own; on a
    cluster it is an error, because a machine's own folder is not seen by the others."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = checkpoint.get() if checkpoint.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of the tables that ``stored`` has written and nobody has discarded, oldest first.
_stored: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _stored.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_paths() -> list[str]:
    return list(_stored)


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Delete tables written by ``stored`` (or their paths) once everything made from them is itself stored."""
    for t in tables:
        path = getattr(t, "_stored_at", None) if isinstance(t, DataFrame) else t
        if path in _stored:
            _stored.remove(path)
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def spread_join(rows: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``right``, which has one row a key and in ``n`` the number of its rows in ``rows`` (left out of
    the result); ``total`` is the number of rows in all.

    A hot key would send its rows to one task. There are fewer than ``HOT`` of them, so their rows of ``right`` are broadcast,
    and the rows that meet them are dealt evenly by a hash of themselves instead of the key."""
    columns = [c for c in right.columns if c not in keys and c != n]
    packed = right.select(*keys, F.struct(*columns, F.lit(True).alias("_met")).alias("_r"), n)
    hot = packed.where(F.col(n) * HOT > total).select(*(F.col(k).alias(f"_hot_{k}") for k in keys), F.col("_r").alias("_hot"))
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot_{k}") for k in keys], "left").drop(*(f"_hot_{k}" for k in keys))
    spread = F.when(F.col("_hot").isNotNull(), F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))))).otherwise(F.lit(0))
    # 0 for every row, but not as a constant, which would be no key to deal the rows by
    cold = packed.where(F.col(n) * HOT <= total).select(*keys, "_r", F.least(F.lit(0).cast("long"), F.col(n).cast("long")).alias("_spread"))
    out = met.withColumn("_spread", spread).join(cold, [*keys, "_spread"], "left")
    out = out.withColumn("_r", F.coalesce("_hot", "_r"))
    if how == "inner":
        out = out.where("_r is not null")
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"_r.{c}").alias(c) for c in columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def byte_column(column) -> tuple:
    """(bytes as uint8, offsets as int64 from 0) of an Arrow string or binary array without nulls, uncopied."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def regrouped(batches, most_bytes: int, column: str = "text"):
    """Arrow batches joined so that each holds about ``most_bytes`` of text (one batch at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
