"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and 0x09-0x0D, which is also what ``bytes.split()`` splits on.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table has is left out."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: a cut in the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def sent_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a hint to broadcast it, if it has so many short rows at most; else Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, mb: int = 8) -> None:
    """Whole texts travel in Arrow batches of so many MB or a row more, which bounds a Python worker's memory.

    This session setting stays, as frames are computed later; it is only ever lowered, and every operator sets the same.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))  # with a unit: somebody's own choice, which stays
    if now and not 0 < int(now[1]) <= mb << 20:
        spark.conf.set(key, f"{mb << 20}b")


def forget_words() -> None:
    """In a Python worker: gives back what an earlier stage's tokenizer remembered, and Arrow's unused memory."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens and tokens._encoders:
        tokens._encoders.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def bucket_of(n: int, *cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
