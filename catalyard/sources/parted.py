"""Stored tables parted by a hash of their key: an upsert reads and writes only the parts that its batch touches."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.upsert import counted, upsert

PART = "part"


def part_of(keys: Sequence[str], parts: int) -> Column:
    """The part of a row, from 0; nulls are values like any other."""
    return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys)), F.lit(parts)).cast("int")


def store_schema(df: DataFrame, path: str) -> None:
    """Writes the columns of ``df`` to ``path``/_table: a table of parts without a row doesn't show them."""
    df.sparkSession.createDataFrame([(df.schema.json(),)], "columns string").coalesce(1).write.mode("overwrite").text(f"{path}/_table")


def stored_schema(spark: SparkSession, path: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_table").first().value))


@dataclass(frozen=True)
class PartedTable:
    """The rows of ``path``/part=N, N by the hash of ``keys``, one row a key; ``path``/_table holds the columns.

    parts: how many there are; it is part of the table and never changes. A part should hold what a task can join, some
    hundred MB. Where a write fails, parts that were replaced by then have the batch and others don't: the same batch, given
    again, brings all to the same state, as an upsert changes nothing the second time.
    """

    path: str
    keys: tuple[str, ...]
    parts: int

    def exists(self, spark: SparkSession) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_table/_SUCCESS")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def create(self, df: DataFrame) -> None:
        """Stores ``df`` in place of all that was there, a file for each part."""
        placed = df.withColumn(PART, part_of(self.keys, self.parts)).repartition(PART)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(PART).parquet(self.path)
        store_schema(df, self.path)

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(stored_schema(spark, self.path).add(PART, T.IntegerType())).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(PART)

    def touched(self, batch: DataFrame) -> list[int]:
        """The parts that a batch has rows for; their number is bounded by the table's."""
        return sorted(r.part for r in batch.select(part_of(self.keys, self.parts).alias(PART)).distinct().collect())

    def upsert(self, batch: DataFrame, update: Sequence[str], order: Sequence[str], overwrite: bool = True) -> dict[str, int]:
        """The table after ``batch`` (its columns and ``order``), as ``operators.upsert`` does; returns the tally of A7, and how
        many parts were touched.

        Files of parts without a row of the batch aren't read, and stay. Counts are observed on the frame that is written,
        so that nothing is read again for them.
        """
        spark = batch.sparkSession
        some = self.touched(batch)
        old = self._stored(spark).where(F.col(PART).isin(some)).drop(PART)
        new = upsert(old, batch.select(*old.columns, *(c for c in order if c not in old.columns)), self.keys, update, order, overwrite)
        new, seen = counted(new, overwrite)
        placed = new.select(*old.columns, part_of(self.keys, self.parts).alias(PART)).repartition(PART)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)
        return {**seen.get, "parts": len(some)}
