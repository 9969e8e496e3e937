"""Catalogues stored in order, whose pages are read by number."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parted import store_schema, stored_schema

PART, PLACE = "part", "place"


@dataclass(frozen=True)
class PagedTable:
    """Rows of ``path``/rows/part=N, parts and rows in the order of the columns ``by``; ``place`` counts a part's rows from 0, and
    ``path``/parts says how many rows are before each part."""

    path: str
    by: tuple[str, ...] = ("brand", "model", "id")

    def create(self, df: DataFrame, parts: int) -> None:
        """Stores ``df`` in ``parts`` ranges of about equal size. ``by`` should end in a unique column; rows equal in it have any
        order, which then stays."""
        ordered = df.repartitionByRange(parts, *self.by).sortWithinPartitions(*self.by)
        # The number of a row within its task; tasks and ranges are the same.
        placed = ordered.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(PLACE))
        placed.write.mode("overwrite").partitionBy(PART).parquet(f"{self.path}/rows")
        store_schema(placed, f"{self.path}/rows")
        sizes = self._stored(df.sparkSession).groupBy(PART).agg(F.count("*").alias("n"))
        sizes = sizes.selectExpr(PART, "n", f"sum(n) over (order by {PART}) - n as before")  # a row for each part
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts")

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(stored_schema(spark, f"{self.path}/rows")).parquet(f"{self.path}/rows")

    def _rows(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        """The rows from place ``first`` to before ``last``, over all."""
        parts = spark.read.parquet(f"{self.path}/parts").where((F.col("before") < last) & (F.col("before") + F.col("n") > first)).collect()
        hit = F.lit(False)
        for p in parts:
            hit = hit | ((F.col(PART) == p.part) & (F.col(PLACE) >= first - p.before) & (F.col(PLACE) < last - p.before))
        return self._stored(spark).where(F.col(PART).isin([p.part for p in parts]) & hit)

    def page(self, spark: SparkSession, number: int, size: int = 50) -> DataFrame:
        """A page by its number, from 1, in order: one part is opened, or as many as it lies in. Pages past the end are empty."""
        if number < 1:
            raise ValueError("pages are numbered from 1")
        found = self._rows(spark, (number - 1) * size, number * size)
        return found.orderBy(PART, PLACE).limit(size).drop(PART, PLACE)

    def pages(self, spark: SparkSession, size: int = 50) -> int:
        """How many pages there are; only the sizes of parts are read."""
        rows = spark.read.parquet(f"{self.path}/parts").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        return -(-rows // size)

    def find_page(self, spark: SparkSession, key: Sequence[object], size: int = 50) -> int:
        """The number of the page that the row with these values of ``by``, or the first after it, is on."""
        less, level = F.lit(False), F.lit(True)
        for c, v in zip(self.by, key):
            before = F.col(c).isNotNull() & (F.col(c) < F.lit(v)) if v is not None else F.lit(False)
            less = less | (level & (before | (F.col(c).isNull() & F.lit(v is not None))))
            level = level & F.col(c).eqNullSafe(F.lit(v))
        return self._stored(spark).where(less).count() // size + 1
