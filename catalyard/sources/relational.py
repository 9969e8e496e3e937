"""Tables in a relational store over JDBC: reads split by key, and writes that replace a table at once."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Store:
    """A database by its ``url``, with JDBC ``properties`` (driver, user, password). Tables have plain names; columns are quoted by
    ``quote``, as Spark writes them."""

    url: str
    properties: Mapping[str, str] = field(default_factory=dict)
    quote: str = '"'

    def _ask(self, spark: SparkSession, query: str) -> DataFrame:
        """A query that the database runs itself."""
        return spark.read.jdbc(self.url, f"({query}) q", properties=dict(self.properties))

    def key_ranges(self, spark: SparkSession, table: str, key: str, tasks: int, cells: int = 64) -> list[str]:
        """Conditions on a whole-number ``key`` that part ``table`` into about ``tasks`` ranges of about as many rows each.

        The database counts rows in ``cells`` ranges of equal width; one that holds more than a task's share is counted in
        finer ranges again, so keys may lie as unevenly as they like. Nulls go with the first range.
        """
        key = f"{self.quote}{key}{self.quote}"
        span = self._ask(spark, f"select min({key}) as lo, max({key}) as hi, count(*) as n from {table}").first()
        lo, hi, n = span[0], span[1], span[2]
        if lo is None or tasks < 2:
            return ["1 = 1"]
        share = -(-n // tasks)
        waiting, counted = [(int(lo), int(hi))], []
        while waiting:
            a, z = waiting.pop()
            width = max(1, -(-(z - a + 1) // cells))
            cell = f"select ({key} - ({a})) / {width} as c from {table} where {key} between {a} and {z}"
            for c, m in self._ask(spark, f"select c, count(*) as m from ({cell}) x group by c").collect():
                first, last = a + int(c) * width, min(z, a + int(c) * width + width - 1)
                if m > share and last > first:
                    waiting.append((first, last))
                else:
                    counted.append((first, m))
        cuts, held = [], 0
        for first, m in sorted(counted):
            if held and held + m > share:
                cuts.append(first)
                held = 0
            held += m
        parts = [f"{key} < {cuts[0]} or {key} is null"] if cuts else ["1 = 1"]
        parts += [f"{key} >= {a} and {key} < {z}" for a, z in zip(cuts, cuts[1:])]
        return parts + ([f"{key} >= {cuts[-1]}"] if cuts else [])

    def read(self, spark: SparkSession, table: str, key: str | None = None, tasks: int = 8) -> DataFrame:
        """A table; by ranges of ``key``, if one is named, in as many tasks. Columns come in lower case."""
        if key is None:
            df = spark.read.jdbc(self.url, table, properties=dict(self.properties))
        else:
            df = spark.read.jdbc(self.url, table, predicates=self.key_ranges(spark, table, key, tasks), properties=dict(self.properties))
        return df.toDF(*(c.lower() for c in df.columns))

    def _run(self, spark: SparkSession, *statements: str) -> None:
        """Carries out statements in one transaction; none stands if one fails."""
        jvm = spark._jvm
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.properties["driver"])
        given = jvm.java.util.Properties()
        for k, v in self.properties.items():
            given.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, given)
        try:
            connection.setAutoCommit(False)
            for s in statements:
                statement = connection.createStatement()
                statement.execute(s)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def exists(self, spark: SparkSession, table: str) -> bool:
        try:
            self._ask(spark, f"select count(*) as n from {table}").first()
        except Exception:  # each database says it in its own way
            return False
        return True

    def replace(self, df: DataFrame, table: str, batch: int = 5000, kinds: str | None = None) -> None:
        """``table`` holds the rows of ``df`` afterwards, and before that what it held: rows go to a table ``<table>_new`` in batches
        of ``batch``, by many tasks, and then it takes the other's name, in one transaction where the database has that for names.

        A task that runs again may add its rows twice, so the number of rows is compared before the change of names: what
        doesn't agree fails, and the old table stays. What a failed write leaves is cleared by the next. ``kinds``: types of columns, where Spark's for the
        database won't do (``name varchar(50), ...``).
        """
        spark, new = df.sparkSession, f"{table}_new"
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("batchsize", batch)
        writer = writer.option("createTableColumnTypes", kinds) if kinds else writer
        writer.jdbc(self.url, new, properties=dict(self.properties))
        if self._ask(spark, f"select count(*) as n from {new}").first()[0] != seen.get["n"]:
            raise RuntimeError(f"{new} doesn't have the rows that were written; {table} stays")
        drop = [f"drop table {table}"] if self.exists(spark, table) else []
        self._run(spark, *drop, f"rename table {new} to {table}")

    def upsert(self, batch: DataFrame, table: str, keys: list[str], update: list[str], order: list[str], overwrite: bool = True, split: str | None = None, tasks: int = 8) -> dict[str, Any]:
        """``table`` after ``batch``, by ``operators.upsert``; a batch given again changes nothing. Returns the tally."""
        from ..operators.upsert import counted, upsert
        from .scratch import forget, written

        old = self.read(batch.sparkSession, table, split, tasks)
        new, seen = counted(upsert(old, batch.select(*old.columns, *(c for c in order if c not in old.columns)), keys, update, order, overwrite), overwrite)
        made = written(new.select(*old.columns), "upserted")
        self.replace(made, table)
        forget(made)
        return dict(seen.get)
