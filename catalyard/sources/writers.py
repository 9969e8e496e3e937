"""Sinks of catalogue tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .parted import PartedTable


def write_csv(df: DataFrame, path: str, first: tuple[str, ...] = ("Brand", "Model")) -> None:
    """A CSV with a header, sorted: ``first`` columns first, the others by name; missing values are empty."""
    cols = [*(c for c in first if c in df.columns), *sorted(c for c in df.columns if c not in first)]
    out = df.select(*cols).orderBy(*cols[: len(first)])
    out.write.csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(df[column].cast("string")).write.text(path)


def save_table(df: DataFrame, path: str, clear: bool = False) -> None:
    """Adds to a stored table, or replaces it (``clear``)."""
    df.write.mode("overwrite" if clear else "append").parquet(path)


def reload(batch: DataFrame, table: PartedTable, update: Sequence[str], order: Sequence[str], clear: bool = False) -> DataFrame:
    """``table`` after ``batch`` is upserted, or put in place of it all (``clear``); returns what is stored. Without ``clear`` only
    the parts that the batch touches are read and written."""
    spark = batch.sparkSession
    columns = [c for c in batch.columns if c not in order]
    if clear or not table.exists(spark):
        table.create(batch.select(*columns).limit(0))
    table.upsert(batch, update, order)
    return table.read(spark)


def preview(df: DataFrame, ordinal: str, n: int = 5) -> tuple[int, DataFrame]:
    """How many rows there are, and the first ``n``."""
    return df.count(), df.orderBy(ordinal).limit(n)
