"""CSV files of any headers, whose quoted fields may hold line ends, read in splits.

Where no field spans lines, each header's files go to Spark's own reader, which splits large files. Else lines are read in splits
and joined to records: a line maps "a quoted field is open before it" to "open after it", and such maps compose, so what is open
at a line follows from a row for each split and the lines before in its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text
from .scratch import written

#: Between quotes of a line: inside a quoted field, outside where a quote is a character, outside where a quote opens a field.
_INSIDE, _PLAIN, _READY = 1, 0, 2


def leaves_open(line: Column, opened: bool = False) -> Column:
    """Whether a quoted field is open after a line, where none or one is ``opened`` before it.

    A quote opens a field at its beginning, closes it, and opens it again right after (a doubled quote); others are
    characters. Only what lies between quotes is looked at, in one pass."""
    parts = F.split(line, '"', -1)
    ready = lambda x: F.endswith(x, F.lit(","))
    start = F.lit(_INSIDE) if opened else F.when(ready(parts[0]) | (parts[0] == ""), _READY).otherwise(_PLAIN)
    step = lambda s, x: F.when(s == _READY, _INSIDE).when(ready(x) | ((s == _INSIDE) & (x == "")), _READY).otherwise(_PLAIN)
    after = F.aggregate(F.slice(parts, 2, F.size(parts)), start, step) == _INSIDE
    return F.when(F.contains(line, F.lit('"')), after).otherwise(F.lit(opened))


def _steps(rows: DataFrame, group: Sequence[str], order: str, closed: str, opened: str) -> DataFrame:
    """``rows`` with ``fixed`` (the state after the last earlier row of the group that doesn't depend on the state before it, null
    if there is none) and ``flips`` (whether rows since then turn the state over, or rows from the group's beginning).

    ``closed`` and ``opened``: the state after a row where the state before is closed, or open.
    """
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.col(closed) & ~F.col(opened), 1).otherwise(0)
    rows = rows.withColumn("_turns", F.coalesce(F.sum(turns).over(before), F.lit(0)))
    own = F.when(F.col(closed) == F.col(opened), F.struct(F.col(closed).alias("state"), F.col("_turns").alias("turns")))
    last = F.last(own, ignorenulls=True).over(before)
    rows = rows.withColumn("_last", last)
    flips = (F.col("_turns") - F.coalesce("_last.turns", F.lit(0))) % 2 == 1
    return rows.withColumn("fixed", F.col("_last.state")).withColumn("flips", flips).drop("_turns", "_last")


def _state(fixed: Column, flips: Column, before: Column) -> Column:
    return F.coalesce(fixed, before) != flips


def records(lines: DataFrame) -> DataFrame:
    """(file, at, record) of ``lines`` (file, block, row, value): lines that a quoted field joins are one record, with its line ends;
    ``at`` is the place (block, row) of the first. A field that is never closed takes in the rest of its file.

    Windows hold a split's lines, or a row for each split of a file. A record's lines meet in one row."""
    w = ["file", "block"]
    lines = lines.withColumn("closed", leaves_open(F.col("value"))).withColumn("opened", leaves_open(F.col("value"), True))
    lines = _steps(lines, w, "row", "closed", "opened")
    after = lambda before: F.when(_state(F.col("fixed"), F.col("flips"), before), F.col("opened")).otherwise(F.col("closed"))
    # A split as one step: the state after its last line, for either state before.
    ends = lines.groupBy(*w).agg(F.max_by(F.struct(after(F.lit(False)).alias("c"), after(F.lit(True)).alias("o")), "row").alias("end"))
    ends = _steps(ends.select(*w, F.col("end.c").alias("closed"), F.col("end.o").alias("opened")), ["file"], "block", "closed", "opened")
    ends = ends.select(*w, _state(F.col("fixed"), F.col("flips"), F.lit(False)).alias("open_before"))
    lines = lines.join(ends, w).withColumn("goes_on", _state(F.col("fixed"), F.col("flips"), F.col("open_before")))
    at = F.when(~F.col("goes_on"), F.struct("block", "row"))
    inside = Window.partitionBy(*w).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("near", F.last(at, ignorenulls=True).over(inside))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.groupBy(*w).agg(F.max(at).alias("start")).withColumn("far", F.last("start", ignorenulls=True).over(earlier)).drop("start")
    lines = lines.join(starts, w).withColumn("at", F.coalesce("near", "far"))
    parts = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    return lines.groupBy("file", "at").agg(F.array_join(F.transform(parts, lambda p: p.value), "\n").alias("record"))


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, block, row, value) of all lines; row orders the lines of a split."""
    raw = spark.read.text(list(paths))
    meta = F.col("_metadata")
    return raw.select(meta.file_path.alias("file"), meta.file_block_start.alias("block"), F.monotonically_increasing_id().alias("row"), "value")


_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "maxCharsPerColumn": "-1"}


def _ddl(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))


def _columns(header: str, spark: SparkSession) -> list[str]:
    cells = spark.range(1).select(F.from_csv(F.lit(header), _ddl(header.count(",") + 1), _OPTIONS).alias("c")).first().c
    return [c.removeprefix("\ufeff") for c in cells if c is not None]


def _named(cells: DataFrame, names: Sequence[str], columns: Sequence[str], place: Column, keep: str | None) -> DataFrame:
    """``columns`` of cells c0, c1, ... by the header's names; of several of one name the last. What is missing is empty."""
    at = {n: i for i, n in enumerate(names)}
    found = [text(F.col(f"c{at[c]}")).alias(c) if c in at else F.lit("").alias(c) for c in columns]
    return cells.select(*found, *([place.alias(keep)] if keep else []))


def read_csv(spark: SparkSession, *paths: str, columns: Sequence[str] | None = None, place: str | None = None) -> DataFrame:
    """All rows of CSV files, each with a header of its own, as strings: columns by name, missing ones empty. ``columns``: those to
    read, else all, in the order in which the headers, sorted, name them. ``place``: a column that orders rows by file, and by
    their place in it.

    Rows shorter than their header end in empty cells, longer ones lose the rest; lines of white space alone are no rows; two
    quotes in a quoted field are one; line ends inside a field become ``\\n``; of columns of one name the last counts. Files
    without a line have no rows. One pass finds each file's header and whether its fields span lines; the lines of files where
    they do are stored once, the others go to Spark's reader. The driver holds a row for each file, as it lists them anyway.
    """
    some = F.trim("value") != ""
    first = F.min_by("value", F.when(some, F.struct("block", "row"))).alias("header")
    seen = _lines(spark, paths).groupBy("file").agg(first, F.bool_or(leaves_open(F.col("value"))).alias("spans")).collect()
    plain: dict[str, list[str]] = {}
    for r in sorted(seen, key=lambda r: r.file):
        if not r.spans and r.header is not None:
            plain.setdefault(r.header, []).append(unquote(r.file))
    spanning, heads = sorted(unquote(r.file) for r in seen if r.spans), []
    if spanning:
        found = written(records(written(_lines(spark, spanning), "csv-lines")).where(F.trim("record") != ""), "csv-records")
        first = found.groupBy("file").agg(F.min_by("record", "at").alias("header"), F.min("at").alias("first"))
        body = found.join(first, "file").where("at > first").withColumn("place", F.struct("file", "at.block", "at.row"))
        heads = sorted(r.header for r in first.select("header").distinct().collect())
    names = {h: _columns(h, spark) for h in sorted({*plain, *heads})}
    wanted = list(columns) if columns is not None else list(dict.fromkeys(n for h in names for n in names[h]))
    kinds = [T.StructField(c, T.StringType()) for c in wanted]
    kinds += [T.StructField(place, T.StructType.fromDDL("file string, block long, row long"))] if place else []
    out = spark.createDataFrame([], T.StructType(kinds))
    meta = F.col("_metadata")
    here = F.struct(meta.file_path.alias("file"), meta.file_block_start.alias("block"), F.monotonically_increasing_id().alias("row"))
    for h, files in plain.items():
        cells = spark.read.csv(files, schema=_ddl(len(names[h])), header=True, enforceSchema=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1)
        out = out.unionByName(_named(cells, names[h], wanted, here, place))
    for h in heads:
        mine = body.where(F.col("header") == h)
        cells = mine.select(F.from_csv("record", _ddl(len(names[h])), _OPTIONS).alias("c"), "place").select("c.*", "place")
        out = out.unionByName(_named(cells, names[h], wanted, F.col("place"), place))
    return out
