"""A table of trigrams and where they stand, which answers substring searches without reading the catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text
from ..operators.reports import search
from .parted import store_schema, stored_schema

#: The size of a gram: shorter words are searched for in the catalogue itself.
GRAM = 3


def postings(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, pos, gram): the trigrams of each column in upper case, and their places."""
    cells = F.array(*(F.struct(F.lit(i).alias("field"), F.upper(text(F.col(c))).alias("t")) for i, c in enumerate(columns)))
    each = df.select(F.col(key).alias("key"), F.inline(cells))
    places = F.sequence(F.lit(1), F.length("t") - (GRAM - 1))
    some = each.where(F.length("t") >= GRAM).select("key", "field", "t", F.explode(places).alias("pos"))
    return some.select("key", "field", "pos", F.substr("t", F.col("pos"), F.lit(GRAM)).alias("gram"))


@dataclass(frozen=True)
class TrigramIndex:
    """Postings of ``columns`` in ``path``/grams/slot=N, by the hash of the gram, sorted by gram; ``key`` is a row's unique column.

    Upserted rows are added with a number of their own; ``path``/changes says which keys have newer postings than their first,
    and what it supersedes is left out of answers. ``create`` anew removes it.
    """

    path: str
    key: str = "id"
    columns: tuple[str, ...] = ("brand", "model", "fcc_id")
    slots: int = 64

    def _slot(self, gram: str | Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.slots)).cast("int")

    def _write(self, df: DataFrame, number: int, mode: str) -> None:
        found = postings(df, self.key, self.columns).select("*", F.lit(number).cast("long").alias("number"), self._slot("gram").alias("slot"))
        # A common gram's slot is dealt to several files; each is sorted, so that readers skip what they don't ask for.
        dealt = found.repartition("slot", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("slot", "gram", "key")
        dealt.write.mode(mode).partitionBy("slot").parquet(f"{self.path}/grams")
        if mode == "overwrite":
            store_schema(dealt, f"{self.path}/grams")

    def create(self, df: DataFrame) -> None:
        """Indexes the rows of ``df`` in place of all that was there."""
        self._write(df, 0, "overwrite")
        kind = df.select(F.col(self.key).alias("key"), F.lit(0).cast("long").alias("number")).limit(0)
        kind.write.mode("overwrite").parquet(f"{self.path}/changes")

    def add(self, rows: DataFrame, number: int) -> None:
        """Indexes the new state of inserted or updated ``rows`` (distinct keys). ``number`` rises from 1 with each batch; a batch
        given again under its number changes no answer. Only postings of these rows are written."""
        self._write(rows, number, "append")
        rows.select(F.col(self.key).alias("key"), F.lit(number).cast("long").alias("number")).write.mode("append").parquet(f"{self.path}/changes")

    def _hits(self, spark: SparkSession, word: str, columns: Sequence[str]) -> DataFrame:
        """(key) of rows with ``word``, of at least GRAM characters in upper case, in one of ``columns``: where all its grams
        stand one after another, the word stands."""
        upper = word.upper()
        at = [(upper[i : i + GRAM], i) for i in range(len(upper) - GRAM + 1)]
        grams = sorted({g for g, _ in at})
        fields = [self.columns.index(c) for c in columns]
        offsets = F.lit(None).cast("array<int>")
        for g in grams:
            offsets = F.when(F.col("gram") == g, F.array(*(F.lit(i) for x, i in at if x == g))).otherwise(offsets)
        slots = [r.slot for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(self._slot("gram").alias("slot")).distinct().collect()]
        stored = spark.read.schema(stored_schema(spark, f"{self.path}/grams")).parquet(f"{self.path}/grams")
        some = stored.where(F.col("slot").isin(slots) & F.col("gram").isin(grams) & F.col("field").isin(fields))
        starts = some.select("key", "number", "field", F.explode(offsets).alias("offset"), "pos").withColumn("start", F.col("pos") - F.col("offset"))
        whole = starts.groupBy("key", "number", "field", "start").agg(F.count_distinct("offset").alias("n")).where(F.col("n") == len(at))
        newest = spark.read.parquet(f"{self.path}/changes").groupBy("key").agg(F.max("number").alias("newest"))
        found = whole.select("key", "number").distinct().join(newest, "key", "left")
        return found.where(F.col("number") == F.coalesce("newest", F.lit(0))).select("key")

    def search(self, spark: SparkSession, words: Sequence[str], table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """(key) of the rows that have each of ``words`` in one of ``columns``, whatever its case.

        Words of under three characters are looked for in ``table`` (the catalogue), among the rows that the other words leave;
        where all words are that short, in all of it. Blank words ask for nothing; without words all rows are found.
        """
        columns = list(columns or self.columns)
        asked = [w for w in words if w.strip()]
        short = [w for w in asked if len(w.upper()) < GRAM]
        found = None
        for w in asked:
            if w not in short:
                hits = self._hits(spark, w, columns)
                found = hits if found is None else found.join(hits, "key", "left_semi")
        if found is not None and not short:
            return found.select(F.col("key").alias(self.key))
        rows = table if found is None else table.join(found.withColumnRenamed("key", self.key), self.key, "left_semi")
        for w in short:
            rows = search(rows, w, columns)
        return rows.select(self.key)
