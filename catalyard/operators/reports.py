"""Searches, counts and lists over the catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import make_id, search_url, text
from ..sources.scratch import written


def search(df: DataFrame, query: str, columns: Sequence[str] = ("brand", "model", "fcc_id")) -> DataFrame:
    """Rows with ``query`` in a column, whatever its case; it is no pattern. A blank query keeps all."""
    if not query.strip():
        return df
    hit: Column = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.upper(text(F.col(c))), F.upper(F.lit(query)))
    return df.where(hit)


def filter_brand(df: DataFrame, brand: str) -> DataFrame:
    return df.where(F.upper("brand") == F.upper(F.lit(brand)))


def admin_search(df: DataFrame, terms: str, columns: Sequence[str]) -> DataFrame:
    """Every word of ``terms`` in some column."""
    for t in terms.split():
        df = search(df, t, columns)
    return df


def facets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value, n) of each distinct value of each column, in one pass."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], list(columns), "facet", "value")
    return long.groupBy("facet", "value").agg(F.count("*").alias("n"))


def facet_filter(df: DataFrame, **values: object) -> DataFrame:
    """Rows that have each named column's value; None asks for null."""
    for c, v in values.items():
        df = df.where(F.col(c).eqNullSafe(F.lit(v)))
    return df


def select_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def brand_prefix(df: DataFrame, brand: str, code: str) -> DataFrame:
    return df.where((F.col("brand") == brand) & F.startswith(F.col("model"), F.lit(code)))


def count_by_brand(df: DataFrame, brand: str = "brand") -> DataFrame:
    return df.groupBy(brand).agg(F.count("*").alias("n")).orderBy(brand)


def count_by_brand_desc(df: DataFrame, ordinal: str) -> DataFrame:
    """Largest first, ties by first appearance."""
    return df.groupBy("brand").agg(F.count("*").alias("n"), F.min(ordinal).alias("first_at")).orderBy(F.desc("n"), "first_at")


def top_brands(df: DataFrame, n: int = 10) -> DataFrame:
    return df.groupBy("brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(n)


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("brand").alias("n_brands"))


def models_without_code(df: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose brand lacks a code: the list of models, as rows."""
    return df.join(codes.select("brand").distinct(), "brand", "left_anti")


def brands_without_code(df: DataFrame, codes: DataFrame, ordinal: str) -> DataFrame:
    """(brand, n, example) for brands that lack a code; example: the first model. ``models_without_code`` lists them."""
    return models_without_code(df, codes).groupBy("brand").agg(F.count("*").alias("n"), F.min_by("model", ordinal).alias("example"))


#: Fixed value: what an id looks like in a text.
ID_IN_TEXT = r"(?i)\b([A-Z0-9]{3,5})-([A-Z0-9\-]+)\b"


def most_common_code(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, code): the most frequent code-like first part of ids in the texts of a key, as counted before upper-casing,
    the smallest of the most frequent. Partial counts are combined before the shuffle."""
    found = F.regexp_extract_all(F.col(body), F.lit(ID_IN_TEXT), 1)
    n = pages.select(key, F.explode(found).alias("code")).groupBy(key, "code").agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "code")).alias("b"))
    return best.select(key, F.upper("b.code").alias("code"))


def models_by_manufacturer(df: DataFrame) -> DataFrame:
    return df.groupBy("brand").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("model")), ", ").alias("models"))


def first_models(df: DataFrame, n: int = 100) -> DataFrame:
    """(brand, n, models) as ``models_by_manufacturer``, with the first ``n`` models at most; n counts all. Each task sends a
    brand's first ``n`` on, so no brand is one task's load. ``models_of`` has the whole list, as rows."""
    place = F.row_number().over(Window.partitionBy("brand").orderBy("model"))
    some = df.where("model is not null").select("brand", "model").withColumn("place", place).where(F.col("place") <= n)
    listed = some.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct("place", "model"))).alias("some"))  # at most n
    counts = df.groupBy("brand").agg(F.count("*").alias("n"))
    models = F.array_join(F.transform("some", lambda x: x.model), ", ")
    joined = counts.withColumnRenamed("brand", "_brand").join(listed, F.col("_brand").eqNullSafe(F.col("brand")), "left")
    return joined.select(F.col("_brand").alias("brand"), "n", text(models).alias("models"))


def models_of(df: DataFrame) -> DataFrame:
    """(brand, place, model): the whole lists, sorted, as rows; places count from 1 in each brand. Rows are dealt by ranges, so a
    brand of any size is many tasks'; what is before a range comes from a row for each range and brand."""
    ordered = df.select("brand", "model").repartitionByRange("brand", "model").sortWithinPartitions("brand", "model")
    ordered = written(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "ordered")
    counts = ordered.groupBy("brand", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("brand").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("brand").alias("_b"), F.col("part").alias("_p"), "first", before.alias("before"))
    joined = ordered.join(starts, F.col("brand").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p")))
    return joined.select("brand", (F.col("before") + F.col("row") - F.col("first") + 1).alias("place"), "model")


#: Size of a sketch of distinct values: 2^14 registers, an error of 0.8 %.
SKETCH = 14


def part_sketches(df: DataFrame, part: str) -> DataFrame:
    """(part, n_rows, brands): how many rows each part has, and a sketch of its distinct brands. Kept beside the parts, it is made
    anew for those that change."""
    return df.groupBy(part).agg(F.count("*").alias("n_rows"), F.hll_sketch_agg("brand", SKETCH).alias("brands"))


def totals_of(sketches: DataFrame) -> DataFrame:
    """``totals`` from sketches of parts, without a row being read: n_rows is exact, n_brands within about 2 %."""
    rows = F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    brands = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("brands")), F.lit(0)).alias("n_brands")
    return sketches.agg(rows, brands)


def part_counts(df: DataFrame, part: str) -> DataFrame:
    """(part, brand, n), which ``counts_of`` adds up to ``count_by_brand``."""
    return df.groupBy(part, "brand").agg(F.count("*").alias("n"))


def counts_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("brand").agg(F.sum("n").alias("n")).orderBy("brand")


def renewed(stored: DataFrame, changed: DataFrame, part: str) -> DataFrame:
    """Sketches or counts of parts after some parts were written anew: those of ``changed`` in place of the old."""
    return stored.join(changed.select(part).distinct(), part, "left_anti").unionByName(changed)


def generation_tally(df: DataFrame, codes: DataFrame) -> DataFrame:
    """processed, generated and without_code rows."""
    one = codes.groupBy("brand").agg(F.max("code").alias("code"))
    out = df.join(one, "brand", "left").withColumn("_id", make_id(F.col("code"), F.col("model")))
    return out.agg(F.count("*").alias("processed"), F.count("_id").alias("generated"), F.count_if(F.col("code").isNull()).alias("without_code"))


def manual_queue(df: DataFrame, codes: DataFrame, pages: DataFrame, ordinal: str, base: str) -> DataFrame:
    """Brands without a code, for which ``pages`` (brand, body) show none either, with a search link for their first model."""
    found = most_common_code(pages, "brand", "body").where("code is not null")
    lack = brands_without_code(df, codes, ordinal).join(found.select("brand"), "brand", "left_anti")
    return lack.withColumn("url", search_url(base, F.col("brand"), F.col("example")))


def dedupe_batch(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def sort_catalog(df: DataFrame) -> DataFrame:
    return df.orderBy(F.lower("brand"), F.upper("model"))


def recent(df: DataFrame, n: int = 10, at: str = "created_at", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(at), F.desc(tie)).limit(n)


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """A page by its number. Everything before it is sorted too: ``page_after`` does without for deep pages."""
    return df.orderBy("brand", "model", "id").offset((number - 1) * size).limit(size)


def page_after(df: DataFrame, brand: str, model: str, id_: int, size: int = 50) -> DataFrame:
    """The page after the row (brand, model, id), which is the last of the page before: a filter and the first rows."""
    past = (F.col("brand") > brand) | ((F.col("brand") == brand) & ((F.col("model") > model) | ((F.col("model") == model) & (F.col("id") > id_))))
    return df.where(past).orderBy("brand", "model", "id").limit(size)
